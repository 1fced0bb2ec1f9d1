"""The driver's tables as a temporal knowledge graph, and a catalog of graph tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "episodes": "uuid string, name string, group_id string, source string, source_description string, content string, created_at timestamp, valid_at timestamp",
    "entities": "uuid string, name string, group_id string, labels array<string>, summary string, attributes map<string,string>, created_at timestamp",
    "facts": "uuid string, name string, fact string, source_uuid string, target_uuid string, group_id string, episodes array<string>, valid_at timestamp, invalid_at timestamp, expired_at timestamp, reference_time timestamp, attributes map<string,string>",
    "mentions": "episode_uuid string, entity_uuid string",
    "entity_links": "a_uuid string, b_uuid string, kind string, created_at timestamp",
    "embeddings": "uuid string, kind string, vector array<float>",
}
#: Tables that are read by group.
GROUPED = {"episodes", "entities", "facts"}
#: Columns that an update leaves as they were.
IMMUTABLE = {
    "episodes": ("group_id", "created_at"),
    "entities": ("group_id", "created_at"),
    "facts": ("source_uuid", "target_uuid", "group_id", "reference_time"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bootstrap(spark: SparkSession, database: str) -> None:
    """Creates the graph tables of a database that don't exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in SCHEMAS.items():
        part = " PARTITIONED BY (group_id)" if name in GROUPED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet{part}")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMAS[name]))


def documents_as_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("uuid"), F.col("source").alias("group_id"), F.col("lang").alias("source"), F.col("text").alias("content"), "n_chars")


def parts_as_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("name"), F.col("p_brand").alias("group_id"), F.col("p_type").alias("summary"))


def orders_as_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer places orders of a status: the order is valid until that customer's next; status F is expired."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    from pyspark.sql import Window as W

    until = F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    facts = orders.withColumn("invalid_at", until)
    return facts.join(customer, facts.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("uuid"), F.col("o_orderstatus").alias("name"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("fact"),
        F.col("o_custkey").alias("source_uuid"), F.col("c_nationkey").cast("long").alias("target_uuid"), F.col("c_mktsegment").alias("group_id"),
        F.col("o_orderdate").alias("valid_at"), "invalid_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("expired_at"),
    )

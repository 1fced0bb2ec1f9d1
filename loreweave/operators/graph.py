"""The graph of entities and facts: incident facts, links, one hop, reference counts, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreweave.operators.shuffles import dealt
from loreweave.operators.vectors import nearest


def incident(facts: DataFrame) -> DataFrame:
    """A row for each end of each fact, one for a loop: OR over both ends as an equi-join key."""
    return facts.withColumn("entity", F.explode(F.array_distinct(F.array("source_uuid", "target_uuid"))))


def symmetric(links: DataFrame) -> DataFrame:
    """entity, other: each link from both of its ends."""
    return links.select(F.col("a_uuid").alias("entity"), F.col("b_uuid").alias("other")).unionByName(links.select(F.col("b_uuid").alias("entity"), F.col("a_uuid").alias("other"))).distinct()


def linked_counts(links: DataFrame) -> DataFrame:
    """entity, n_linked: how many others each entity is linked with, whatever the links' order.

    Each link is told from its repetitions once, with its ends in order, in tasks of like many links, and then counts at both ends.
    """
    ends = links.select(F.array_sort(F.array("a_uuid", "b_uuid")).alias("e")).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
    once = dealt(ends, links.count(), "a", "b").distinct()
    return once.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_linked"))


def reference_counts(entities: DataFrame, facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """uuid, refs: facts at the entity and mentions of it."""
    used = incident(facts).select(F.col("entity").alias("uuid")).unionByName(mentions.select(F.col("entity_uuid").alias("uuid")))
    counts = used.groupBy("uuid").agg(F.count("*").alias("refs"))
    return entities.select("uuid").join(counts, "uuid", "left").select("uuid", F.coalesce("refs", F.lit(0)).alias("refs"))


def one_hop(seeds: DataFrame, facts: DataFrame, links: DataFrame, cap: int) -> DataFrame:
    """Facts at the seeds (query, entity, rank, group_id) in their group, then at entities linked to them in any.

    A fact comes once for a query, by its earliest way in; cap facts at most for each.
    """
    ends = incident(facts.where("expired_at is null"))
    near = seeds.join(ends, ["entity", "group_id"]).select("query", "uuid", "rank", F.lit(0).alias("hop"))
    linked = seeds.join(symmetric(links), "entity").select("query", "rank", F.col("other").alias("entity"))
    far = linked.join(ends, "entity").select("query", "uuid", "rank", F.lit(1).alias("hop"))
    first = near.unionByName(far).groupBy("query", "uuid").agg(F.min(F.struct("rank", "hop")).alias("way"))
    order = W.partitionBy("query").orderBy("way.rank", "way.hop", "uuid")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap).select("query", "uuid", F.col("way.hop").alias("hop"), "position")


def with_names(facts: DataFrame, entities: DataFrame, outer: bool = True) -> DataFrame:
    """facts with source_name and target_name: the id where an end is unknown, or without such facts."""
    how = "left" if outer else "inner"
    names = entities.select("uuid", "name")
    a = names.select(F.col("uuid").alias("source_uuid"), F.col("name").alias("_a"))
    b = names.select(F.col("uuid").alias("target_uuid"), F.col("name").alias("_b"))
    joined = facts.join(a, "source_uuid", how).join(b, "target_uuid", how)
    return joined.withColumns({"source_name": F.coalesce("_a", F.col("source_uuid").cast("string")), "target_name": F.coalesce("_b", F.col("target_uuid").cast("string"))}).drop("_a", "_b")


def history(facts: DataFrame, entities: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """Active facts at the entities of the given names (name, group_id), newest first, limit for each."""
    found = names.join(entities, ["name", "group_id"]).select("name", "group_id", F.col("uuid").alias("entity"))
    at = found.withColumnRenamed("name", "of").join(incident(facts.where("expired_at is null")), ["entity", "group_id"])
    order = W.partitionBy("entity").orderBy(F.desc_nulls_last("valid_at"), "uuid")
    return at.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def history_or_nearest(facts: DataFrame, entities: DataFrame, names: DataFrame, vectors: DataFrame, limit: int = 20) -> DataFrame:
    """history() of names (name, group_id, vector), where a name that no entity of its group has stands for the nearest entity by vector.

    vectors: uuid, vector. The columns are those of history(), `of` is the name that was asked for.
    """
    asked = names.select("name", "group_id").distinct()
    known = asked.join(entities.select("name", "group_id"), ["name", "group_id"], "left_semi")
    unknown = names.join(known, ["name", "group_id"], "left_anti").where("name is not null").select(F.struct("name", "group_id").alias("query"), "vector", "group_id")
    held = entities.select(F.col("uuid").alias("doc"), "group_id").join(vectors.select(F.col("uuid").alias("doc"), "vector"), "doc")
    near = nearest(held, unknown, 1, "group_id").select(F.col("query.name").alias("of"), F.col("query.group_id").alias("group_id"), F.col("doc").alias("entity"))
    exact = known.join(entities, ["name", "group_id"]).select(F.col("name").alias("of"), "group_id", F.col("uuid").alias("entity"))
    at = exact.unionByName(near).join(incident(facts.where("expired_at is null")), ["entity", "group_id"])
    order = W.partitionBy("of", "entity").orderBy(F.desc_nulls_last("valid_at"), "uuid")
    return at.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def export(entities: DataFrame, facts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges between them and links between them."""
    nodes = entities.select("uuid", F.col("name").alias("label"), F.coalesce(F.nullif("summary", F.lit("")), "name").alias("title"), "group_id")
    ids = nodes.select("uuid")
    edges = facts.where("expired_at is null").join(ids.withColumnRenamed("uuid", "source_uuid"), "source_uuid", "left_semi").join(ids.withColumnRenamed("uuid", "target_uuid"), "target_uuid", "left_semi")
    edges = edges.select("uuid", "source_uuid", "target_uuid", F.col("name").alias("label"), F.col("invalid_at").isNull().alias("active"))
    both = links.join(ids.withColumnRenamed("uuid", "a_uuid"), "a_uuid", "left_semi").join(ids.withColumnRenamed("uuid", "b_uuid"), "b_uuid", "left_semi")
    return nodes, edges, both.select("a_uuid", "b_uuid", "kind")

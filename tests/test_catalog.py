"""Every query that SQL expresses, against DuckDB over the smallest data set."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Window as W

from loreweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


def plain(v):
    return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in df.select(columns).collect()) == sorted(tuple(map(plain, r)) for r in want)


@needs_tables
def test_streams_in_several_batches(spark, tmp_path):
    """Facts that come in three batches, some late: each ends where the next of its key begins."""
    from pyspark.sql import functions as F

    from loreweave.streaming import ingest

    rows = spark.read.parquet(f"{FOLDER}/orders.parquet").select(F.col("o_custkey").alias("source_uuid"), F.col("o_orderkey").alias("uuid"), F.col("o_orderdate").alias("valid_at")).orderBy("valid_at").limit(90).collect()
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], "source_uuid long, uuid long, valid_at timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path))
    frame = spark.createDataFrame(rows, "source_uuid long, uuid long, valid_at timestamp_ntz")
    stream = ingest.read_folder(spark, str(tmp_path), frame.schema, files=1)
    by = W.partitionBy("source_uuid").orderBy("valid_at", "uuid")
    want = {(r.uuid, r.invalid_at) for r in frame.withColumn("invalid_at", F.lead("valid_at").over(by)).where("invalid_at is not null").collect()}
    assert {(r.uuid, r.invalid_at) for r in ingest.supersessions(stream, ["source_uuid"]).collect()} == want
    counts = ingest.run_updates(ingest.counts_by_window(ingest.read_folder(spark, str(tmp_path), frame.schema, files=1), "valid_at", "365 days", "10000 days"), "counts", ["window_start"])
    assert sum(r.n for r in counts.collect()) == 90


def test_search_graph_where_customer_0_is_searched(spark, tmp_path):
    """The link of customer 0 leads to no customer, and to no nation either."""
    spark.sql("SELECT 0L AS c_custkey, 'Customer' AS c_name, 'BUILDING' AS c_mktsegment, 3 AS c_nationkey UNION ALL SELECT 7L, 'Customer', 'MACHINERY', 0").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, IF(id < 2, 0L, 7L) AS o_custkey, 'O' AS o_orderstatus, '5-NONE' AS o_orderpriority, timestampadd(DAY, CAST(id AS INT), TIMESTAMP_NTZ'1998-01-01 00:00:00') AS o_orderdate FROM range(6)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS doc_id, 'nothing' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["search_graph"](spark, str(tmp_path)).where("kind = 'fact'").collect()
    assert sorted((r.query, r.uuid) for r in found) == [(1, 1), (2, 5)]  # at customers 0 and 7, what holds of theirs

"""The queries that SQL expresses, against DuckDB over the smallest data set."""

from pathlib import Path

import duckdb
import pytest

from loreweave.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(columns).collect())


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in queries()["op10_language"](spark, FOLDER).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in found) >= 0.9 * len(found)


def _rare_class(spark, folder, name, column, rare):
    """Recall and precision of the rare label on held-out rows."""
    rows = queries()[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", column), "doc_id").select("predicted", column).collect()
    hit = sum(r.predicted == r[column] == rare for r in rows)
    return hit / sum(r[column] == rare for r in rows), hit / max(1, sum(r.predicted == rare for r in rows))


def test_rare_labels_are_found(spark):
    folder = "/root/testdata/sf0.01"
    recall, precision = _rare_class(spark, folder, "op1_quality", "quality", 0)
    assert recall >= 0.9 and precision >= 0.8
    recall, precision = _rare_class(spark, folder, "op5_toxicity", "toxic", 1)
    assert recall >= 0.7 and precision >= 0.9

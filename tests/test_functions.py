import pytest
from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.functions import time as D
from loreweave.functions import vector as V


def _one(spark, column, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column.alias("y")).orderBy("i").collect()


def test_names(spark):
    assert [r.y for r in _one(spark, T.norm_name("x"), "My_App-é ", "  A.B", "知识-图谱", None)] == ["my app é", "a b", "知识 图谱", None]
    assert [r.y for r in _one(spark, T.alnum_only("x"), "My_App-1.0", "a/b\\c")] == ["myapp10", "abc"]
    assert [r.y for r in _one(spark, T.is_path("x"), "a/b", "note: x", "E:", "plain")] == [True, True, False, False]
    assert [r.y for r in _one(spark, T.scoped_name("x"), "@s/web", "web", "@s/a/b")] == ["web", None, None]
    assert [r.y for r in _one(spark, T.is_domain("x"), "www.Example.com", "a b.com", "x.y")] == [True, False, False]
    assert [r.y for r in _one(spark, T.basename("x"), "/a/B/", "c:\\d\\e", "f")] == ["B", "e", "f"]


def test_tokens_and_phrases(spark):
    assert [list(r.y) for r in _one(spark, T.tokens("x"), "Café LLM重启", "", None)] == [["cafe", "llm", "重", "启"], [], []]
    assert [[list(p) for p in r.y] for r in _one(spark, T.query_phrases("x"), "a-b c? ?", "1 2 3 4 5 6 7 8 9 10")] == [[["a", "b"], ["c"]], [[str(k)] for k in range(1, 9)]]


def test_times(spark):
    got = [str(r.y) for r in _one(spark, D.parse_time("x"), "2024-01-02T03:04:05Z", "2024-01-02 03:04", "2024-01-02", "garbage", None)]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:00", "2024-01-02 00:00:00", "None", "None"]
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    factors = [r.y for r in _one(spark, D.recency_factor(F.col("x").try_cast("timestamp"), now), "2024-03-01", "2024-01-01", "2025-01-01", "?")]
    assert factors == pytest.approx([1.0, 0.75, 1.0, 1.0])


def test_cosine(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, [1.0], [1.0, 0.0])]
    out = spark.createDataFrame(rows, "i int, a array<float>, b array<float>").select("i", V.cosine(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert out[0].s == pytest.approx(1.0) and out[1].s == 0.0 and out[2].s is None and out[3].s is None


def test_white_space_and_accents_of_all_scripts(spark):
    assert [[list(p) for p in r.y] for r in _one(spark, T.query_phrases("x"), "记忆\u3000搜索")] == [[["记", "忆"], ["搜", "索"]]]
    assert [r.y for r in _one(spark, T.folded("x"), "ŽŃÅÃ ǘ ß")] == ["znaa u ß"]
    assert [r.y for r in _one(spark, T.norm_name("x"), "a b\t", "\u3000a")] == ["a b", "a"]
    assert [r.y for r in _one(spark, T.alnum_only("x"), "a\u3000b\u00a0c")] == ["abc"]
    assert [str(r.y.end) for r in _one(spark, D.dates_in_text("x"), "2018年3月\n至\n2022年6月")] == ["2022-06-01"]
    rows = spark.createDataFrame([("uses", "a fact", "2024-01-02", None), (None, "b", None, None)], "n string, f string, v string, i string")
    got = [r.y for r in rows.select(T.rendered("n", "f", F.col("v").cast("timestamp"), F.col("i").cast("timestamp")).alias("y")).collect()]
    assert got == ["- uses: a fact [2024-01-02 → now]", "- : b"]
    assert [r.y for r in _one(spark, T.without_fence("x"), "```json\n{}", "{}")] == ["{}", "{}"]

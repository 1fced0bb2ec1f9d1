"""Fixed cases: time windows in queries, dates in texts, rules for names, spaced text, reranking."""

from pyspark.sql import functions as F

from loreweave.functions import rules
from loreweave.functions import text as T
from loreweave.functions import time as D
from loreweave.operators import retrieval as R

ASKED = {
    "2024-03-05 的会": ("2024-03-05", "2024-03-05"), "2026年8月14日": ("2026-08-14", "2026-08-14"), "1月5日": ("2024-01-05", "2024-01-05"), "八月14号": ("2023-08-14", "2023-08-14"),
    "八月十四日": ("2023-08-01", "2023-08-31"), "八月中旬": ("2023-08-10", "2023-08-20"), "一月初": ("2024-01-01", "2024-01-10"), "2月底": ("2023-02-21", "2023-02-28"),
    "八月": ("2023-08-01", "2023-08-31"), "2026年8月": ("2023-08-01", "2023-08-31"), "8月中": None, "13月": None, "2月30日": None, "上个月": ("2023-12-01", "2023-12-31"),
    "最近一周": ("2024-01-01", "2024-01-31"), "附近": ("2024-01-01", "2024-01-31"), "你好": None, "": None,
}

DATED = {
    "他于2018年3月15日入职": ("2018-03-15", None), "2018年3月至2022年6月在职": ("2018-03-01", "2022-06-01"), "2019年和2020年都在": ("2019-01-01", None),
    "2021年": ("2021-01-01", None), "2001年5月 到 2003年": ("2001-05-01", "2003-01-01"), "没有日期": (None, None), "": (None, None),
}

NAMES = [
    ("Nginx", "nginx", None, True, "归一化同名"), ("my-app", "myapp", None, True, "分隔符差异"), ("@scope/web", "@scope/gateway", 0.99, False, "scope包名不同"),
    ("@scope/web", "web", 0.99, False, "scope包名不同"), ("~/.pi", "pi", 0.99, False, "路径↔非路径"), ("www.example.com", "example.com", None, True, "域名www前缀"),
    ("NGINX", "反向代理", 0.95, True, "中英对照"), ("NGINX", "反向代理", 0.94, False, ""), ("NGINX", "反向代理", None, False, ""),
    ("/a/x/app", "/b/y/app", 0.93, True, "同名路径项"), ("/a/x/app", "/b/y/app", 0.92, False, ""), ("C:\\dir\\", "c:/dir", None, True, "归一化同名"), ("abc", "xyz", 0.99, False, ""),
]


def test_windows(spark):
    got = spark.createDataFrame([(q,) for q in ASKED], "q string").withColumn("w", D.query_window("q", F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'"))).collect()
    assert {r.q: r.w and (str(r.w.start), str(r.w.end)) for r in got} == ASKED


def test_dates(spark):
    got = spark.createDataFrame([(t,) for t in DATED], "t string").withColumn("w", D.dates_in_text("t")).collect()
    assert {r.t: tuple(d and str(d) for d in r.w) for r in got} == DATED


def test_rules(spark):
    pairs = spark.createDataFrame([(i, a, b, s) for i, (a, b, s, _, _) in enumerate(NAMES)], "i int, a string, b string, s double")
    got = pairs.select("i", rules.auto_merge(F.col("a"), F.col("b"), F.col("s")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in got] == [(ok, why) for _, _, _, ok, why in NAMES]


def test_spaced(spark):
    want = {"端口20102": "端 口 20102", "LLM重启": "LLM 重 启", "知识图谱": "知 识 图 谱", "abc": "abc", "": ""}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", T.spaced_cjk("t").alias("s")).collect()
    assert {r.t: r.s for r in got} == want


def test_rerank(spark):
    ranked = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.8, 2), (1, 13, 0.7, 3), (2, 21, 0.6, 1), (2, 22, 0.5, 2)], "query int, doc int, score double, rank int")
    scores = spark.createDataFrame([(1, 13, 12.5), (1, 11, 4.0)], "query int, doc int, relevance double")
    got = R.rerank(ranked, scores).orderBy("query", "rank").collect()
    assert [(r.query, r.doc, r.relevance) for r in got] == [(1, 13, 10.0), (1, 11, 4.0), (1, 12, 0.0), (2, 21, 0.0), (2, 22, 0.0)]

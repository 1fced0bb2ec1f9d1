from collections import Counter

import duckdb
import numpy as np

from loreweave.llm import quality_rules as R
from loreweave.llm.queries import OP3_SQL
from tests.llm import cases


def _brute(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_repeated_words_match_brute_force():
    rng = np.random.default_rng(1)
    docs = [list(map(int, rng.integers(0, 2, n))) for n in (0, 3, 8, 9, 40, 25, 16)]
    flat = np.array([w for d in docs for w in d], np.int64)
    at = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    assert R.repeated_words(flat, at, len(docs)).tolist() == [_brute(d) for d in docs]


def test_edge_cases_match_sql(spark):
    rows = [*cases.ROWS, *[cases.row(100 + i, "# " * 30 + cases.words(30, i), "de", "b") for i in range(3)], cases.row(200, "line\n" * 30), cases.row(201, cases.words(12, 9) + " " + cases.words(12, 9))]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(map(str, (tuple(r) for r in R.judge(docs).select(columns).collect())))
    db = duckdb.connect()
    documents = docs.toArrow()
    db.register("documents", documents)
    assert got == sorted(map(str, db.sql(f"SELECT {', '.join(columns)} FROM ({OP3_SQL})").fetchall()))


def test_adaptive_fence_rejects_the_odd_one(spark):
    rows = [cases.row(i, cases.words(50, i), "en", "a") for i in range(250)] + [cases.row(999, " ".join(w + "###" for w in cases.words(50, 3).split()), "en", "a")]
    out = R.judge(spark.createDataFrame(rows, cases.SCHEMA)).where("not kept").collect()
    assert [r.doc_id for r in out] == [999]


def test_empty(spark):
    assert R.judge(cases.empty(spark)).count() == 0

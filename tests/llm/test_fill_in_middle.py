import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.llm import fill_in_middle as fim
from tests.llm import cases

SENTINELS = [cases.row(20, "a <P> b"), cases.row(21, "<S>"), cases.row(22, "<M"), cases.row(23, "<" * 50), cases.row(24, "é<S"), cases.row(25, "é\U0001f600" * 40), cases.row(26, "a\x00b" * 30)]


def units_of(text, unit):
    if unit == "char":
        return list(text)
    white = " \t\n\x0b\x0c\r"
    starts = [i for i in range(len(text)) if i == 0 or text[i - 1] in white and text[i] not in white]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def plain_cut(doc_id, text, unit="char"):
    """n, form, prefix, middle and output, by lists of units."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = units_of(text, unit)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    return (n, "spm", i, j - i, f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else (n, "psm", i, j - i, f"<P>{a}<S>{c}<M>{b}")


@pytest.mark.parametrize("unit", ["char", "word"])
@pytest.mark.parametrize("sizes", [None, {"long_bytes": 100, "piece": 16}])
def test_cuts_match_lists_of_units(spark, unit, sizes):
    rows = cases.ROWS + SENTINELS + [cases.row(k, cases.words(k % 37, k) + " \n" * (k % 3)) for k in range(100, 220)]
    if sizes:  # texts of over a hundred bytes are counted in pieces that are dealt out
        rows = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    out = fim.transform(docs, ("doc_id", "text", "score", "n"), unit, **sizes or {})
    assert len(out.columns) == 9 and out.columns[:4] == ["doc_id", "text", "score", "n"]
    cut = out.toDF("doc_id", "text", "score", "own_n", "form", "n", "a", "b", "output").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(str((r.doc_id, r.text, r.n, r.form, r.a, r.b, r.output)) for r in cut) == sorted(str((r[0], r[1], *plain_cut(r[0], r[1], unit))) for r in rows)
    assert all(r.back == (r.text or "") and r.score == 0.5 and r.own_n == 3 for r in cut)


def test_chunks_overlap_by_one_byte():
    text = "ein Wort, zwei  Wörter \U0001f600 drei".encode()
    data = np.frombuffer(text, np.uint8)
    for unit in ("char", "word"):
        whole = np.flatnonzero(fim.begins(data, -1, unit))
        for size in (1, 2, 3, 5, 1000):
            up_to = np.cumsum(fim.counts(data, unit, size))
            assert up_to[-1] == len(whole)
            assert [fim.offset(data, up_to, r, unit, size) for r in range(len(whole) + 1)] == [*whole.tolist(), len(data)]


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    data = np.frombuffer(b"word " * 1000, np.uint8)
    up_to = np.cumsum(fim.counts(data, "char", 50))
    seen = []
    real = fim._chunk
    monkeypatch.setattr(fim, "_chunk", lambda d, k, size, unit: seen.append(k) or real(d, k, size, unit))
    fim.offset(data, up_to, 1234, "char", 50)
    assert seen == [24]


def test_empty_table_and_rates(spark):
    assert fim.transform(cases.empty(spark)).count() == 0
    docs = spark.createDataFrame([(k, "some text to cut") for k in range(2000)], "doc_id long, text string")
    forms = {r.form: r["count"] for r in fim.transform(docs, plain_percent=50, spm_percent=50).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 1000) < 120 and abs(forms["spm"] - 500) < 100
    assert fim.transform(docs, seed=2).select("output").collect() != fim.transform(docs).select("output").collect()

import numpy as np
from pyspark.sql import functions as F

from loreweave.llm import language_id as L
from tests.llm import cases

EN, FR = "the and with from this that have which would there", "le les des avec dans pour être cette leurs où"


def test_gradients_match_differences():
    model = L.BiGru(["a", "b", "c"], hidden=3, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = np.random.default_rng(0).integers(97, 123, (4, 5)), np.array([0, 1, 2, 1, 0])
    _, grads = model.gradients(x, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = model.p[name][at], 1e-3
        model.p[name][at] = keep + step
        up = model.gradients(x, y)[0]
        model.p[name][at] = keep - step
        down = model.gradients(x, y)[0]
        model.p[name][at] = keep
        assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(abs(g[at]), 0.05), name


def test_windows_cover_the_whole_text():
    text = "ÀB" * 50 + " c1d"
    assert b"".join(L.windows(text)).decode() == text.lower().replace(" ", "").replace("1", "")
    assert max(map(len, L.windows(text))) <= L.WINDOW


def _corpus(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else FR).split())), "en" if i % 2 else "fr") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_learns_and_answers_edge_cases(spark):
    docs = _corpus(spark)
    model = L.train(docs, F.col("doc_id") < 40, steps=150)
    held = L.identify(docs.where("doc_id >= 40"), model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in held)
    out = L.identify(cases.frame(spark), model)
    assert out.columns == [*[c for c in cases.frame(spark).columns if c != "score"], "lang_pred", "score"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert out.count() == len(cases.ROWS)
    for text in (None, "", " \n\t \r\x0b\x0c ", "1234 5678 !!! ###"):
        assert next(v for k, v in got.items() if k[1] == text) == ("und", 0.0)
    assert got[(7, "日本語の文章 текст на русском")][0] in ("en", "fr")


def test_empty_tables(spark):
    assert L.train(cases.empty(spark), F.lit(True)) is None
    assert L.identify(cases.empty(spark), None).count() == 0
    assert {r.lang_pred for r in L.identify(cases.frame(spark), None).collect()} == {"und"}


def test_same_model_for_any_partitioning(spark):
    docs = _corpus(spark)
    a, b = (L.train(docs.repartition(n), F.lit(True), steps=20) for n in (1, 7))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_pooled_labels_match_brute_force(spark):
    docs = _corpus(spark)
    model = L.train(docs, F.lit(True), steps=30)
    for r in L.identify(docs.unionByName(cases.frame(spark).select("doc_id", "text", "lang")), model).collect():
        positions = [model.position_probabilities([w])[:, :, 0] for w in L.windows(r.text)] if L.has_letter(r.text) else []
        if not positions:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        pooled = np.concatenate(positions).mean(axis=0, dtype=np.float64)
        assert abs(r.score - pooled.max()) < 1e-4 and pooled[model.languages.index(r.lang_pred)] > pooled.max() - 1e-4


def test_copies_do_not_crowd_out_a_language(spark):
    copies = spark.range(3000).select(F.concat(F.lit("le les des avec "), F.col("id") % 3).alias("text"), F.lit("fr").alias("lang"))
    docs = _corpus(spark).select("text", "lang").where("lang = 'en'").unionByName(copies)
    assert L.train(docs, F.lit(True), docs_per_language=40, steps=5).languages == ["en", "fr"]


def test_least_score_is_half_of_the_lower_hundredth(spark):
    docs = _corpus(spark)
    model = L.train(docs, F.col("doc_id") < 40, steps=150)
    held = L.identify(docs.where("doc_id >= 40"), model).collect()
    right = sorted(int(r.score * 1000) for r in held if r.lang_pred == r.lang)
    for tail in (0.01, 0.3):
        want = 0.5 * right[int(tail * len(right))] / 1000
        assert abs(L.least_score(docs, F.col("doc_id") >= 40, model, tail) - want) < 1e-9
    assert L.least_score(docs, F.lit(False), model) == 0.0
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") < 55, "xx"))
    assert L.least_score(wrong, F.col("doc_id") >= 40, model) == 0.0


def test_windows_beyond_the_bound_are_chosen_by_hash():
    import pyarrow as pa

    found = [f"{a}{b}{c}".encode() for a in "abcdefgh" for b in "klmn" for c in "qrst"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(found)), pa.array(found)], ["lang", "window"])
    seen = []
    kept = L.BiGru.fit
    L.BiGru.fit = lambda self, windows, labels, steps: seen.append(windows) or self
    try:
        list(L._fit(32, 2, 1)(iter([batch])))
        list(L._fit(1000, 2, 1)(iter([batch])))
    finally:
        L.BiGru.fit = kept
    assert len(seen[0]) == 32 and len({w[:1] for w in seen[0]}) >= 6 and seen[1] == sorted(found)


def test_probabilities_are_gathered_in_parts(monkeypatch):
    import pyarrow as pa

    model = L.BiGru(["a", "b", "c"], 4)
    texts = ["one two three", None, "", "12", "four " * 50, "five", "six seven", "eight " * 9]
    batch = pa.record_batch({"text": pa.array(texts)})
    whole = [b.to_pydict() for b in L._label(model, ["text"])(iter([batch]))]
    held = []
    monkeypatch.setattr(L, "GATHERED", 4)
    monkeypatch.setattr(L.np, "split", lambda a, at, f=L.np.split: held.append(f(a, at)) or held[-1])
    assert [b.to_pydict() for b in L._label(model, ["text"])(iter([batch]))] == whole
    assert len(held[-1]) > 2

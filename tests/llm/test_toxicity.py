import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.llm import toxicity as X
from loreweave.llm.queries import queries
from tests.llm import cases


def _brute(scores):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""
    best = max(((sum(scores[a:b]), -a, -(b - a)) for a, b in itertools.combinations(range(len(scores) + 1), 2)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[1]
    # of equal totals the shortest counts
    b = min(b for b in range(a + 1, len(scores) + 1) if abs(sum(scores[a:b]) - best[0]) < 1e-9)
    return [*_brute(scores[:a]), (a, b), *[(x + b, y + b) for x, y in _brute(scores[b:])]]


def test_segments_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice([b"baddd", b"worse", b"fine"]) for _ in range(rng.randrange(0, 14))]
        value = {b"baddd": 2.013, b"worse": 3.107}
        found = X.maximal_segments(value, -1.0, words, X.heads_of(value))
        assert [(a, b) for a, b, _ in found] == _brute([value.get(w, -1.0) for w in words])
        assert all(abs(s - sum(value.get(w, -1.0) for w in words[a:b])) < 1e-9 for a, b, s in found)


def _corpus(spark):
    rng = np.random.default_rng(3)
    clean = lambda: " ".join(cases.word(1000 + k) for k in rng.integers(0, 300, 60))
    rows = [(i, f"{clean()} Idiot, {clean()} scum! {clean()} lowlife{cases.word(i)}" if i % 4 == 0 else clean()) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")


def test_learns_words_and_stems(spark):
    docs, labels = _corpus(spark)
    model = X.train(docs, labels, F.col("doc_id") < 300)
    assert {b"idiot", b"scum", b"lowl"} <= set(model.scores) and cases.word(1001).encode() not in model.scores
    out = {r.doc_id: r.score for r in X.score(docs.where("doc_id >= 300"), model, ["doc_id"]).collect()}
    assert all((s >= 0.7) == (i % 4 == 0) for i, s in out.items())
    found = X.passages(docs.where("doc_id = 300"), model).collect()
    assert found and "idiot" in found[0].passage and found[0].probability >= 0.7


def test_edge_cases(spark):
    docs, labels = _corpus(spark)
    model = X.train(docs, labels, F.lit(True))
    out = X.score(cases.frame(spark), model)
    assert out.count() == len(cases.ROWS) and "digest" in out.columns
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in out.collect() if not r.text} == {model.base}
    none = X.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert not none.scores and X.score(cases.empty(spark), none).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 5)], "doc_id long, toxic int")
    assert not X.train(docs, odd, F.lit(True)).scores


def test_learns_from_few_labels(spark):
    docs, labels = _corpus(spark)
    model = X.train(docs, labels, F.col("doc_id") < 40)  # ten toxic texts
    out = {r.doc_id: r.score for r in X.score(docs.where("doc_id >= 300"), model, ["doc_id"]).collect()}
    assert sum(s >= 0.7 for i, s in out.items() if i % 4 == 0) == 25
    assert sum(s >= 0.7 for i, s in out.items() if i % 4) == 0


@pytest.mark.parametrize("sf, least", [("sf0.01", 15), ("sf0.1", 130)])
def test_recall_of_toxic_texts(spark, sf, least):
    folder = f"/root/testdata/{sf}"
    if not Path(folder).exists():
        pytest.skip("the driver's tables are not here")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries()["op5_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    found, wrong, clean = (sum(f(r) for r in rows) for f in (lambda r: r.predicted and labels[r.doc_id] == 1, lambda r: r.predicted and labels[r.doc_id] == 0, lambda r: labels[r.doc_id] == 0))
    print(sf, found, wrong, clean)
    assert found >= least and wrong <= 0.01 * clean


def _likelihood(best, n, toxic, decay, size):
    model = X.ToxicityModel(decay=decay, size=size)
    p = [model.probability([s], int(k)) for s, k in zip(best, n, strict=True)]
    return sum(np.log(x if y else 1 - x) for x, y in zip(p, toxic, strict=True)) - 0.05 * (decay - 1) ** 2 - 0.005 * np.log(size) ** 2


def test_calibration_is_likeliest():
    rng = np.random.default_rng(4)
    toxic = (rng.random(400) < 0.4).astype(float)
    best, n = rng.gamma(2 + 3 * toxic, 1.0), rng.integers(20, 200, 400).astype(float)
    decay, size = X.fit_extreme_values(best, n, toxic)
    grid = [(decay * a, size * b) for a in (0.8, 0.95, 1.0, 1.05, 1.25) for b in (0.5, 0.8, 1.0, 1.25, 2.0)]
    assert _likelihood(best, n, toxic, decay, size) >= max(_likelihood(best, n, toxic, *at) for at in grid) - 1e-6


def test_scores_and_passages_match_brute_force(spark):
    docs, labels = _corpus(spark)
    model = X.train(docs, labels, F.lit(True))
    for r in X.score(docs, model).collect():
        words = X.words_of(r.text)
        value = [max((model.scores[u] for u in X.units(w) if u in model.scores), default=model.rest) for w in words]
        total = lambda a, b: sum(value[a:b])
        found = X.maximal_segments(model.scores, model.rest, words, X.heads_of(model.scores))
        odds = max((np.exp(model.decay * total(a, b)) for a, b, _ in found), default=0) / (model.size * len(words))
        assert r.score == pytest.approx(odds / (1 + odds) if found else model.base)
        single = [(a, b - 1) for a, b, _ in found if 1 / (1 + model.size * len(words) * np.exp(-model.decay * total(a, b))) >= 0.7]
        assert [(p.first_word, p.last_word) for p in r.passages] == single


def test_unspaced_scripts():
    assert X.words_of("你好 World") == ["你".encode(), "好".encode(), b"world"]

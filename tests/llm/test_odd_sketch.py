import random
from fractions import Fraction

import numpy as np
import pytest

from loreweave.llm import ngram_join, odd_sketch
from tests.llm import cases


def shingle_set(text):
    ws = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def plain_components(rows, num=85, den=100):
    """doc_id, n_shingles, component_id and kept by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    out = []
    for k, (d, _) in enumerate(rows):
        c = least.get(root(k)) if sets[k] else d
        out.append((d, len(sets[k]), c, d == c))
    return sorted(map(str, out))


def edited(text, share, seed):
    rng = random.Random(seed)
    ws = text.split()
    return " ".join(w if rng.random() > share else cases.word(rng.randrange(4000)) for w in ws)


def near_copies():
    rows = []
    for g in range(12):  # groups around a text, with edits that keep some pairs above the threshold and some below
        base = cases.words(60 + 40 * g, 1000 + g)
        rows += [(100 * g + 10_000 + k, edited(base, 0.004 * (k % 9), 50 * g + k)) for k in range(14)]
    chain = cases.words(200, 77).split()
    rows += [(30_000 + k, " ".join(chain[k * 4 :] + [cases.word(5000 + x) for x in range(4 * k)])) for k in range(30)]  # each is near the next only
    rows += [(40_000, "Some OTHER words That Differ in case"), (40_001, "some other\twords that  differ in CASE"), (40_002, "short one"), (40_003, "Short\nONE"), (40_004, "short one more")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_components_match_all_pairs(spark, monkeypatch, small):
    if small:  # many parts, meetings and blocks
        for name in ("PART", "GROUP", "BLOCK"):
            monkeypatch.setattr(odd_sketch, name, 3)
    rows = [(r[0], r[1]) for r in cases.ROWS] + near_copies()
    docs = spark.createDataFrame([cases.row(*r) for r in rows], cases.SCHEMA)
    out = odd_sketch.components(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = plain_components(rows)
    assert sorted(str(tuple(r)) for r in out) == want
    if not small:
        got = odd_sketch.components(docs, Fraction(1, 2)).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(str(tuple(r)) for r in got) == plain_components(rows, 1, 2)


def test_sketches_estimate_similarity():
    samples, rng = odd_sketch.Samples(), np.random.default_rng(0)
    bound = odd_sketch.most_bits(0.85)
    off = []
    for k in range(200):
        base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        other = base.copy()
        d = k % 60
        other[:d] = rng.integers(0, 1 << 63, d, dtype=np.uint64)
        true = (600 - d) / (600 + d)
        bits = int(np.bitwise_count((samples.sign(base)[1] ^ samples.sign(other)[1]).view(np.uint64)).sum())
        off.append(odd_sketch.similarity(bits) - true)
        assert true < 0.85 or bits <= bound
    assert np.sqrt(np.mean(np.square(off))) < 0.03 and odd_sketch.recall(0.85) > 1 - 1e-7
    assert odd_sketch.similarity(odd_sketch.most_bits(0.85)) > 0.6 and odd_sketch.most_bits(1.0) == 0


def test_empty_table(spark):
    assert odd_sketch.components(cases.empty(spark)).count() == 0
    assert ngram_join.SHINGLE == 5

from collections import Counter

import pytest

from loreweave.llm import mixing as M
from tests.llm import cases


def _targets(sizes, share=1.5, weights=(5, 2, 1)):
    """Reshares the excess again and again. sizes: source -> size, null sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if now[s] > 2 * sizes[s]]
        if not over:
            return fixed | now
        for s in over:
            fixed[s] = 2 * sizes[s]
            left -= fixed[s]


def _docs(spark, n=300):
    rows = [cases.row(i, cases.words(5 + (i * 37) % 90, i), "en", [None, "a", "b", "c", "d", "é", "Z"][i % 7]) for i in range(n)]
    return spark.createDataFrame(rows, cases.SCHEMA)


def test_targets_rates_and_copies(spark):
    rows = M.mix(_docs(spark)).collect()
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 2 * r.size and 0 <= r.rate <= 2
    assert target == pytest.approx(_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    balanced = Counter()
    for r in rows:
        balanced[r.source] += r.rate * r.size
    assert balanced == pytest.approx(target, rel=1e-6)


def test_rates_are_tilted_exponentially(spark):
    import math

    rows = [r for r in M.mix(_docs(spark)).collect() if 0 < r.rate < 1.999]
    for source in {r.source for r in rows}:
        slopes = [math.log(r.rate) / r.size for r in rows if r.source == source]
        assert max(slopes) - min(slopes) < 1e-6


def test_reruns_agree(spark):
    a, b = (Counter((r.doc_id, r.rate, r.taken) for r in M.mix(_docs(spark).repartition(n)).collect()) for n in (1, 5))
    assert a == b


def test_edge_cases(spark):
    out = M.mix(cases.frame(spark)).collect()
    assert len(out) == len(cases.ROWS)
    assert all(r.taken == 0 for r in out if r.size == 0)
    assert M.mix(cases.empty(spark)).count() == 0
    assert {r.taken for r in M.mix(cases.frame(spark).where("doc_id in (2, 3)")).collect()} == {0}

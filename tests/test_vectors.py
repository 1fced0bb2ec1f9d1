"""Nearest vectors against brute force."""

import math

import numpy as np
import pytest

from loreweave.operators import retrieval, vectors


def plain_nearest(held, asked, k, grouped):
    """held: doc, vector, group; asked: query, vector, group. The k nearest by comparing all."""
    good = lambda v: v is not None and len(v) and None not in v and any(v) and all(map(math.isfinite, v))
    out = []
    for q, qv, qg in asked:
        if not good(qv) or grouped and qg is None:
            continue
        scored = []
        for d, v, g in held:
            if good(v) and len(v) == len(qv) and (not grouped or g == qg):
                scored.append((-round(float(np.dot(v, qv) / (np.linalg.norm(v) * np.linalg.norm(qv) + 1e-9)), 9), d))
        out += [(q, d, n) for n, (_, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows(n=300, groups=3, width=6):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, width)) * 4
    held = [(i, (middle[i % 12] + rng.normal(size=width)).tolist(), "hot" if i % 4 else f"g{i % groups}") for i in range(n)]
    held += [(900, None, "hot"), (901, [0.0] * width, "hot"), (902, [math.nan] + [1.0] * (width - 1), "hot"), (903, [math.inf] * width, "hot"), (904, [1.0, 2.0], "hot"), (905, held[3][1], "hot"), (906, held[3][1], None), (907, [], "hot"), (908, [None, 1.0], "hot")]
    asked = [(1000 + i, held[i][1], held[i][2]) for i in range(0, 60, 2)] + [(2000, None, "hot"), (2001, [0.0] * width, "hot"), (2002, [1.0, 1.0], "hot"), (2003, held[1][1], "none"), (2004, [math.nan] * width, "hot"), (2005, held[1][1], None)]
    return held, asked


@pytest.fixture(scope="module")
def frames(spark):
    held, asked = rows()
    return spark.createDataFrame(held, "doc long, vector array<double>, g string"), spark.createDataFrame(asked, "query long, vector array<double>, g string")


def got(df):
    return sorted((r.query, r.doc, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block", [None, 16])
def test_nearest_in_groups(frames, monkeypatch, block):
    if block:
        monkeypatch.setattr(vectors, "VECTORS", block)
        monkeypatch.setattr(vectors, "QUERIES", block // 2)
    held, asked = rows()
    assert got(vectors.nearest(*frames, 5, "g")) == plain_nearest(held, asked, 5, True)
    assert got(vectors.nearest(*frames, 5)) == plain_nearest(held, asked, 5, False)
    names = vectors.nearest(frames[0].selectExpr("concat('d', doc) AS doc", "vector", "g"), frames[1].selectExpr("concat('q', query) AS query", "vector", "g"), 1, "g")
    assert {(r.query, r.doc) for r in names.collect()} == {(f"q{q}", f"d{d}") for q, d, _ in plain_nearest([(f"{d}", v, g) for d, v, g in held], asked, 1, True)}


def test_many_queries_meet_in_blocks(frames):
    held, asked = rows()
    assert got(retrieval.vector_top_k(*frames, 4, batch=3)) == got(retrieval.vector_top_k(*frames, 4)) == plain_nearest(held, asked, 4, False)


@pytest.mark.parametrize("centres", [1, 12, 40])
def test_cells_are_exact(frames, centres):
    held, asked = rows()
    cells = vectors.build_cells(frames[0], centres)
    assert cells.rows.count() == sum(len(v or []) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, _ in held)
    assert got(vectors.nearest_in_cells(cells, frames[1], 7)) == plain_nearest(held, asked, 7, False)


def test_cells_are_skipped(frames):
    cells = vectors.build_cells(frames[0], 12)
    bounds = vectors.reach(cells, frames[1].where("query = 1000")).collect()
    best = vectors.nearest_in_cells(cells, frames[1].where("query = 1000"), 3).agg({"score": "min"}).first()[0]
    assert sum(r.bound < best for r in bounds) >= len(bounds) / 2


def test_empty_tables(frames):
    held, asked = frames
    assert vectors.nearest(held.where("false"), asked, 3, "g").count() == 0 and vectors.nearest(held, asked.where("false"), 3).count() == 0
    assert vectors.nearest_in_cells(vectors.build_cells(held.where("false")), asked, 3).count() == 0

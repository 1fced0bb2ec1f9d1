"""Nearest vectors, exactly: inside groups by blocks of queries times blocks of vectors, and from cells around centres.

Vectors and queries that are null, empty, zero or not finite have no hits; vectors of another length than a query's neither.
Scores are cosines rounded to SCORE_DIGITS decimals; equal ones are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreweave.operators.index import SCORE_DIGITS
from loreweave.operators.shuffles import join_unique, shared_folder, stored

#: Vectors and queries that meet in a task.
VECTORS, QUERIES = 8192, 2048
#: Centres at most, and rows that they are fitted to.
CENTRES, FITTED = 1024, 65_536
#: How far a rounded angle may be off.
SLACK = 1e-6


def finite(vector: str = "vector") -> Column:
    """Whether a vector has a direction: numbers only, not all zero."""
    x = F.col(vector)
    return x.isNotNull() & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False)) & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))


def _best(pairs: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each column the rows of its k largest values, equal ones by id."""
    return [np.lexsort([ids, -pairs[:, q]])[:k] for q in range(pairs.shape[1])]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """query, doc, score, rank: the k nearest of vectors (doc, vector, by) to each of queries (query, vector, by) in the same group.

    A group's queries and vectors are dealt to blocks and every two blocks meet in one task, as a product of matrices, so neither
    a large group nor many queries are one task's or the driver's; a meeting gives k rows for each of its queries. Without
    `by` all are one group. Ids may be of any type.
    """
    group = F.lit(0) if by is None else F.col(by)
    # a null group's rows meet nothing
    v = vectors.where(finite() & group.isNotNull()).select(group.alias("g"), "doc", F.col("vector").cast("array<double>").alias("vector"))
    q = queries.where(finite() & group.isNotNull()).select(group.alias("g"), "query", F.col("vector").cast("array<double>").alias("vector"))
    counts = v.groupBy("g").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("vb")).join(q.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qb")), "g")
    counts = stored(counts, "vector-blocks")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    types = {"query": q.schema["query"].dataType, "doc": v.schema["doc"].dataType}
    held = join_unique(v, counts, "g", v.count()).select("g", every("qb").alias("i"), block("doc", "vb").alias("j"), F.lit(None).cast(types["query"]).alias("query"), "doc", "vector")
    asked = join_unique(q, counts, "g", q.count()).select("g", block("query", "qb").alias("i"), every("vb").alias("j"), "query", F.lit(None).cast(types["doc"]).alias("doc"), "vector")
    schema = f"query {types['query'].simpleString()}, doc {types['doc'].simpleString()}, score double"
    tasks = held.unionByName(asked)
    return _top(tasks.groupBy("g", "i", "j").applyInArrow(_in_meeting(k), schema), k)


def _in_meeting(k: int):
    """A meeting's rows: those with a query are asked, the others held. Arrow keeps ids of every type as they are."""
    def run(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("query").is_valid())
        lengths = np.array(table.column("vector").combine_chunks().value_lengths())
        out = []
        for width in np.unique(lengths):
            rows = [np.flatnonzero((lengths == width) & side) for side in (is_query, ~is_query)]
            if not len(rows[0]) or not len(rows[1]):
                continue
            q, v = (np.array(table.column("vector").take(pa.array(r)).combine_chunks().flatten()).reshape(len(r), width) for r in rows)
            scores = np.round(v @ q.T / (np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)) + 1e-9), SCORE_DIGITS)
            docs = table.column("doc").take(pa.array(rows[1])).combine_chunks()
            order = np.argsort(np.array(docs.to_pylist(), dtype=object), kind="stable")  # places by id
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            best = _best(scores, rank, k)
            queries = table.column("query").take(pa.array(np.repeat(rows[0], [len(b) for b in best]))).combine_chunks()
            out.append(pa.table({"query": queries, "doc": docs.take(pa.array(np.concatenate(best))), "score": np.concatenate([scores[b, c] for c, b in enumerate(best)])}))
        if not out:
            return pa.table({"query": table.column("query").slice(0, 0), "doc": table.column("doc").slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.concat_tables(out)

    return run


def _top(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Cells:
    """rows: cell, doc, vector, written by cell; bounds: cell, n and radius (the largest angle to its centre); centres of each vector length."""

    rows: DataFrame
    bounds: DataFrame
    centres: dict[int, np.ndarray]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _assigned(centres: dict[int, np.ndarray]):
    """Rows with their cell, the nearest centre's number among those of the vector's length, and the angle to it."""
    first = dict(zip(centres, np.cumsum([0, *map(len, centres.values())])[:-1].tolist(), strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, same in pdf.groupby(pdf["vector"].map(len)):
                if width in centres:
                    near = np.clip(_unit(np.stack(same["vector"].to_numpy()).astype(float)) @ centres[width].T, -1, 1)
                    at = near.argmax(axis=1)
                    yield same.assign(cell=first[width] + at, angle=np.arccos(near[np.arange(len(at)), at]))

    return run


def build_cells(vectors: DataFrame, centres: int | None = None, path: str | None = None) -> Cells:
    """vectors (doc, vector) dealt to cells around centres, written by cell.

    Centres are vectors that a hash of their ids picks, moved twice to the middle of what is nearest among FITTED
    vectors at most, so they hold a bounded sample; every vector is in a cell, and cells are exact bounds wherever centres lie.
    """
    spark = vectors.sparkSession
    known = vectors.where(finite()).select("doc", F.col("vector").cast("array<double>").alias("vector"))
    total = known.count()
    wanted = centres or min(CENTRES, max(1, int(total**0.5)))
    rate = FITTED / max(1, total)
    by_hash = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.withColumn("u", by_hash).where(F.col("u") < rate).orderBy("u").limit(FITTED)
    sample = [np.array(r["vector"]) for r in picked.select("vector").collect()]
    fitted = {}
    for width in sorted({len(v) for v in sample} | {r[0] for r in known.select(F.size("vector")).distinct().limit(64).collect()}):
        own = [v for v in sample if len(v) == width] or [np.eye(1, width)[0]]
        m = _unit(np.array(own))
        c = m[:wanted]
        for _ in range(2):
            at = (m @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, at, m)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), c)
        fitted[width] = c
    schema = f"doc {known.schema['doc'].dataType.simpleString()}, vector array<double>, cell long, angle double"
    path = path or shared_folder(spark, "vector-cells")
    known.mapInPandas(_assigned(fitted), schema).repartition("cell").sortWithinPartitions("cell").write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    return Cells(rows, stored(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")), "vector-bounds"), fitted)


def _reach(centres: dict[int, np.ndarray], bounds: list[tuple[int, int, float]]):
    """For each query and cell the largest cosine that one of the cell's vectors can have: that of the angle to its centre less its radius."""
    first = dict(zip(centres, np.cumsum([0, *map(len, centres.values())])[:-1].tolist(), strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, same in pdf.groupby(pdf["vector"].map(len)):
                if width not in centres:
                    continue
                mine = [b for b in bounds if first[width] <= b[0] < first[width] + len(centres[width])]
                if not mine:
                    continue
                cell, n, radius = (np.array(x) for x in zip(*mine, strict=True))
                angle = np.arccos(np.clip(_unit(np.stack(same["vector"].to_numpy()).astype(float)) @ centres[width][cell - first[width]].T, -1, 1))
                best = np.cos(np.maximum(0, angle - radius - SLACK)) + SLACK
                yield pd.DataFrame({"query": np.repeat(same["query"].to_numpy(), len(cell)), "cell": np.tile(cell, len(same)), "n": np.tile(n, len(same)), "bound": best.ravel()})

    return run


def reach(cells: Cells, queries: DataFrame) -> DataFrame:
    """query, cell, n, bound: what the triangle inequality of angles says of every cell (CENTRES for each length of vectors at most)."""
    asked = queries.where(finite()).select("query", F.col("vector").cast("array<double>").alias("vector"))
    bounds = [tuple(r) for r in cells.bounds.select("cell", "n", "radius").collect()]
    return asked.mapInPandas(_reach(cells.centres, bounds), f"query {asked.schema['query'].dataType.simpleString()}, cell long, n long, bound double")


def nearest_in_cells(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """query, doc, score, rank as nearest() gives them: cells whose bound is highest first, until they hold k vectors, then those that can still reach the k-th score."""
    asked = queries.where(finite()).select("query", F.col("vector").cast("array<double>").alias("vector"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("query").orderBy(F.desc("bound"), "cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ordered = stored(reach(cells, queries).withColumn("first", before < k), "vector-reach")

    def of_cells(chosen: DataFrame) -> DataFrame:
        rows = chosen.select("query", "cell").join(asked, "query")
        # a cell's queries and vectors meet in blocks; a query has k rows for each of its cells
        pairs = rows.select(F.struct("query", "cell").alias("query"), "vector", "cell")
        held = cells.rows.join(F.broadcast(chosen.select("cell").distinct()), "cell", "left_semi").select("cell", "doc", "vector")
        return nearest(held, pairs, k, "cell").select("query.query", "doc", "score")

    head = stored(of_cells(ordered.where("first")), "vector-head")
    least = _top(head, k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = ordered.where("not first").join(least, "query").where(F.col("bound") >= F.coalesce("least", F.lit(-2.0)))
    return _top(head.unionByName(of_cells(rest)), k)

"""Mixing sources to target weights by entropy balancing.

Each source gets a target of tokens. Among all document rates between 0 and MOST copies that give each
source its target, those of least relative entropy to one copy each are exp(lambda_s * size / mean size),
cut at MOST; lambda_s solves the convex dual, by Newton steps that Spark takes for all sources at once, with
gradients and Hessians summed over all documents. Rates become copies, whose tokens miss the target by about a document's size at most:
documents of one source and size share a rate, so an error is carried along from the largest size to the
smallest, and inside a size a hash of the document decides who gets the last copies.

Defined results: a null or empty text has size 0 and is taken 0 times its size; null is a source like any
other and comes last; repeated rows count as documents of their own, equal ones in no defined order; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loreweave.llm.common import stored

#: Copies of a document at most, and tokens of a source at most, as a multiple of what there is.
MOST = 2
LOG_MOST = math.log(MOST)
#: Groups that the documents of one source and size are dealt to.
DEALT = 64
WORD = r"[^\x20\x09-\x0D]+"


def with_targets(sources: DataFrame, share: float, weights: tuple[int, ...]) -> DataFrame:
    """sources (key, source, source_size) with the target of each.

    Sources in code-point order, null last, take the weights in turn. A target stops at MOST times the
    source's size and the excess is shared by weight among the others: all targets are the smaller of that
    limit and one level times the weight. One row for each source goes through each window.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights) + 1))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    prior, whole = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    limited = weighed.withColumn("limit", F.col("source_size") * float(MOST))
    left = lambda c: F.sum(c).over(whole) - F.coalesce(F.sum(c).over(prior), F.lit(0.0))
    total = share * F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("limit").over(prior), F.lit(0.0))) / left("weight")
    at = limited.withColumn("level", level).withColumn("open", F.col("limit") >= F.col("level") * F.col("weight"))
    found = at.withColumn("level", F.min_by("level", F.when(F.col("open"), F.col("limit") / F.col("weight"))).over(whole))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return found.select("key", "source", "source_size", target.alias("target"))


def _tilt(x: Column) -> Column:
    return x * F.col("size") / F.col("mean")


def _rate(x: Column) -> Column:
    """Copies of a document; infinite multipliers stand for all or nothing."""
    return F.when(x == float("inf"), float(MOST)).when(x == float("-inf"), 0.0).otherwise(F.exp(F.least(_tilt(x), F.lit(LOG_MOST))))


def solve_dual(cells: DataFrame, sources: DataFrame, rounds: int = 200, close: float = 1e-10) -> DataFrame:
    """sources (key, source_size, docs, target) with mean, a document's mean size, and x, the multiplier.

    cells: key, size, docs. Newton steps, held inside a bracket that each gradient's sign narrows. A round is one
    join of the cells with the multipliers that are still sought and a row for each source; the driver learns
    only how many are left. Gradients are sums of decimals, so that they don't depend on a shuffle's order.
    """
    size, inf = F.col("source_size"), F.lit(float("inf"))
    nothing, everything = F.col("target") <= 0, F.col("target") >= MOST * size * (1 - 1e-12)
    begun = sources.select(
        "key", "source_size", "docs", "target", (size / F.col("docs")).alias("mean"), F.when(nothing, -inf).when(everything, inf).otherwise(0.0).alias("x"),
        (-inf).alias("lo"), inf.alias("hi"), (nothing | everything).alias("done"),
    )
    state = stored(begun, "mix-multipliers")
    share = F.col("cell_docs") * F.col("size") / size * F.exp(F.least(_tilt(F.col("x")), F.lit(LOG_MOST)))
    exact = lambda c: F.sum(c.cast("decimal(28,18)")).cast("double")
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            return state.select("key", "source_size", "target", "mean", "x")
        at = cells.withColumnRenamed("docs", "cell_docs").join(state.where("not done"), "key")
        sums = at.groupBy("key").agg(exact(share).alias("g"), exact(F.when(_tilt(F.col("x")) < LOG_MOST, share * F.col("size") / F.col("mean")).otherwise(0.0)).alias("h"))
        x, gap = F.col("x"), F.col("g") - F.col("target") / size
        found = (F.abs(gap) <= close * F.col("target") / size) | (F.col("hi") - F.col("lo") < 1e-13 * F.greatest(F.lit(1.0), F.abs(x)))
        narrowed = state.join(sums, "key", "left").withColumns({
            "gap": gap, "done": F.col("done") | found,
            "lo": F.when(~F.col("done") & (gap < 0), x).otherwise(F.col("lo")), "hi": F.when(~F.col("done") & (gap >= 0), x).otherwise(F.col("hi")),
        })
        newton = x - F.col("gap") / F.when(F.col("h") > 0, F.col("h"))
        bounded = (F.col("lo") > -inf) & (F.col("hi") < inf)
        other = F.when(bounded, (F.col("lo") + F.col("hi")) / 2).otherwise(2 * x + F.when(F.col("gap") < 0, 1.0).otherwise(-1.0))
        step = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(other)
        state = stored(narrowed.withColumn("x", F.when(F.col("done"), x).otherwise(step)).select(state.columns), "mix-multipliers")
    raise RuntimeError(f"the multipliers did not settle in {rounds} rounds")


def _round(cells: pd.DataFrame) -> pd.DataFrame:
    """The copies that all documents of each size get together, for one source."""
    cells = cells.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
    size, docs, ideal = (cells[c].to_numpy(float) for c in ("size", "docs", "ideal"))
    copies, owed = np.zeros(len(cells), np.int64), 0.0
    for i in range(len(cells)):
        if size[i] <= 0:
            continue
        owed += ideal[i] * size[i]
        copies[i] = int(min(MOST * docs[i], max(0, np.floor(owed / size[i] + 0.5))))
        owed -= copies[i] * size[i]
    return cells.assign(copies=copies)[["key", "size", "docs", "copies"]]


def mix(documents: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every document (doc_id, text, source)."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    spread = F.xxhash64(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    docs = stored(documents.select("doc_id", "source", key.alias("key"), size.alias("size"), spread.alias("spread"), F.pmod(spread, F.lit(DEALT)).cast("int").alias("dealt")), "mix-sizes")
    dealt = stored(docs.groupBy("key", "source", "size", "dealt").agg(F.count("*").alias("docs")), "mix-cells")
    cells = dealt.groupBy("key", "size").agg(F.sum("docs").alias("docs"))
    totals = dealt.groupBy("key", "source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"), F.sum("docs").alias("docs"))
    targets = stored(with_targets(totals.drop("docs"), share, weights).join(totals.select("key", "docs"), "key"), "mix-targets")
    solved = solve_dual(cells, targets)
    ideal = cells.join(solved.select("key", "mean", "x"), "key").select("key", "size", "docs", (_rate(F.col("x")) * F.col("docs")).alias("ideal"))
    # a source's sizes are as many as there are lengths of texts, however many documents it has
    copies = ideal.groupBy("key").applyInPandas(_round, "key string, size long, docs long, copies long")
    # the first `copies mod docs` documents of a size by dealt, spread get one copy more
    before = F.sum("docs").over(W.partitionBy("key", "size").orderBy("dealt").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.select("key", "size", "dealt", F.coalesce(before, F.lit(0)).alias("offset"))
    plan = offsets.join(copies, ["key", "size"]).select("key", "size", "dealt", "offset", F.floor(F.col("copies") / F.col("docs")).alias("all"), (F.col("copies") % F.col("docs")).alias("more"))
    place = F.col("offset") + F.row_number().over(W.partitionBy("key", "size", "dealt").orderBy("spread", "doc_id")) - 1
    placed = docs.join(plan, ["key", "size", "dealt"]).withColumn("copies", (F.col("all") + (place < F.col("more")).cast("long")).cast("long"))
    out = placed.join(solved.withColumnRenamed("key", "solved_key"), F.col("key") == F.col("solved_key"))
    return out.select("doc_id", "source", "size", "source_size", "target", _rate(F.col("x")).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))

"""Facts in time: what holds at a moment, what a newer fact supersedes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreweave.operators.shuffles import stored


def active(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("expired_at").isNull())


def holds_at(t: Column, bitemporal: bool = False) -> Column:
    """valid_at <= t < invalid_at with open nulls; expired facts never, or until they expired if bitemporal."""
    gone = F.col("expired_at").isNull() | (F.col("expired_at") > t) if bitemporal else F.col("expired_at").isNull()
    return gone & (F.col("valid_at").isNull() | (F.col("valid_at") <= t)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def as_of(facts: DataFrame, t: Column, bitemporal: bool = False) -> DataFrame:
    return facts.where(holds_at(t, bitemporal))


def as_of_join(probes: DataFrame, facts: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """Each probe with the fact of its keys that began last at or before its time, or nulls.

    Probes and facts meet in one sort by key and time: a running last fact, no pairs.
    """
    columns = [c for c in facts.columns if c not in keys]
    extra = [c for c in probes.columns if c not in keys]
    left = probes.select(*keys, *extra, F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.lit(None).cast(facts.select(F.struct(*columns)).schema[0].dataType).alias("_fact"))
    right = facts.select(*keys, *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra], F.col("valid_at").alias("_t"), F.lit(0).alias("_probe"), F.struct(*columns).alias("_fact"))
    order = W.partitionBy(*keys).orderBy("_t", "_probe").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("_fact", ignorenulls=True).over(order)
    return left.unionByName(right).withColumn("_last", last).where("_probe = 1").select(*keys, *extra, *[F.col(f"_last.{c}").alias(c if c not in extra else f"fact_{c}") for c in columns])


#: Where an interval ends that has no end, as a number: beyond all times.
OPEN = 1 << 62
#: Facts of a key up to which probes meet all of them.
PLAIN = 64


def holding_join(probes: DataFrame, facts: DataFrame, keys: list[str], at: str = "at", start: str = "valid_at", end: str = "invalid_at") -> DataFrame:
    """Each probe with every fact of its keys that holds at its time: start <= at < end, a null start or end is open.

    Probes meet all facts of keys that have PLAIN facts at most: each probe is shuffled once. For keys with more, times lie on grids
    whose cells are 1, 2, 4, ... microseconds wide. A fact is laid on the grid whose cells are at least as wide as its time is long, so it touches two cells at most; a probe looks in one cell of each grid that some fact lies on.
    Both meet by an equi-join on keys, grid and cell, and each pair once, without comparing all facts of a key.
    Open bounds are drawn in to the probes' first and last time. Probes without a time, and null keys, meet nothing.
    Columns of facts that probes have too come as fact_<name>.
    """
    own = [c for c in facts.columns if c not in keys]
    named = {c: f"fact_{c}" if c in probes.columns else c for c in own}
    many = stored(facts.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > PLAIN).select(*keys).dropna(), "many-facts")
    dense = bool(many.take(1))
    few = lambda df: df.join(many, keys, "left_anti") if dense else df
    began, ends = F.col("_start").isNull() | (F.col("_start") <= F.col(at)), F.col("_end").isNull() | (F.col(at) < F.col("_end"))
    known = facts.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), *[F.col(c).alias(named[c]) for c in own])
    met = few(probes.where(F.col(at).isNotNull())).join(few(known), keys).where(began & ends).select(*probes.columns, *named.values())
    if not dense:
        return met
    return met.unionByName(_holding_on_grids(probes.join(many, keys, "left_semi"), facts.join(many, keys, "left_semi"), keys, at, start, end, named))


def _holding_on_grids(probes: DataFrame, facts: DataFrame, keys: list[str], at: str, start: str, end: str, named: dict[str, str]) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = probes.where(F.col(at).isNotNull()).withColumn("_t", micros(at))
    first, last = asked.agg(F.min("_t"), F.max("_t")).first()
    first, last = (0, -1) if first is None else (first, last)
    low = F.greatest(F.coalesce(micros(start), F.lit(first)), F.lit(first))
    high = F.least(F.coalesce(micros(end), F.lit(OPEN)), F.lit(last + 1))
    laid = facts.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).where("_low < _high")
    level = F.length(F.bin(F.col("_high") - F.col("_low"))).cast("int")
    cells = F.array_distinct(F.array(F.expr("shiftright(_low, _level)"), F.expr("shiftright(_high - 1, _level)")))
    placed = laid.withColumn("_level", level).withColumn("_cell", F.explode(cells)).select(*keys, "_level", "_cell", "_low", "_high", *[F.col(c).alias(n) for c, n in named.items()])
    levels = [r[0] for r in laid.select(level).distinct().collect()]  # 63 at most
    looking = asked.withColumn("_level", F.explode(F.lit(levels) if levels else F.array().cast("array<int>"))).withColumn("_cell", F.expr("shiftright(_t, _level)"))
    return looking.join(placed, [*keys, "_level", "_cell"]).where("_low <= _t and _t < _high").select(*probes.columns, *named.values())


def supersede(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Each fact ends where the next of its keys begins, unless it ended before."""
    following = F.lead("valid_at").over(W.partitionBy(*keys).orderBy("valid_at", "uuid"))
    return facts.withColumn("invalid_at", F.least(F.coalesce("invalid_at", following), F.coalesce(following, "invalid_at")))


def invalidate(facts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Facts of ids (uuid) that aren't expired end and expire now."""
    marked = facts.join(ids.select("uuid").distinct().withColumn("_hit", F.lit(True)), "uuid", "left")
    hit = F.col("_hit") & F.col("expired_at").isNull()
    return marked.withColumns({"invalid_at": F.when(hit, now).otherwise(F.col("invalid_at")), "expired_at": F.when(hit, now).otherwise(F.col("expired_at"))}).drop("_hit")

"""Tables in the shared folder, joins with hot keys, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that one task may hold whatever their key.
SMALL = 20_000


#: Rows of a join beyond which neither side is sent to the driver to be broadcast.
LARGE = 200_000
#: Rows of a partition, about, where a task holds all of its rows.
PARTITION_ROWS = 2_000_000


def dealt(df: DataFrame, total: int, *keys: str) -> DataFrame:
    """df by keys in as many partitions as its total rows need, and in those of the session at least: what a task holds doesn't grow with the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_ROWS)), *keys)


def unsent(df: DataFrame, total: int) -> DataFrame:
    """df for a join of `total` rows: a large one is shuffled, also where Spark takes df for small enough to go through the driver to all executors."""
    return df.hint("merge") if total > LARGE else df


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Where that is unset a temporary one is set if driver
    and executors are one process (as in tests), else it is an error: executors can't read the driver's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="loreweave-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder: later reads don't recompute them."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_unique(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, whose key is unique, without bringing a hot key's rows to one task.

    Keys with over a thousandth of left's total rows are a thousand at most, so their rows of right are
    broadcast; all other keys are joined through a shuffle, always so beyond LARGE rows. Null keys match nothing. Tables of SMALL rows
    are joined at once: no key of theirs is hot.
    """
    if total <= SMALL:
        return left.join(right, key, how)
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(1000, total / 1000)).select(key)
    hot_right = right.join(F.broadcast(hot), key, "left_semi")
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = flagged.where(F.col("_hot").isNull()).drop("_hot").join(unsent(right, total), key, how)
    warm = flagged.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot_right), key, how)
    return warm.select(cold.columns).unionByName(cold)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node and component (its smallest node) of every node in edges (a, b).

    Large stars and small stars in turn, each a minimum per node and a join: rounds grow with the
    logarithm of the nodes. Loops, repeated edges and rows with nulls change nothing. Rounds are written
    to the shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = join_unique(both, least, "a", 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "components")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_unique(large, lower, "a", before[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "components")
        after = print_of(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    inner = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

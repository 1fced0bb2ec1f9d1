"""Changes written where they belong: groups that a change touches, and tables laid out by id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import ingest
from loreweave.operators.shuffles import shared_folder, stored

#: Groups that are named in a filter, so that only their folders are listed and read; more are found by a join.
NAMED = 1_000
#: Tasks that write a group's rows, at most: a large group isn't one task's, a small one isn't scattered over all.
FILES = 16


def upsert_groups(spark: SparkSession, name: str, changes: DataFrame, key: str = "uuid", immutable: tuple[str, ...] = ("group_id",), order: str | None = None) -> None:
    """Writes changes by key to a catalog table that is partitioned by group_id: only groups that have a change are rewritten.

    Rows as `ingest.upsert` gives them. A known row stays in its group whatever group the change names. Changes may lack columns (vectors
    only, say): known rows keep theirs, new rows have nulls. Changes of equal keys: the last by `order`. The groups of changed rows are found from ids alone.
    """
    _immutable_group(immutable)
    now = spark.table(name)
    changes = stored(changes, "changes")  # read for its groups and its rows
    placed = changes.select(key, "group_id").join(now.select(key, F.col("group_id").alias("_old"), F.lit(True).alias("_known")), key, "left")
    touched = _list_of(placed.select(F.when(F.col("_known"), F.col("_old")).otherwise(F.col("group_id")).alias("group_id")), "changed-groups")
    rows = ingest.upsert(_of_groups(now, touched), changes, key, immutable, order)
    _overwrite(spark, name, rows)


def delete_rows(spark: SparkSession, name: str, ids: DataFrame, key: str = "uuid") -> None:
    """Removes the rows of ids (key) from a catalog table that is partitioned by group_id; groups left empty go, others stay as they are."""
    now = spark.table(name)
    gone = stored(ids.select(key).distinct(), "deleted")
    touched = _list_of(now.select(key, "group_id").join(gone, key, "left_semi").select("group_id"), "changed-groups")
    left = ingest.delete(_of_groups(now, touched), gone, key)
    emptied = stored(touched.join(left.select(F.col("group_id").alias("_left")).distinct(), F.col("group_id").eqNullSafe(F.col("_left")), "left_anti"), "emptied")
    _overwrite(spark, name, left)
    for row in emptied.toLocalIterator():  # a statement for each folder that goes, never rows
        value = "NULL" if row.group_id is None else "'" + row.group_id.replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (group_id = {value})")
    spark.catalog.refreshTable(name)


def _immutable_group(immutable: tuple[str, ...]) -> None:
    if "group_id" not in immutable:
        raise ValueError("group_id places a row and can't be changed: delete the row and add it anew")


def _list_of(groups: DataFrame, label: str) -> DataFrame:
    return stored(groups.distinct(), label)


def _of_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """df's rows of groups. Few groups are named, so that other folders aren't read; the rows are the same for many."""
    some = [r.group_id for r in groups.limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        known = F.col("group_id").isin([g for g in some if g is not None])
        return df.where(known | F.col("group_id").isNull() if None in some else known)
    wanted = groups.select(F.col("group_id").alias("_group"))
    return df.join(wanted, F.col("group_id").eqNullSafe(F.col("_group")), "left_semi")


def _overwrite(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Replaces the groups that rows have; others keep their files. A group is written by the tasks that have its rows."""
    rows = stored(rows.select(spark.table(name).columns), "rewritten")  # what is replaced isn't read any more
    setting, mode = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set(setting, "dynamic")  # insertInto doesn't take it as an option
    try:
        rows.repartition("group_id", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(FILES))).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(setting, mode)
    spark.catalog.refreshTable(name)


def bucketed(df: DataFrame, key: str = "uuid", buckets: int | None = None, name: str | None = None) -> str:
    """The name of a new catalog table with df's rows in buckets by key, sorted by it, in the shared folder.

    Reading by an id opens one bucket; joins of two such tables by id, and counts by id, need no exchange.
    Rows without a key are kept, in the bucket of null.
    """
    spark = df.sparkSession
    name = name or f"by_{key}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(buckets, key)  # one file for each bucket
    spread.write.bucketBy(buckets, key).sortBy(key).option("path", shared_folder(spark, name)).saveAsTable(name)
    return name


def get_one(spark: SparkSession, name: str, value, key: str = "uuid") -> DataFrame:
    """The rows of an id: one bucket is read."""
    return spark.table(name).where(F.col(key) == F.lit(value))


def get_many(spark: SparkSession, name: str, ids: DataFrame, key: str = "uuid") -> DataFrame:
    """The rows of ids (key, repeated or not): the table isn't shuffled, the ids come to its buckets. The merge hint keeps ids of any number from a broadcast."""
    return spark.table(name).hint("merge").join(ids.select(key), key, "left_semi")

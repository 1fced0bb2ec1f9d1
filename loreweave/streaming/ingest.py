"""Continuous ingestion: each episode once, facts superseded in time order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loreweave.operators.shuffles import shared_folder


def read_folder(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once_each(stream: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Each key once, as far as its copies come within `late`."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """How many rows of each group fall into each window; rows later than `late` don't count."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


#: Parts that a stream's known facts are dealt to by their keys' hash: a batch reads the parts of its keys only.
PARTS = 16


def supersessions(stream: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Facts (keys, uuid, valid_at) of a stream with the time at which the next of their keys ends them, as a table of what is there now.

    The state is every fact so far, a table that each micro-batch adds its new ones to. A batch's facts are put in order with
    the known ones of their keys, so a fact may come late: it ends where the next known one begins, and the one before it now
    ends at it. What changes, new facts and the ends of known ones right before them, is written under the batch's number,
    and the last change of a fact counts. A fact that comes again (same keys, uuid, valid_at) counts once; null
    keys are a key like any other. Nothing is rewritten but a batch's own folders, when it is run again.
    """
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, "stream-supersede")
    columns = [*keys, "uuid", "valid_at"]
    facts = stream.select(columns)
    schema = StructType([*facts.schema, StructField("invalid_at", facts.schema["valid_at"].dataType)])
    key = F.struct(*[F.col(k).isNull() for k in keys], *keys)
    same = lambda a, b, by: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in by))
    spark.createDataFrame([], schema).write.parquet(f"{path}/changes/batch=-1")
    spark.createDataFrame([], facts.schema).write.parquet(f"{path}/facts/batch=-1/part=0")

    def advance(batch: DataFrame, number: int) -> None:
        came = f"{path}/came/{number}"
        batch.distinct().withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).write.mode("overwrite").parquet(came)
        new = spark.read.parquet(came)
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # PARTS at most
        known = spark.read.schema(StructType([*facts.schema, StructField("batch", LongType()), StructField("part", LongType())])).parquet(f"{path}/facts")
        known = known.where((F.col("batch") < number) & F.col("part").isin(touched))
        of_keys = new.select(*keys).distinct()
        known = known.join(of_keys, same(known, of_keys, keys), "left_semi").select(columns)
        fresh = new.join(known, same(new, known, columns), "left_anti").select(columns)
        by = W.partitionBy(key).orderBy("valid_at", "uuid")
        ordered = fresh.withColumn("new", F.lit(True)).unionByName(known.withColumn("new", F.lit(False)))
        changed = ordered.withColumns({"invalid_at": F.lead("valid_at").over(by), "before_new": F.coalesce(F.lead("new").over(by), F.lit(False))})
        changed.where("new or before_new").select(schema.names).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        fresh.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/facts/batch={number}")

    query = facts.writeStream.foreachBatch(advance).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(f"{path}/changes")
    last = changes.groupBy(*columns).agg(F.max(F.struct("batch", "invalid_at")).alias("x"))
    return last.where("x.invalid_at is not null").select(*columns, F.col("x.invalid_at").alias("invalid_at"))


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = shared_folder(spark, label)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_updates(stream: DataFrame, label: str, key: list[str]) -> DataFrame:
    """What an aggregating stream gives for all that is there now, groups that are still open too: the last value of each key.

    A batch writes the groups that it changed; a batch that is run again overwrites itself.
    """
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, label)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{path}/rows")
    values = [c for c in stream.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*key, "x.*")

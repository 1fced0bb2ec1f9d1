"""Cleans and mixes the documents in five stages, each written as Parquet and read again by the next.

The stages run one after the other on the same executors, whose memory keeps what the earlier ones touched; so each
has its rows handed to Python workers in small batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import decontamination, language_id, mixing, ngram_join, toxicity
from loreweave.llm.common import by_place, remainder, small_batches, stored

#: No SQL expresses the trained stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the network gives to no language go; where it is sure, its label replaces the given one.

    It rejects texts without a letter (null and empty ones too) and those whose score is below half of what the
    doubtful hundredth of rightly read held-out rows has. A language with more than half of a text's pooled
    probability becomes its `lang`, also where that is null. Rows are judged one by one, whatever their length: ties, repeated rows and rows without an id like
    any other. Without a row to learn from nothing is rejected, without a held-out one no text with a letter;
    an empty table stays empty; further columns of any name are carried along.
    """
    small_batches(spark)
    held_out = remainder("doc_id", 4) == 2
    model = language_id.train(docs, F.coalesce(~held_out, F.lit(False)))
    if model is None:
        return docs
    limit = language_id.least_score(docs, held_out, model)
    numbered, names = by_place(docs, "text")
    named = language_id.identify(numbered, model)
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") >= limit))
    sure = kept.withColumn(names["lang"], F.when(F.col("score") > 0.5, F.col("lang_pred")).otherwise(F.col(names["lang"])))
    return sure.select(list(names.values())).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a toxicity score of 0.7 or more go.

    Null and empty texts have the score of texts without a toxic segment and stay. Rows are judged one by one, whole
    texts of any length; repeated rows and rows without an id like any other. Without labels of both classes
    nothing goes; an empty table stays empty; further columns of any name are carried along.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    numbered, names = by_place(docs, "text")
    return toxicity.score(numbered, model).where("score < 0.7").select(list(names.values())).toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, one row of it.

    Of equal rows one stays, of rows with equal texts and no id one; texts without words (null and empty ones too) all
    stay. Texts of any length are compared whole; an empty table stays empty; further columns of any name are
    carried along.
    """
    small_batches(spark)
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item, at a score of a half or more, go.

    Null and empty texts hold none and stay, as all do if there is no item. A text of any length is searched whole, and
    all rows of an equal text go together; an empty table stays empty; further columns of any name are carried
    along.
    """
    small_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each remaining document.

    A null or empty text has size 0 and nothing is taken of it; null is a source like any other and comes last; repeated
    rows are documents of their own; reruns agree; an empty table gives no rows; further columns are ignored.
    """
    small_batches(spark)
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", decontaminate),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Counts by group, canonical group names, recent and weak rows, rows still to be extracted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The sources of migrated episodes, and words of texts worth extracting first.
MIGRATED = ("migration", "migration-local", "failures-md", "migrate-user-md")
SKIPPED = ("migration", "migration-local")
KEYWORDS = ("端口", "配置", "决策", "部署", "修复", "网关", "记忆", "搜索", "模型")


def group_stats(episodes: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Episodes, entities and facts (all and active) of each group: one shuffle over tagged counts."""
    tagged = [
        episodes.select("group_id", F.lit("episodes").alias("kind"), F.lit(False).alias("active")),
        entities.select("group_id", F.lit("entities").alias("kind"), F.lit(False).alias("active")),
        facts.select("group_id", F.lit("facts").alias("kind"), F.col("expired_at").isNull().alias("active")),
    ]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy("group_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("episodes", "entities", "facts")], F.count_if("active").alias("active_facts"))


def canonical_groups(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (group_id) with canonical: the smallest known group that differs in case only, else itself."""
    known = groups.select("group_id").distinct().groupBy(F.lower("group_id").alias("k")).agg(F.min("group_id").alias("found"))
    return wanted.join(known, F.lower(wanted.group_id) == known.k, "left").select(wanted.group_id, F.coalesce("found", wanted.group_id).alias("canonical"))


def in_group(df: DataFrame, group: str | None) -> DataFrame:
    """The rows of a group; all of them for none, '' and 'all'."""
    return df if group in (None, "", "all") else df.where(F.col("group_id") == group)


def recent(df: DataFrame, n: int, *order: Column | str, by: str = "group_id") -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def not_mentioned(episodes: DataFrame, mentions: DataFrame) -> DataFrame:
    return episodes.join(mentions, episodes.uuid == mentions.episode_uuid, "left_anti")


def backfill(episodes: DataFrame, mentions: DataFrame, strategy: str | None, limit: int, now: Column, window_days: int | None = None, migrated: tuple = MIGRATED, skipped: tuple = SKIPPED, keywords: tuple = KEYWORDS) -> DataFrame:
    """Episodes that still have no mentions, in the order in which a strategy extracts them.

    migration_all: migrated ones, short first; migration_quality: long migrated ones with a keyword, new
    first; else all but the skipped sources, new first, within window_days if given.
    """
    newest, ties = F.desc_nulls_last("created_at"), F.asc("uuid")
    if strategy == "migration_all":
        chosen, order = episodes.where(F.col("source").isin(*migrated)), [F.length("content"), ties]
    elif strategy == "migration_quality":
        any_word = reduce(lambda a, b: a | b, [F.col("content").ilike(f"%{k}%") for k in keywords])
        chosen, order = episodes.where(F.col("source").isin(*migrated) & (F.length("content") > 200) & any_word), [newest, ties]
    else:
        chosen, order = episodes.where(~F.col("source").isin(*skipped)), [newest, ties]
        if window_days:
            chosen = chosen.where(F.col("created_at") > now - F.make_dt_interval(F.lit(window_days)))
    return not_mentioned(chosen, mentions).orderBy(*order).limit(limit)


def reflection_window(episodes: DataFrame, now: Column, days: int = 7, excluded: tuple = (*SKIPPED, "reflection"), newest: int = 30, least: int = 3) -> DataFrame:
    """The newest episodes of each group within days, for groups that have `least` of them."""
    inside = episodes.where((F.col("created_at") > now - F.make_dt_interval(F.lit(days))) & ~F.col("source").isin(*excluded))
    top = recent(inside, newest, F.desc("created_at"), F.asc("uuid"))
    return top.withColumn("_all", F.count("*").over(W.partitionBy("group_id"))).where(F.col("_all") >= least).drop("_all")


def weak_facts(facts: DataFrame, shorter_than: int = 20) -> DataFrame:
    return facts.where(F.col("expired_at").isNull() & (F.length("fact") < shorter_than))


def newest_facts(facts: DataFrame, n: int = 60, order: str = "reference_time") -> DataFrame:
    """The n active facts of each group that came last."""
    return recent(facts.where(F.col("expired_at").isNull()), n, F.desc_nulls_last(order), F.asc("uuid"))

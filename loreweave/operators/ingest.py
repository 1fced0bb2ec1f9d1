"""Changes of tables as new tables: upserts, deletes, resolution of entities and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.functions.vector import cosine


def upsert(target: DataFrame, changes: DataFrame, key: str, immutable: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """target with the changes by key: the last change by `order` wins, immutable columns and those that changes lack stay as they were."""
    if order:
        # maps can't be compared: ties are broken by all columns as text
        ties = F.to_json(F.struct(*[c for c in changes.columns if c != key]))
        latest = first_seen(changes, [key], F.desc(order), ties.desc())
    else:
        latest = first_seen(changes, [key], F.to_json(F.struct(*[c for c in changes.columns if c != key])).desc()) if changes.columns != [key] else changes.distinct()
    old = target.select(F.col(key), F.struct(*[c for c in target.columns if c != key]).alias("_old"))
    given = [c for c in target.columns if c != key and c in changes.columns]
    new = latest.select(F.col(key), F.struct(F.lit(True).alias("_is"), *given).alias("_new"))
    joined = old.join(new, key, "full_outer")
    fresh = F.col("_new").isNotNull()
    value = lambda c: F.when(fresh & (F.lit(c not in immutable) | F.col("_old").isNull()), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) if c in given else F.col(f"_old.{c}")
    return joined.select(*[F.col(key) if c == key else value(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return target.unionByName(rows.dropDuplicates(key).join(target, key, "left_anti").select(target.columns))


def delete(target: DataFrame, ids: DataFrame, key: str = "uuid") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def forget_episodes(ids: DataFrame, episodes: DataFrame, facts: DataFrame, mentions: DataFrame, vectors: DataFrame, prune: bool = False) -> dict[str, DataFrame]:
    """All tables without the episodes of ids (uuid), and without facts that come from one of them alone.

    A fact with more episodes keeps the removed id among them, unless prune.
    """
    gone = ids.select("uuid").distinct()
    alone = facts.where(F.size("episodes") == 1).select(F.col("uuid").alias("fact_id"), F.col("episodes")[0].alias("uuid")).join(gone, "uuid").select(F.col("fact_id").alias("uuid"))
    left = delete(facts, alone)
    if prune:
        used = left.select(F.col("uuid").alias("fact_id"), F.posexplode("episodes").alias("at", "uuid")).join(gone, "uuid", "left_anti").groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "uuid"))), lambda x: x["uuid"]).alias("_left"))
        left = left.join(used, left.uuid == used.fact_id, "left").withColumn("episodes", F.coalesce("_left", "episodes")).select(facts.columns)
    return {
        "episodes": delete(episodes, gone),
        "facts": left,
        "mentions": mentions.join(gone.withColumnRenamed("uuid", "episode_uuid"), "episode_uuid", "left_anti"),
        "embeddings": delete(vectors, gone.unionByName(alone)),
    }


def resolve_entities(items: DataFrame, entities: DataFrame, vectors: DataFrame | None = None, least: float = 0.72) -> DataFrame:
    """items (item, name, group_id[, vector]) with uuid, layer and same_as; ids of any type that can be ordered.

    In turn: the same name, the same normal name, the same letters and digits, the nearest vector of a
    similarity of `least` or more (of equally near ones the smallest id). What remains is new (uuid null):
    same_as is the first new item of its group with that normal name, so that a new entity comes once for each
    of these. Names that are null, empty or without a letter or digit are new each by themselves.
    """
    keyed = entities.select("group_id", "uuid", "name", T.norm_name("name").alias("norm"), T.alnum_only("name").alias("alnum"))
    todo, done = items.withColumns({"norm": T.norm_name("name"), "alnum": T.alnum_only("name")}), None
    resolved = lambda df, layer: df.select("item", "name", "group_id", "uuid", F.lit(layer).alias("layer"), F.lit(None).cast(items.schema["item"].dataType).alias("same_as"))
    for key in ("name", "norm", "alnum"):
        known = keyed.where(F.col(key) != "").groupBy("group_id", key).agg(F.min("uuid").alias("uuid"))
        hit = resolved(todo.join(known, ["group_id", key]), key)
        done = hit if done is None else done.unionByName(hit)
        todo = todo.join(known, ["group_id", key], "left_anti")
    if vectors is not None and "vector" in items.columns:
        near = todo.join(vectors.select("group_id", "uuid", F.col("vector").alias("other")), "group_id").withColumn("s", cosine(F.col("vector"), F.col("other"))).where(F.col("s") >= least)
        best = near.groupBy("item").agg(F.min_by("uuid", F.struct(-F.col("s"), "uuid")).alias("uuid"))
        done = done.unionByName(resolved(todo.join(best, "item"), "vector"))
        todo = todo.join(best, "item", "left_anti")
    heads = todo.where("norm <> ''").groupBy("group_id", "norm").agg(F.min("item").alias("same_as"))
    fresh = todo.join(heads, ["group_id", "norm"], "left").withColumn("same_as", F.coalesce("same_as", "item"))
    return done.unionByName(fresh.select("item", "name", "group_id", F.lit(None).cast(entities.schema["uuid"].dataType).alias("uuid"), F.lit("new").alias("layer"), "same_as"))


def of_types(items: DataFrame, types: tuple[str, ...], column: str = "entity_type") -> DataFrame:
    """Extracted items of a listed type."""
    return items.where(F.col(column).isin(*types))


def with_ends(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Extracted facts (source_name, target_name, ...) with source_uuid and target_uuid of resolved (name, uuid); others go."""
    known = resolved.where("uuid is not null").groupBy("name").agg(F.min("uuid").alias("uuid"))
    ends = [known.select(F.col("name").alias(f"{end}_name"), F.col("uuid").alias(f"{end}_uuid")) for end in ("source", "target")]
    return facts.join(ends[0], "source_name").join(ends[1], "target_name")


def remove_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """links without the given ones (a_uuid, b_uuid in any order)."""
    ends = [F.least("a_uuid", "b_uuid").alias("a_uuid"), F.greatest("a_uuid", "b_uuid").alias("b_uuid")]
    return links.join(pairs.select(*ends).distinct(), ["a_uuid", "b_uuid"], "left_anti").select(links.columns)


def resolve_facts(items: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (episode, source_uuid, target_uuid, fact, group_id) that repeat an active fact of the same ends, and new ones.

    Repeats come as uuid and episode, to be added to the fact's episodes. New ones once for each text.
    """
    keys = ["group_id", "source_uuid", "target_uuid", "norm"]
    known = facts.where("expired_at is null").withColumn("norm", T.norm_name("fact")).groupBy(*keys).agg(F.min("uuid").alias("uuid"))
    asked = items.where("source_uuid is not null and target_uuid is not null and fact <> ''").withColumn("norm", T.norm_name("fact"))
    repeats = asked.join(known, keys).select("uuid", "episode").distinct()
    fresh = asked.join(known, keys, "left_anti").groupBy(*keys).agg(F.min("fact").alias("fact"), F.array_sort(F.collect_set("episode")).alias("episodes"))
    return repeats, fresh.drop("norm")


def add_episodes(facts: DataFrame, repeats: DataFrame) -> DataFrame:
    more = repeats.groupBy("uuid").agg(F.array_sort(F.collect_set("episode")).alias("_more"))
    return facts.join(more, "uuid", "left").withColumn("episodes", F.array_union("episodes", F.coalesce("_more", F.array().cast(facts.schema["episodes"].dataType)))).select(facts.columns)


def first_seen(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")

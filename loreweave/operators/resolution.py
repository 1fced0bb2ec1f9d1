"""Entities in order of arrival: an item is an entity that is known, or one that an earlier item brought."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions import rules
from loreweave.functions import text as T
from loreweave.operators.shuffles import stored


def _keys(name: str):
    """Forms of a name of which two names that a rule makes one share one at least (rules without a similarity)."""
    form = lambda kind, value, when=None: F.struct(F.lit(kind).alias("kind"), (value if when is None else F.when(when, value)).alias("key"))
    every = F.array(form(1, T.norm_name(name)), form(2, T.alnum_only(name)), form(3, T.norm_path(name), T.is_path(name)), form(4, T.without_www(name), T.is_domain(name)))
    return F.explode(F.filter(every, lambda x: x["key"].isNotNull() & ((x["key"] != "") | (x["kind"] == 3))))


def resolve_in_order(items: DataFrame, entities: DataFrame, max_rounds: int = 200) -> DataFrame:
    """item, name, group_id, uuid and same_as of items (item, name, group_id), which come in order of item.

    The pool of a group is its entities (uuid, name, group_id) by uuid and then every item that became new, in order. An
    item is the first of the pool that a rule makes one with it: its uuid, or for one that an item brought same_as, that item. If
    there is none, the item is new: same_as is itself. Blank names are nothing: both are null.

    Only different names of a group meet, where they share a form that rules look at. Who is new depends on earlier
    items: in each round an item is settled whose first possible match is settled, so rounds grow with the longest chain of
    names that match the next but not the one after, not with the items.
    """
    known = entities.select("group_id", T.trimmed("name").alias("name"), "uuid", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(0).alias("kind"))
    came = items.select("group_id", T.trimmed("name").alias("name"), F.lit(None).cast(entities.schema["uuid"].dataType).alias("uuid"), "item", F.lit(1).alias("kind")).where("name <> ''")
    place = F.struct("kind", "uuid", "item")
    first = known.unionByName(came).groupBy("group_id", "name").agg(F.min(place).alias("place"))
    names = stored(first.withColumn("n", F.monotonically_increasing_id()), "resolution-names")
    keyed = names.select("n", "name", "group_id", "place", _keys("name").alias("x")).select("n", "name", "group_id", "place", "x.kind", "x.key")
    later = keyed.where("place.kind = 1").select("group_id", "kind", "key", F.col("n").alias("t"), F.col("name").alias("t_name"), F.col("place").alias("t_place"))
    met = later.join(keyed.withColumnsRenamed({"n": "r", "name": "r_name", "place": "r_place"}), ["group_id", "kind", "key"]).where("r_place < t_place")
    one = rules.auto_merge(F.col("t_name"), F.col("r_name"), F.lit(None).cast("double"))["auto_merge"]
    edges = stored(met.select("t", "r", "t_name", "r_name", "r_place").distinct().where(one).select("t", "r", "r_place"), "resolution-edges")

    # settled: n, target (null: it is of the pool itself)
    settled = stored(names.where("place.kind = 0").select("n", F.lit(None).cast("long").alias("target")), "resolution-settled")
    waiting = stored(names.where("place.kind = 1").select("n"), "resolution-waiting")
    for _ in range(max_rounds):
        if waiting.isEmpty():
            break
        state = edges.join(waiting.withColumnRenamed("n", "t"), "t", "left_semi").join(settled.select(F.col("n").alias("r"), "target", F.lit(True).alias("done")), "r", "left")
        # those that are someone else are not of the pool
        best = state.where("done is null or target is null").groupBy("t").agg(F.min(F.struct("r_place", F.col("done").isNotNull().alias("ready"), "r")).alias("x"))
        told = stored(waiting.join(best.withColumnRenamed("t", "n"), "n", "left").select("n", "x.r", F.coalesce("x.ready", F.lit(True)).alias("ready")), "resolution-round")
        settled = stored(settled.unionByName(told.where("ready").select("n", F.col("r").alias("target"))), "resolution-settled")
        waiting = told.where("not ready").select("n")
    else:
        raise RuntimeError(f"items are not settled after {max_rounds} rounds")
    heads = settled.select("n", F.coalesce("target", "n").alias("head")).join(names.select(F.col("n").alias("head"), "place"), "head").select("n", "place.uuid", F.col("place.item").alias("same_as"))
    found = names.select("group_id", F.col("name").alias("_name"), "n").join(heads, "n").drop("n").withColumnsRenamed({"group_id": "_group"})
    same = items.group_id.eqNullSafe(F.col("_group")) & T.trimmed(items.name).eqNullSafe(F.col("_name"))
    out = items.join(found, same, "left")
    # names without a letter, digit or path are like no other name, not even an equal one
    own = rules.auto_merge(F.col("name"), F.col("name"), F.lit(None).cast("double"))["auto_merge"]
    alone = ~own & (T.trimmed("name") != "")
    return out.select("item", "name", "group_id", F.when(~alone, F.col("uuid")).alias("uuid"), F.when(alone, F.col("item")).otherwise(F.col("same_as")).alias("same_as"))

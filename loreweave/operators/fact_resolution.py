"""Facts that come in against facts that are known: when they hold, which known ones to ask about, what answers change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreweave.functions import time as D
from loreweave.operators.shuffles import join_unique, stored

#: Fixed value: known facts at one of a new fact's ends that are asked about.
TOUCHING = 12


def dated(items: DataFrame) -> DataFrame:
    """items (fact, valid_at, invalid_at, reference_time, ...) with both times settled, of reference_time's type.

    The beginning is the given one, else the first date in the fact's text, else reference_time. The end is the given
    one, else the second of two dates that the text joins to a range, else open. Times may be text; what can't be read is not given.
    """
    to = items.schema["reference_time"].dataType
    given = lambda c: (D.parse_time(c) if items.schema[c].dataType.typeName() == "string" else F.col(c)).cast(to)
    said = items.withColumn("_said", D.dates_in_text("fact"))
    times = {"valid_at": F.coalesce(given("valid_at"), F.col("_said.start").cast(to), F.col("reference_time")), "invalid_at": F.coalesce(given("invalid_at"), F.col("_said.end").cast(to))}
    return said.withColumns(times).select(items.columns)


def touching(items: DataFrame, facts: DataFrame, most: int = TOUCHING) -> DataFrame:
    """item, uuid and position: active facts of an item's group at one of its ends that could be contradicted.

    The source's come first, then the target's, each by uuid, `most` of them in all; facts between the same two ends in the same
    direction are not among them (all of those are asked about, see `related`). Items and facts with a null end or group have none.

    For each entity at most `most` facts of each of the `most` + 1 pairs of ends with the smallest ids are kept, before any
    item meets them: whichever pair an item leaves out, the first `most` of the others are there. So an entity that very many facts
    or items share is one short list, and hot entities are joined without bringing their items to one task.
    """
    ends = ["source_uuid", "target_uuid"]
    known = facts.where("expired_at is null").dropna(subset=["group_id", *ends])
    pair = W.partitionBy("group_id", *ends).orderBy("uuid")
    first = known.select("uuid", "group_id", *ends).withColumn("_n", F.row_number().over(pair)).where(F.col("_n") <= most)
    at = first.withColumn("entity", F.explode(F.array_distinct(F.array(*ends))))
    pairs = at.groupBy("group_id", "entity", *ends).agg(F.array_sort(F.collect_list("uuid")).alias("uuids"), F.min("uuid").alias("least"))
    chosen = pairs.withColumn("_n", F.row_number().over(W.partitionBy("group_id", "entity").orderBy("least"))).where(F.col("_n") <= most + 1)
    rows = chosen.select(_key("group_id", "entity").alias("_key"), F.explode("uuids").alias("uuid"), *ends)
    lists = stored(rows.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("uuid", *ends))).alias("_facts")), "touching")
    asked = items.dropna(subset=["group_id", *ends]).select("item", "group_id", *ends)
    wanted = stored(asked.select("*", F.posexplode(F.array(*ends)).alias("side", "entity")).withColumn("_key", _key("group_id", "entity")), "touching-items")
    met = join_unique(wanted, lists, "_key", wanted.count())
    same = lambda x: (x["source_uuid"] == F.col("source_uuid")) & (x["target_uuid"] == F.col("target_uuid"))
    cut = met.select("item", "side", F.slice(F.filter("_facts", lambda x: ~same(x)), 1, most)["uuid"].alias("uuids"))
    sides = F.transform(F.array_sort(F.collect_list(F.struct("side", "uuids"))), lambda x: x["uuids"])
    merged = cut.groupBy("item").agg(F.slice(F.array_distinct(F.flatten(sides)), 1, most).alias("uuids"))
    return merged.select("item", F.posexplode("uuids").alias("position", "uuid"))


def related(items: DataFrame, facts: DataFrame) -> DataFrame:
    """item and the number of active facts between its ends: those facts are reached by an equi-join on group and ends."""
    keys = ["group_id", "source_uuid", "target_uuid"]
    counts = facts.where("expired_at is null").groupBy(*keys).agg(F.count("*").alias("n"))
    asked = items.dropna(subset=keys).select("item", _key(*keys).alias("_key"))
    return join_unique(asked, counts.dropna(subset=keys).select(_key(*keys).alias("_key"), "n"), "_key", asked.count()).select("item", "n")


def apply_decisions(items: DataFrame, facts: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """facts after items (item, episode and the columns of facts but episodes and expired_at) with the answers about them.

    decisions (item, uuid, verdict, position) say of known facts that they are a `duplicate` of an item or a `contradiction` to
    it; those about facts that are unknown, expired or of another group, and duplicates between other ends, count for nothing.

    An item with duplicates is the first of them by position and uuid, which gets its episode and, if that is new to it, its
    reference time. Any other becomes a fact of its own. Of facts that contradict it, if one begins later than the item's
    fact, that fact ends there (at the first of these by position) and is expired; else all of them end where it begins and are
    expired. A fact without a beginning contradicts and ends nothing. Where several items end one fact the first item does: the
    fact is expired for later ones. Repeated decisions are one. An empty table of decisions only adds the items.
    """
    whole = lambda p, *c: F.struct(*c).alias(p)
    mine = items.select("item", whole("x", "group_id", "source_uuid", "target_uuid", "valid_at", "episode", "reference_time"))
    theirs = facts.where("expired_at is null").select("uuid", whole("f", "group_id", "source_uuid", "target_uuid", "valid_at", "episodes"))
    told = decisions.select("item", "uuid", "verdict", "position")
    total = told.count()
    asked = join_unique(join_unique(told, theirs, "uuid", total), mine, "item", total).where("x.group_id = f.group_id")
    asked = stored(asked, "fact-decisions")
    place = F.struct("position", "uuid")
    of_pair = "verdict = 'duplicate' and x.source_uuid = f.source_uuid and x.target_uuid = f.target_uuid"
    same = asked.where(of_pair).groupBy("item").agg(F.min_by(F.struct("uuid", "f.valid_at", F.array_contains("f.episodes", F.col("x.episode")).alias("known"), "x.episode", "x.reference_time"), place).alias("is"))
    same = stored(same, "fact-duplicates")

    against = join_unique(asked.where("verdict = 'contradiction'"), same, "item", total, "left").where("is.uuid is null or is.uuid <> uuid")
    begins = F.when(F.col("is.uuid").isNotNull(), F.col("is.valid_at")).otherwise(F.col("x.valid_at"))
    against = against.select("item", "uuid", "position", F.col("is.uuid").alias("own"), F.col("f.valid_at").alias("theirs"), begins.alias("begins")).where("begins is not null")
    late = F.col("theirs") > F.col("begins")
    newer = against.where(late).groupBy("item").agg(F.min_by("theirs", place).alias("until"), F.min("own").alias("own"))
    newer = stored(newer, "fact-newer")
    closed = join_unique(against, newer.select("item", "until"), "item", total, "left").where("until is null").select("uuid", "item", F.col("begins").alias("until"))
    closed = closed.unionByName(newer.where("own is not null").select(F.col("own").alias("uuid"), "item", "until"))
    ends = closed.groupBy("uuid").agg(F.min_by("until", F.struct("item", "until")).alias("_until"))

    fresh = F.when(~F.col("is.known"), F.struct("item", "is.reference_time"))
    more = same.groupBy(F.col("is.uuid").alias("uuid")).agg(F.array_sort(F.collect_set("is.episode")).alias("_more"), F.max(fresh).alias("_ref"))
    after = facts.join(ends, "uuid", "left").join(more, "uuid", "left")
    none = F.array().cast(facts.schema["episodes"].dataType)
    moment = now.cast(facts.schema["expired_at"].dataType)
    changed = {
        "invalid_at": F.coalesce("_until", "invalid_at"), "expired_at": F.when(F.col("_until").isNotNull(), moment).otherwise(F.col("expired_at")),
        "episodes": F.array_union(F.coalesce("episodes", none), F.coalesce("_more", none)), "reference_time": F.coalesce("_ref.reference_time", "reference_time"),
    }
    brought = items.join(same.select("item"), "item", "left_anti").join(newer.select("item", "until"), "item", "left")
    gone = F.col("until").isNotNull()
    own = {"invalid_at": F.coalesce("until", "invalid_at"), "expired_at": F.when(gone, moment), "episodes": F.array("episode")}
    return after.withColumns(changed).select(facts.columns).unionByName(brought.withColumns(own).select(facts.columns))


def _key(*columns: str) -> Column:
    """One column for several without null, whatever their values hold."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))

"""Facts that are resolved, merges that go on, tables written by group or laid out by id, tolerant JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import json as J
from loreweave.functions import text as T
from loreweave.operators import dedup
from loreweave.operators import fact_resolution as R
from loreweave.operators.shuffles import shared_folder
from loreweave.plans.governance import NORM_SQL
from loreweave.plans.registry import Registry
from loreweave.sources import writes
from loreweave.sources.tables import parts_as_entities, table

PLANS = Registry()

#: Orders as facts between a customer and a status, priority a predicate: even ones are known, odd ones come in.
KNOWN_SQL = """known AS (SELECT o_orderkey AS uuid, o_custkey AS s, o_orderstatus AS t, o_orderpriority AS p, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS valid_at FROM orders WHERE o_orderkey % 2 = 0),
came AS (SELECT o_orderkey AS item, o_custkey AS s, o_orderstatus AS t, o_orderpriority AS p, CASE WHEN o_orderkey % 3 = 2 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS valid_at FROM orders WHERE o_orderkey % 2 = 1)"""


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    time = orders.schema["o_orderdate"].dataType
    own = [F.col("o_orderkey").alias("uuid"), F.col("o_orderpriority").alias("name"), F.lit("all").alias("group_id"), F.col("o_custkey").cast("string").alias("source_uuid"), F.col("o_orderstatus").alias("target_uuid")]
    began, none = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")), F.lit(None).cast(time)
    known = orders.where("o_orderkey % 2 = 0").select(*own, F.lit("").alias("fact"), F.array("o_orderkey").alias("episodes"), began.alias("valid_at"), none.alias("invalid_at"), none.alias("expired_at"), began.alias("reference_time"))
    third = F.col("o_orderkey") % 3
    day = F.date_format("o_orderdate", "自yyyy年M月d日")
    text, given = F.when(third == 0, day).otherwise(F.lit("")), F.when(third == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    heard = F.when(third == 2, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate") + F.expr("INTERVAL 9 DAY"))
    came = orders.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("episode"), *own, text.alias("fact"), given.alias("valid_at"), F.lit(None).cast("string").alias("invalid_at"), heard.alias("reference_time"))
    return R.dated(came), known


@PLANS.add(f"""WITH {KNOWN_SQL}, d AS (SELECT item, k.uuid, k.s = c.s AND k.t = c.t AS same, k.valid_at AS theirs, c.valid_at AS mine FROM came c JOIN known k ON k.s = c.s AND k.p = c.p),
dup AS (SELECT item, min(uuid) AS own, arg_min_null(theirs, uuid) AS own_at FROM d WHERE same GROUP BY item),
con AS (SELECT d.item, d.uuid, d.theirs, own, CASE WHEN own IS NULL THEN mine ELSE own_at END AS begins FROM d LEFT JOIN dup USING (item) WHERE NOT same),
newer AS (SELECT item, min(own) AS own, arg_min(theirs, uuid) AS until FROM con WHERE begins IS NOT NULL AND theirs > begins GROUP BY item),
ends AS (SELECT uuid, item, begins AS until FROM con WHERE begins IS NOT NULL AND item NOT IN (SELECT item FROM newer) UNION ALL SELECT own, item, until FROM newer WHERE own IS NOT NULL),
e AS (SELECT uuid, arg_min(until, item) AS until FROM ends GROUP BY uuid)
SELECT k.uuid, k.valid_at, e.until AS invalid_at, e.until IS NOT NULL AS expired, 1 + (SELECT count(*) FROM dup WHERE own = k.uuid) AS n_episodes FROM known k LEFT JOIN e USING (uuid)
UNION ALL SELECT c.item, c.valid_at, until, until IS NOT NULL, 1 FROM came c LEFT JOIN newer USING (item) WHERE c.item NOT IN (SELECT item FROM dup)""")
def facts_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after odd orders came in. Of a customer's orders of a priority, those of one status are duplicates, those of others contradict."""
    came, known = _facts(spark, sf_dir)
    near = came.select("item", "source_uuid", "name", F.col("target_uuid").alias("t")).join(known.select("uuid", "source_uuid", "name", "target_uuid"), ["source_uuid", "name"])
    answers = near.select("item", "uuid", F.when(F.col("t") == F.col("target_uuid"), "duplicate").otherwise("contradiction").alias("verdict"), F.lit(0).alias("position"))
    after = R.apply_decisions(came, known, answers, F.lit("2024-06-01"))
    return after.select("uuid", "valid_at", "invalid_at", F.col("expired_at").isNotNull().alias("expired"), F.size("episodes").cast("long").alias("n_episodes"))


@PLANS.add(f"""WITH {KNOWN_SQL}, m AS (SELECT item, uuid, 0 AS side FROM came c JOIN known k ON k.s = c.s AND k.t <> c.t UNION ALL
  SELECT item, uuid, 1 FROM came c JOIN (SELECT uuid, s, t FROM known QUALIFY row_number() OVER (PARTITION BY t ORDER BY uuid) <= 2000) k ON k.t = c.t AND k.s <> c.s QUALIFY row_number() OVER (PARTITION BY item ORDER BY uuid) <= 12),
r AS (SELECT item, uuid, row_number() OVER (PARTITION BY item ORDER BY side, uuid) - 1 AS position FROM m)
SELECT item, uuid, CAST(position AS INTEGER) AS position FROM r WHERE position < 12""")
def fact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known facts at an end of each new one. Three statuses are at an end of all facts. (The SQL looks at 2,000 of each: no customer has as many.)"""
    return R.touching(*_facts(spark, sf_dir))


@PLANS.add(f"""WITH k AS (SELECT p_partkey AS node, {NORM_SQL.format('p_name')} AS key FROM part)
SELECT node, min(node) OVER (PARTITION BY key) AS head FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1""")
def merges_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name, each merged into the one before it: every other pair first, the rest joined to the state of these."""
    from pyspark.sql import Window as W

    named = parts_as_entities(spark, sf_dir).select("uuid", T.norm_name("name").alias("key"))
    pairs = named.select(F.lag("uuid").over(W.partitionBy("key").orderBy("uuid")).alias("keep_uuid"), F.col("uuid").alias("remove_uuid")).dropna()
    first, _ = dedup.merge_state(pairs.where("remove_uuid % 2 = 0"))
    return dedup.merge_state(pairs.where("remove_uuid % 2 = 1"), first)[0].select("node", "head")


@PLANS.add("""SELECT p_partkey AS uuid, p_brand AS group_id, CASE WHEN p_partkey % 3 = 0 AND p_brand <= 'Brand#15' THEN upper(p_name) ELSE p_name END AS name, p_type AS summary FROM part
UNION ALL SELECT -1 - p_partkey, 'Brand#new', p_name, NULL FROM part WHERE p_partkey % 5 = 0""")
def groups_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand in a catalog table, after names of some brands changed and a new group came; other brands keep their files."""
    part = parts_as_entities(spark, sf_dir)
    name = f"parts_{uuid.uuid4().hex}"
    part.repartition("group_id").write.partitionBy("group_id").option("path", shared_folder(spark, name)).saveAsTable(name)
    changed = part.where("uuid % 3 = 0 and group_id <= 'Brand#15'").select("uuid", F.lit("elsewhere").alias("group_id"), F.upper("name").alias("name"))
    new = part.where("uuid % 5 = 0").select(-1 - F.col("uuid"), F.lit("Brand#new"), "name")
    writes.upsert_groups(spark, name, changed.union(new))
    return spark.table(name)


@PLANS.add("""SELECT o_orderkey, any_value(o_orderstatus) AS status, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def joined_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order, from two tables in buckets by order: neither the join nor the count has an exchange."""
    orders = writes.bucketed(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey")
    lines = writes.bucketed(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")
    return spark.table(orders).hint("merge").join(spark.table(lines), "o_orderkey").groupBy("o_orderkey").agg(F.any_value("status").alias("status"), F.count("*").alias("n_lines"))


@PLANS.add("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def many_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have a large line, by their ids."""
    orders = writes.bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return writes.get_many(spark, orders, ids, "o_orderkey")


PROPS = "CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN concat('[', props, ', 1]') ELSE props END"


@PLANS.add(f"""WITH e AS (SELECT event_id, {PROPS} AS p FROM events)
SELECT event_id, CASE WHEN p <> '' AND json_valid(p) AND json_type(p) = 'OBJECT' THEN p->>'$.k' END AS k, CASE WHEN p <> '' AND json_valid(p) AND json_type(p) = 'ARRAY' THEN 2 ELSE 0 END AS n_items,
  coalesce(p <> '' AND NOT json_valid(p), false) AS broken FROM e""")
def tolerant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, some cut short, empty, null or lists."""
    p = F.expr(PROPS)
    return table(spark, sf_dir, "events").select("event_id", J.json_map(p)["k"].alias("k"), F.size(J.json_list(p)).alias("n_items"), J.broken_json(p).alias("broken"))

"""Counts, scans, times: the relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.functions import time as D
from loreweave.operators import graph, stats, temporal
from loreweave.plans.registry import Registry
from loreweave.sources.tables import documents_as_episodes, orders_as_facts, parts_as_entities, table

PLANS = Registry()
#: The moment that stands for now, for orders and for events.
NOW_ORDERS, NOW_EVENTS = "TIMESTAMP_NTZ'1998-09-02 00:00:00'", "TIMESTAMP_NTZ'2024-01-31 00:00:00'"
FACTS_SQL = """facts AS (
  SELECT o_orderkey AS uuid, o_orderstatus AS name, o_orderstatus || ' ' || o_orderpriority AS fact, o_custkey AS source_uuid,
         CAST(c_nationkey AS BIGINT) AS target_uuid, c_mktsegment AS group_id, o_orderdate AS valid_at,
         lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS invalid_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS expired_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@PLANS.add(f"""WITH {FACTS_SQL},
u AS (SELECT source AS group_id, 1 AS e, 0 AS n, 0 AS f, 0 AS a FROM documents
      UNION ALL SELECT p_brand, 0, 1, 0, 0 FROM part
      UNION ALL SELECT group_id, 0, 0, 1, CASE WHEN expired_at IS NULL THEN 1 ELSE 0 END FROM facts)
SELECT group_id, CAST(sum(e) AS BIGINT) AS episodes, CAST(sum(n) AS BIGINT) AS entities, CAST(sum(f) AS BIGINT) AS facts, CAST(sum(a) AS BIGINT) AS active_facts
FROM u GROUP BY group_id""")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_stats(documents_as_episodes(spark, sf_dir), parts_as_entities(spark, sf_dir), orders_as_facts(spark, sf_dir))


@PLANS.add(f"""WITH {FACTS_SQL}
SELECT (SELECT count(*) FROM documents) AS episodes, (SELECT count(*) FROM part) AS entities, count(*) AS facts,
       count(*) FILTER (WHERE expired_at IS NULL) AS active_facts FROM facts""")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_group = stats.group_stats(documents_as_episodes(spark, sf_dir), parts_as_entities(spark, sf_dir), orders_as_facts(spark, sf_dir))
    return by_group.agg(*[F.sum(c).alias(c) for c in ("episodes", "entities", "facts", "active_facts")])


@PLANS.add("""SELECT event_id, user_id, event_type, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 5""")
def recent_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    from pyspark.sql import Window as W

    top = stats.recent(events, 5, F.desc("ts"), "event_id", by="user_id")
    return top.select("event_id", "user_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")).alias("rn"))


@PLANS.add("""SELECT 'Brand#11' AS asked, p_brand AS group_id, count(*) AS n FROM part WHERE p_brand = 'Brand#11' GROUP BY p_brand
UNION ALL SELECT 'all', p_brand, count(*) FROM part GROUP BY p_brand""")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "group_id")
    found = [stats.in_group(part, g).select(F.lit(g).alias("asked"), "group_id") for g in ("Brand#11", "all")]
    return found[0].unionByName(found[1]).groupBy("asked", "group_id").agg(F.count("*").alias("n"))


@PLANS.add(f"""WITH {FACTS_SQL}
SELECT f.uuid, c_name AS source_name, n_name AS target_name FROM facts f JOIN customer ON c_custkey = source_uuid JOIN nation ON n_nationkey = target_uuid
ORDER BY valid_at DESC, f.uuid LIMIT 100""")
def facts_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = orders_as_facts(spark, sf_dir).orderBy(F.desc_nulls_last("valid_at"), "uuid").limit(100)  # a top-k report
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_uuid"), F.col("c_name").alias("source_name"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("target_uuid"), F.col("n_name").alias("target_name"))
    return facts.join(people, "source_uuid").join(places, "target_uuid").select("uuid", "source_name", "target_name")


@PLANS.add(f"""WITH {FACTS_SQL} SELECT uuid, group_id FROM facts
WHERE expired_at IS NULL AND valid_at <= TIMESTAMP '1998-09-02' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-09-02')""")
def asof_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.as_of(orders_as_facts(spark, sf_dir), F.expr(NOW_ORDERS)).select("uuid", "group_id")


@PLANS.add(f"""WITH {FACTS_SQL} SELECT uuid, group_id FROM facts
WHERE (expired_at IS NULL OR expired_at > TIMESTAMP '1998-09-02') AND valid_at <= TIMESTAMP '1998-09-02' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-09-02')""")
def asof_facts_bitemporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.as_of(orders_as_facts(spark, sf_dir), F.expr(NOW_ORDERS), bitemporal=True).select("uuid", "group_id")


@PLANS.add("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
f AS (SELECT event_id AS click_id, user_id, ts AS valid_at FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, (SELECT max(valid_at) FROM f WHERE f.user_id = p.user_id AND f.valid_at <= p.ts) AS last_click FROM p""")
def asof_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    probes = events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("valid_at"))
    return temporal.as_of_join(probes, clicks, ["user_id"]).select("event_id", "user_id", F.col("valid_at").alias("last_click"))


@PLANS.add("""SELECT o_orderkey AS uuid, o_custkey AS source_uuid, o_orderstatus AS name, o_orderdate AS valid_at,
  lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS invalid_at FROM orders""")
def supersede_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("source_uuid"), F.col("o_orderstatus").alias("name"), F.col("o_orderdate").alias("valid_at"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"))
    return temporal.supersede(orders, ["source_uuid", "name"])


@PLANS.add(f"WITH {FACTS_SQL} SELECT group_id, count(*) AS active, count(invalid_at) AS ended FROM facts WHERE expired_at IS NULL GROUP BY group_id")
def active_current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.active(orders_as_facts(spark, sf_dir)).groupBy("group_id").agg(F.count("*").alias("active"), F.count("invalid_at").alias("ended"))


@PLANS.add(f"""WITH {FACTS_SQL}, i AS (SELECT * REPLACE (
    CASE WHEN uuid % 7 = 0 AND expired_at IS NULL THEN TIMESTAMP '1998-09-02' ELSE invalid_at END AS invalid_at,
    CASE WHEN uuid % 7 = 0 AND expired_at IS NULL THEN TIMESTAMP '1998-09-02' ELSE expired_at END AS expired_at) FROM facts)
SELECT uuid, invalid_at, expired_at FROM i""")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = orders_as_facts(spark, sf_dir)
    return temporal.invalidate(facts, facts.where("uuid % 7 = 0").select("uuid"), F.expr(NOW_ORDERS)).select("uuid", "invalid_at", "expired_at")


@PLANS.add(f"""WITH {FACTS_SQL} SELECT name, uuid, position FROM (
  SELECT c_name AS name, uuid, row_number() OVER (PARTITION BY c_custkey ORDER BY valid_at DESC, uuid) AS position
  FROM facts JOIN customer ON c_custkey = source_uuid WHERE expired_at IS NULL) WHERE position <= 5""")
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    # customers and nations share no ids here: targets are moved out of the customers' range
    facts = orders_as_facts(spark, sf_dir).withColumn("target_uuid", -1 - F.col("target_uuid"))
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("group_id"))
    return graph.history(facts, entities, entities.select("name", "group_id"), 5).select(F.col("of").alias("name"), "uuid", "position")


@PLANS.add(f"""WITH {FACTS_SQL} SELECT uuid, group_id FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY valid_at DESC NULLS LAST, uuid) AS rn FROM facts WHERE expired_at IS NULL) WHERE rn <= 60""")
def newest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.newest_facts(orders_as_facts(spark, sf_dir), 60, "valid_at").select("uuid", "group_id")  # a top-k report


@PLANS.add(f"""WITH {FACTS_SQL} SELECT uuid, '- ' || name || ': ' || substr(fact, 1, 300) || ' [' || strftime(valid_at, '%Y-%m-%d') || ' → '
  || coalesce(strftime(invalid_at, '%Y-%m-%d'), 'now') || ']' AS line FROM facts""")
def rendered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_facts(spark, sf_dir).select("uuid", T.rendered("name", "fact", "valid_at", "invalid_at").alias("line"))


@PLANS.add("SELECT doc_id AS uuid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmentioned_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_uuid"))
    return stats.not_mentioned(documents_as_episodes(spark, sf_dir), mentions).select("uuid")


@PLANS.add("SELECT count(*) AS remaining FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def backfill_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_uuid"))
    return stats.not_mentioned(documents_as_episodes(spark, sf_dir), mentions).agg(F.count("*").alias("remaining"))


@PLANS.add("""SELECT doc_id AS uuid, n_chars FROM documents WHERE lang IN ('fr', 'de') AND length(text) > 200
  AND (text ILIKE '%tion%' OR text ILIKE '%heit%') AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id DESC, doc_id LIMIT 50""")
def backfill_keyword_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no time: their number stands for it
    episodes = documents_as_episodes(spark, sf_dir).withColumn("created_at", F.col("uuid"))
    mentions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_uuid"))
    return stats.backfill(episodes, mentions, "migration_quality", 50, F.expr(NOW_EVENTS), migrated=("fr", "de"), keywords=("tion", "heit")).select("uuid", "n_chars")


@PLANS.add("SELECT doc_id AS uuid, n_chars FROM documents WHERE lang IN ('fr', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY length(text), doc_id LIMIT 50")
def backfill_short_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_uuid"))
    return stats.backfill(documents_as_episodes(spark, sf_dir), mentions, "migration_all", 50, F.expr(NOW_EVENTS), migrated=("fr", "de")).select("uuid", "n_chars")


@PLANS.add("""SELECT event_id AS uuid FROM events WHERE event_type NOT IN ('view') AND ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY
  AND event_id % 3 <> 0 ORDER BY ts DESC, event_id LIMIT 100""")
def backfill_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("uuid"), F.col("event_type").alias("source"), F.col("ts").alias("created_at"), F.col("props").alias("content"))
    mentions = events.where("uuid % 3 = 0").select(F.col("uuid").alias("episode_uuid"))
    return stats.backfill(events, mentions, None, 100, F.expr(NOW_EVENTS), window_days=7, skipped=("view",)).select("uuid")


@PLANS.add("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events
  WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND event_type NOT IN ('error')),
t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM w WHERE rn <= 30)
SELECT event_id AS uuid, user_id AS group_id FROM t WHERE n >= 3""")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("uuid"), F.col("user_id").alias("group_id"), F.col("event_type").alias("source"), F.col("ts").alias("created_at"))
    return stats.reflection_window(events, F.expr(NOW_EVENTS), 7, ("error",)).select("uuid", "group_id")


@PLANS.add(f"WITH {FACTS_SQL} SELECT uuid, group_id, length(fact) AS n FROM facts WHERE expired_at IS NULL AND length(fact) < 8 ORDER BY group_id, n")
def weak_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weak_facts(orders_as_facts(spark, sf_dir), 8).select("uuid", "group_id", F.length("fact").alias("n")).orderBy("group_id", "n")


@PLANS.add("""WITH k AS (SELECT c_mktsegment AS group_id FROM customer UNION SELECT p_brand FROM part)
SELECT w.group_id, coalesce((SELECT min(group_id) FROM k WHERE lower(k.group_id) = lower(w.group_id)), w.group_id) AS canonical
FROM (SELECT DISTINCT lower(c_mktsegment) AS group_id FROM customer UNION SELECT 'Nobody') w""")
def canonical_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("group_id"))
    known = segments.union(table(spark, sf_dir, "part").select("p_brand")).distinct()
    wanted = segments.select(F.lower("group_id").alias("group_id")).distinct().union(spark.createDataFrame([("Nobody",)], "group_id string"))
    return stats.canonical_groups(known, wanted)


@PLANS.add("""SELECT event_id, round(0.5 + 0.5 * power(0.5, greatest(0.0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0) / 60.0), 6) AS factor FROM events""")
def recency_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(D.recency_factor("ts", F.expr(NOW_EVENTS)), 6).alias("factor"))


@PLANS.add("SELECT event_id, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 1.5 ELSE 1.0 END::DOUBLE AS factor FROM events")
def time_window_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = D.query_window(F.lit("1月中旬"), F.expr(NOW_EVENTS))
    return table(spark, sf_dir, "events").withColumn("w", window).select("event_id", D.time_factor("ts", F.col("w")).alias("factor"))


DAY_OF_EVENT = "make_date({y}, {m}, {d})".format(y="CAST(2024 - event_id // 5 % 3 AS INT)", m="CAST(1 + event_id // 7 % 12 AS INT)", d="CAST(1 + event_id // 3 % 28 AS INT)")


@PLANS.add(f"""WITH e AS (SELECT event_id, event_id % 5 AS k, {DAY_OF_EVENT} AS day FROM events),
a AS (SELECT *, CASE WHEN k = 2 AND month(day) > 1 THEN make_date(2023, month(day), day(day)) WHEN k = 2 THEN make_date(2024, 1, day(day)) WHEN k < 2 THEN day WHEN k = 3 THEN DATE '2023-12-01' END AS s FROM e)
SELECT event_id, CAST(s AS VARCHAR) AS start_day, CAST(CASE WHEN k = 3 THEN DATE '2023-12-31' ELSE s END AS VARCHAR) AS end_day FROM a""")
def query_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of queries that name a day of each event: as ISO date, in full, without a year; last month; none."""
    day, k = F.expr(DAY_OF_EVENT.replace("//", "div")), F.col("event_id") % 5
    query = F.when(k == 0, F.date_format(day, "yyyy-MM-dd 的会")).when(k == 1, F.date_format(day, "yyyy年M月d日")).when(k == 2, F.date_format(day, "M月d日")).when(k == 3, F.lit("上个月")).otherwise(F.col("event_type"))
    asked = table(spark, sf_dir, "events").select("event_id", query.alias("query")).select("event_id", D.query_window("query", F.expr(NOW_EVENTS)).alias("w"))
    return asked.select("event_id", F.col("w.start").cast("string").alias("start_day"), F.col("w.end").cast("string").alias("end_day"))


@PLANS.add("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') END AS start_day,
  CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m-01') END AS end_day FROM orders""")
def dates_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in sentences about each order: a day, a range of months, none."""
    k, month = F.col("o_orderkey") % 3, lambda c: F.date_format(c, "yyyy年M月")
    until = F.col("o_orderdate") + F.expr("INTERVAL 1 YEAR")
    fact = F.when(k == 0, F.date_format("o_orderdate", "他于yyyy年M月d日入职")).when(k == 1, F.concat(month("o_orderdate"), F.lit("至"), month(until), F.lit("在职"))).otherwise(F.concat(F.lit("没有日期"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.dates_in_text(fact).alias("w")).select("o_orderkey", F.col("w.start").cast("string").alias("start_day"), F.col("w.end").cast("string").alias("end_day"))


@PLANS.add("""SELECT o_orderkey AS uuid, '[' || strftime(o_orderdate, '%Y-%m-%d') || ' → ' ||
  coalesce(strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d'), 'now') || ']' AS validity FROM orders""")
def validity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_facts(spark, sf_dir).select("uuid", T.validity_label("valid_at", "invalid_at").alias("validity"))


@PLANS.add("""WITH f AS (SELECT o_orderkey AS uuid, o_custkey AS source_uuid, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS valid_at,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) END AS invalid_at FROM orders),
p AS (SELECT l_orderkey, l_linenumber, o_custkey AS source_uuid, l_shipdate AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, uuid FROM p JOIN f ON p.source_uuid = f.source_uuid AND (valid_at IS NULL OR valid_at <= t) AND (invalid_at IS NULL OR t < invalid_at)""")
def facts_holding_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a customer that are open when one of its lines is shipped; orders overlap, some have no beginning or end."""
    orders = table(spark, sf_dir, "orders")
    valid_at = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate"))
    invalid_at = F.when(F.col("o_orderkey") % 7 != 0, F.expr("timestampadd(DAY, CAST(o_orderkey % 400 AS INT), o_orderdate)"))
    facts = orders.select(F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("source_uuid"), valid_at.alias("valid_at"), invalid_at.alias("invalid_at"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at"))
    probes = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source_uuid")), "l_orderkey")
    return temporal.holding_join(probes, facts, ["source_uuid"]).select("l_orderkey", "l_linenumber", "uuid")

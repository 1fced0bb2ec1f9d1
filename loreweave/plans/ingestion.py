"""Upserts, deletes, resolution and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.operators import ingest, resolution
from loreweave.operators.shuffles import shared_folder
from loreweave.plans.governance import NORM_SQL
from loreweave.plans.registry import Registry
from loreweave.sources.tables import parts_as_entities, table
from loreweave.streaming import ingest as streams

PLANS = Registry()


@PLANS.add("""WITH f AS (SELECT l_partkey AS uuid, list(DISTINCT l_orderkey ORDER BY l_orderkey) AS eps FROM lineitem GROUP BY l_partkey)
SELECT uuid, len(eps) AS n FROM f WHERE NOT (len(eps) = 1 AND eps[1] % 2 = 0)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    facts = lines.groupBy(F.col("l_partkey").alias("uuid")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("episodes"))
    episodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"))
    mentions = lines.select(F.col("l_orderkey").alias("episode_uuid"), F.col("l_partkey").alias("entity_uuid"))
    vectors = spark.createDataFrame([], "uuid long, vector array<float>")
    left = ingest.forget_episodes(episodes.where("uuid % 2 = 0"), episodes, facts, mentions, vectors)
    return left["facts"].select("uuid", F.size("episodes").alias("n"))


@PLANS.add("""WITH t AS (SELECT user_id AS uuid, min(event_type) AS group_id, 0.0 AS value FROM events WHERE user_id % 2 = 0 GROUP BY user_id),
c AS (SELECT user_id AS uuid, event_type AS group_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS rn FROM events) WHERE rn = 1)
SELECT coalesce(t.uuid, c.uuid) AS uuid, coalesce(t.group_id, c.group_id) AS group_id, CASE WHEN c.uuid IS NOT NULL THEN c.value ELSE t.value END AS value
FROM t FULL OUTER JOIN c ON t.uuid = c.uuid""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    target = events.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("uuid")).agg(F.min("event_type").alias("group_id"), F.lit(0.0).alias("value"))
    changes = events.select(F.col("user_id").alias("uuid"), "ts", F.col("event_type").alias("group_id"), "value")
    return ingest.upsert(target, changes, "uuid", ("group_id",), "ts")


@PLANS.add("""SELECT l_orderkey AS episode_uuid, l_partkey AS entity_uuid FROM lineitem GROUP BY 1, 2""")
def mentions_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_uuid"), F.col("l_partkey").alias("entity_uuid"))
    old = pairs.where("episode_uuid % 3 = 0").distinct()
    return ingest.insert_ignore(old, pairs, ["episode_uuid", "entity_uuid"])


@PLANS.add("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type""")
def first_of_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@PLANS.add(f"""WITH e AS (SELECT p_brand AS g, {NORM_SQL.format('p_name')} AS k, min(p_partkey) AS uuid, p_name FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
i AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 4 = 1 THEN upper(p_name) ELSE p_name END AS name, p_brand AS g, {NORM_SQL.format('p_name')} AS k FROM part WHERE p_partkey % 2 = 1)
SELECT item, (SELECT min(uuid) FROM e WHERE e.g = i.g AND e.k = i.k) AS uuid,
       CASE WHEN (SELECT min(uuid) FROM e WHERE e.g = i.g AND e.k = i.k) IS NULL THEN 'new' WHEN item % 4 = 1 THEN 'norm' ELSE 'name' END AS layer FROM i""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parts_as_entities(spark, sf_dir)
    items = part.where("uuid % 2 = 1").select(F.col("uuid").alias("item"), F.when(F.col("uuid") % 4 == 1, F.upper("name")).otherwise(F.col("name")).alias("name"), "group_id")
    return ingest.resolve_entities(items, part.where("uuid % 2 = 0")).select("item", "uuid", "layer")


@PLANS.add(f"""WITH e AS (SELECT p_brand AS g, {NORM_SQL.format('p_name')} AS k, min(p_partkey) AS uuid FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL),
i AS (SELECT p_partkey AS item, p_brand AS g, {NORM_SQL.format('p_name')} AS k FROM part WHERE p_partkey % 4 <> 0),
f AS (SELECT g, k, min(item) AS first_item FROM i GROUP BY g, k)
SELECT item, uuid, CASE WHEN uuid IS NULL THEN first_item END AS same_as FROM i JOIN f USING (g, k) LEFT JOIN e USING (g, k)""")
def resolution_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that come one after another: those that an earlier one is alike are that one, or the entity that it is."""
    part = parts_as_entities(spark, sf_dir)
    written = F.when(F.col("uuid") % 4 == 1, F.upper("name")).when(F.col("uuid") % 4 == 2, F.initcap("name")).otherwise(F.col("name"))
    items = part.where("uuid % 4 <> 0").select(F.col("uuid").alias("item"), written.alias("name"), "group_id")
    return resolution.resolve_in_order(items, part.where("uuid % 4 = 0")).select("item", "uuid", "same_as")


@PLANS.add(r"""WITH n AS (SELECT doc_id, lang AS g, trim(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g')) AS k FROM documents),
known AS (SELECT g, k, min(doc_id) AS uuid FROM n WHERE doc_id % 2 = 0 GROUP BY g, k)
SELECT uuid, doc_id AS episode FROM n JOIN known USING (g, k) WHERE doc_id % 2 = 1""")
def fact_resolution_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("group_id"), F.col("text").alias("fact"), F.lit(1).alias("source_uuid"), F.lit(2).alias("target_uuid"))
    facts = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("uuid"), "group_id", "fact", "source_uuid", "target_uuid", F.lit(None).cast("timestamp").alias("expired_at"))
    repeats, _ = ingest.resolve_facts(docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "episode"), facts)
    return repeats


@PLANS.add("""WITH k AS (SELECT p_name, min(p_partkey) AS uuid FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_name)
SELECT l_orderkey, l_linenumber, k.uuid AS source_uuid, -1 - l_suppkey AS target_uuid
FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN k USING (p_name) JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 4 <> 0""")
def facts_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as extracted facts that name their ends; every fourth part and supplier is unknown."""
    part, supplier = table(spark, sf_dir, "part").select("p_partkey", "p_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    named = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    facts = named.select("l_orderkey", "l_linenumber", F.col("p_name").alias("source_name"), F.col("s_name").alias("target_name"))
    resolved = part.select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey")).alias("uuid"))
    resolved = resolved.unionByName(supplier.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, -1 - F.col("s_suppkey")).alias("uuid")))
    return ingest.with_ends(facts, resolved).select("l_orderkey", "l_linenumber", "source_uuid", "target_uuid")


@PLANS.add("""SELECT o_orderkey AS item, o_orderpriority AS entity_type FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def items_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("entity_type"))
    return ingest.of_types(items, ("1-URGENT", "2-HIGH"))


@PLANS.add("""SELECT DISTINCT least(l_partkey, l_suppkey) AS a_uuid, greatest(l_partkey, l_suppkey) AS b_uuid FROM lineitem WHERE least(l_partkey, l_suppkey) % 3 <> 0""")
def links_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without a third of them, which are named from their other end."""
    links = table(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a_uuid"), F.greatest("l_partkey", "l_suppkey").alias("b_uuid")).distinct()
    gone = links.where("a_uuid % 3 = 0").select(F.col("b_uuid").alias("a_uuid"), F.col("a_uuid").alias("b_uuid"))
    return ingest.remove_links(links, gone)


@PLANS.add("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '端 口 ' || p_partkey || ' 在 ' || p_name END AS spaced FROM part""")
def spaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, most of them in a Chinese phrase."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("端口"), "p_partkey", F.lit("在"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.spaced_cjk(text).alias("spaced"))


@PLANS.add("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each, as a stream."""
    return streams.run_available(streams.once_each(_stream(spark, sf_dir, "events"), "event_id", "ts"), "stream-dedup").select("event_id", "user_id", "event_type")


@PLANS.add("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, also of the days that the watermark hasn't closed yet."""
    counts = streams.counts_by_window(_stream(spark, sf_dir, "events"), "ts", "1 day", "1 hour", "event_type")
    return streams.run_updates(counts, "stream-windows", ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@PLANS.add("""SELECT * FROM (SELECT o_custkey AS source_uuid, o_orderstatus AS name, o_orderkey AS uuid, o_orderdate AS valid_at,
  lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS invalid_at FROM orders) WHERE invalid_at IS NOT NULL""")
def stream_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that come in five batches, each with early and late ones of the same customers."""
    orders = _stream(spark, sf_dir, "orders", 5)
    facts = orders.select(F.col("o_custkey").alias("source_uuid"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("uuid"), F.col("o_orderdate").alias("valid_at"))
    return streams.supersessions(facts, ["source_uuid", "name"])


def _stream(spark: SparkSession, sf_dir: str, name: str, batches: int = 1) -> DataFrame:
    """A table as a stream of its files; of more batches, each is a share of the rows by their hash, whatever their order."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if batches == 1:
        return spark.readStream.schema(schema).parquet(_folder(spark, path))
    to = shared_folder(spark, "stream-source")
    rows = spark.read.parquet(path)
    for k in range(batches):  # files go in order of their time
        rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(batches)) == k).write.mode("append").parquet(to)
    files = len(spark.read.parquet(to).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(to)


def _folder(spark: SparkSession, path: str) -> str:
    """A stream reads folders: a table that is one file is copied into one."""
    to = shared_folder(spark, "stream-source")
    spark.read.parquet(path).write.parquet(to)
    return to

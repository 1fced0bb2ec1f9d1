"""Ranked retrieval over the driver's documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.functions.vector import cosine
from loreweave.operators import dedup, graph, index, retrieval as R
from loreweave.operators import vectors as V
from loreweave.plans.registry import Registry
from loreweave.sources.tables import orders_as_facts, table
from loreweave.plans.relational import FACTS_SQL, NOW_ORDERS

PLANS = Registry()
TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"
#: Queries over documents: number, text.
ASKED = [(1, "idiot clown worthless"), (2, "license apache version"), (3, "mentai que reanti"), (4, "the the zzzz-nothing"), (5, "unglich heitkeit ento?")]
ASKED_SQL = "(VALUES " + ", ".join(f"({q}, '{t}')" for q, t in ASKED) + ")"
INDEX_SQL = rf"""idx AS (SELECT doc_id AS doc, {TOKENS.format('text')} AS ws FROM documents),
dl AS (SELECT doc, len(ws) AS dl FROM idx), corpus AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM dl),
asked AS (SELECT * FROM {ASKED_SQL} AS a(query, text)),
phrases AS (SELECT query, row_number() OVER (PARTITION BY query) AS phrase, {TOKENS.format('word')} AS terms
            FROM (SELECT query, unnest(string_split_regex(replace(text, '?', ''), '\s+')) AS word FROM asked)),
post AS (SELECT doc, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM idx),
need AS (SELECT query, phrase, len(terms) AS n, unnest(terms) AS term, generate_subscripts(terms, 1) AS nth FROM phrases),
starts AS (SELECT query, phrase, n, doc, pos - nth AS begin_at FROM post JOIN need USING (term) GROUP BY query, phrase, n, doc, pos - nth HAVING count(*) = n),
tf AS (SELECT query, phrase, doc, count(*) AS tf FROM starts GROUP BY query, phrase, doc),
df AS (SELECT query, phrase, count(*) AS df FROM tf GROUP BY query, phrase),
bm AS (SELECT query, doc, round(sum(CAST(round((CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * 1e15) AS BIGINT)) / 1e15, 12) AS score
       FROM tf JOIN df USING (query, phrase) JOIN dl USING (doc), corpus GROUP BY query, doc),
lex AS (SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm) WHERE rank <= 20)"""
COSINE_SQL = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])) + 1e-9)"
VECTORS_SQL = f"""qv AS (SELECT vec_id + 1 AS query, embedding AS q FROM embeddings WHERE vec_id < 5),
vs AS (SELECT query, vec_id AS doc, round({COSINE_SQL.format(a='embedding', b='q')}, 12) AS score FROM embeddings, qv),
vec AS (SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM vs) WHERE rank <= 20)"""
FUSED_SQL = """lists AS (SELECT query, doc, rank, 0 AS list FROM lex UNION ALL SELECT query, doc, rank, 1 FROM vec),
fused AS (SELECT query, doc, sum(1 / (60.0 + rank)) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY query, doc)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query long, text string")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("doc < 5").select((F.col("doc") + 1).alias("query"), "vector")


@PLANS.add(rf"""WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 50""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _docs(spark, sf_dir).select("doc", F.explode(T.tokens("text")).alias("term")).groupBy("term", "doc").count()
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("cf")).where("df >= 50")


@PLANS.add(f"WITH {INDEX_SQL} SELECT query, doc, round(score, 6) AS score, rank FROM lex")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.best(index.kept(_docs(spark, sf_dir), "doc", ["text"]), _asked(spark), 20).select("query", "doc", F.round("score", 6).alias("score"), "rank")


PHRASES = [(1, "the-of"), (2, "general-public-license"), (3, "of-the and-the")]


@PLANS.add(f"WITH {INDEX_SQL.replace(ASKED_SQL, '(VALUES ' + ', '.join(f'({q}, {chr(39)}{t}{chr(39)})' for q, t in PHRASES) + ')')} SELECT query, doc, round(score, 6) AS score, rank FROM lex")
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.best(index.kept(_docs(spark, sf_dir), "doc", ["text"]), spark.createDataFrame(PHRASES, "query long, text string"), 20).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@PLANS.add(f"WITH {VECTORS_SQL} SELECT query, doc, round(score, 6) AS score, rank FROM vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_top_k(_vectors(spark, sf_dir).select("doc", "vector"), _asked_vectors(spark, sf_dir), 20).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@PLANS.add(f"""WITH q AS (SELECT vec_id AS query, embedding AS q, label FROM embeddings WHERE vec_id < 20),
s AS (SELECT query, e.vec_id AS doc, round({COSINE_SQL.format(a='embedding', b='q')}, 12) AS score FROM embeddings e JOIN q USING (label))
SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""")
def vector_topk_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where("doc < 20").select(F.col("doc").alias("query"), "vector", "label")
    return V.nearest(vectors, asked, 10, "label").select("query", "doc", F.round("score", 6).alias("score"), "rank")


@PLANS.add(f"""WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, e.vec_id AS doc, round({COSINE_SQL.format(a='embedding', b='q')}, 12) AS score FROM embeddings e, q)
SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""")
def vector_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ten of every vector whose id fifty divides, from cells that are pruned by the triangle inequality."""
    vectors = _vectors(spark, sf_dir).select("doc", "vector")
    asked = vectors.where("doc % 50 = 0").select(F.col("doc").alias("query"), "vector")
    return V.nearest_in_cells(V.build_cells(vectors), asked, 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@PLANS.add(f"""WITH q AS (SELECT vec_id AS query, embedding AS q, label FROM embeddings WHERE vec_id % 100 = 1),
s AS (SELECT query, e.vec_id AS doc, round({COSINE_SQL.format(a='embedding', b='q')}, 12) AS score FROM embeddings e JOIN q USING (label))
SELECT query, doc, round(1 / (60.0 + rank), 8) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 20""")
def search_entities_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector lists of whole searches: no word of a query occurs, so entities come by their vectors in the query's group."""
    held = _vectors(spark, sf_dir).select(F.col("doc").alias("uuid"), F.concat(F.lit("entity "), F.col("doc")).alias("name"), F.col("label").cast("string").alias("group_id"), "vector")
    entities = held.select("uuid", "name", F.lit("").alias("summary"), "group_id")
    asked = held.where("uuid % 100 = 1").select(F.col("uuid").alias("query"), F.lit("nothing here").alias("text"), "group_id", "vector")
    facts = orders_as_facts(spark, sf_dir).where("false")
    episodes = entities.select("uuid", "group_id", F.col("name").alias("content"), "name", F.expr(NOW_ORDERS).alias("created_at")).where("false")
    links = spark.createDataFrame([], "a_uuid long, b_uuid long")
    found = R.search(facts, entities, episodes, links, asked, F.expr(NOW_ORDERS), vectors={"entity": held.select("uuid", "vector")})
    return found["entities"].select("query", "doc", F.round("score", 8).alias("score"), "rank")


@PLANS.add(rf"""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS uuid, l_partkey % 2000 AS entity, l_shipdate AS valid_at FROM lineitem),
n AS (SELECT vec_id, label, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT 'asked ' || n.vec_id AS of, n.label, arg_min(e.vec_id, (-round({COSINE_SQL.format(a='embedding', b='q')}, 12), e.vec_id)) AS entity FROM n JOIN embeddings e USING (label) GROUP BY ALL),
exact AS (SELECT 'e' || vec_id AS of, label, vec_id AS entity FROM embeddings WHERE vec_id % 20 = 1)
SELECT of, entity, uuid, position FROM (SELECT of, entity, uuid, row_number() OVER (PARTITION BY of, entity ORDER BY valid_at DESC, uuid) AS position
  FROM (SELECT * FROM near UNION ALL SELECT * FROM exact) JOIN f USING (entity)) WHERE position <= 20""")
def history_by_nearest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of names, some of which no entity has: then those of the entity with the nearest vector in the group."""
    held = _vectors(spark, sf_dir).select(F.col("doc").alias("uuid"), F.concat(F.lit("e"), F.col("doc")).alias("name"), F.col("label").cast("string").alias("group_id"), "vector")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"), (F.col("l_partkey") % 2000).alias("source_uuid"), F.col("l_shipdate").alias("valid_at"))
    group = held.select(F.col("uuid").alias("source_uuid"), "group_id")
    facts = lines.join(group, "source_uuid").withColumns({"target_uuid": F.col("source_uuid"), "expired_at": F.lit(None).cast("timestamp")})
    asked = held.where("uuid % 20 in (0, 1)").select(F.when(F.col("uuid") % 20 == 1, F.col("name")).otherwise(F.concat(F.lit("asked "), F.col("uuid"))).alias("name"), "group_id", "vector")
    return graph.history_or_nearest(facts, held.select("uuid", "name", "group_id"), asked, held.select("uuid", "vector")).select("of", "entity", "uuid", "position")


@PLANS.add(rf"""WITH {FACTS_SQL}
SELECT 'fact' AS kind, uuid, '  • ' || fact || ' [' || strftime(valid_at, '%Y-%m-%d') || ' → ' || coalesce(strftime(invalid_at, '%Y-%m-%d'), '现在') || ']' AS line FROM facts
UNION ALL SELECT 'entity', p_partkey, '  • ' || p_name || ' (' || p_brand || ') — ' || substr(p_type, 1, 80) FROM part
UNION ALL SELECT 'episode', doc_id, '  • ' || substr(text, 1, 120) FROM documents""")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, entities and episodes as lines of a rendered search."""
    facts = orders_as_facts(spark, sf_dir).select(F.lit("fact").alias("kind"), "uuid", T.fact_line("fact", "valid_at", "invalid_at").alias("line"))
    part = table(spark, sf_dir, "part").select(F.lit("entity").alias("kind"), F.col("p_partkey").alias("uuid"), T.entity_line("p_name", F.array("p_brand"), "p_type").alias("line"))
    return facts.unionByName(part).unionByName(_docs(spark, sf_dir).select(F.lit("episode").alias("kind"), F.col("doc").alias("uuid"), T.episode_line("text").alias("line")))


@PLANS.add(f"""SELECT a.label AS label, a.vec_id AS a, b.vec_id AS b, round({COSINE_SQL.format(a='a.embedding', b='b.embedding')}, 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COSINE_SQL.format(a='a.embedding', b='b.embedding')} >= 0.35""")
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir).withColumnRenamed("doc", "uuid")
    return dedup.vector_pairs(vectors, 0.35, "label").select("label", "a", "b", F.round("similarity", 6).alias("similarity"))


@PLANS.add(f"WITH {INDEX_SQL}, {VECTORS_SQL}, {FUSED_SQL} SELECT query, doc, round(score, 8) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = index.best(index.kept(_docs(spark, sf_dir), "doc", ["text"]), _asked(spark), 20)
    vec = R.vector_top_k(_vectors(spark, sf_dir).select("doc", "vector"), _asked_vectors(spark, sf_dir), 20)
    return R.rrf(lex, vec).select("query", "doc", F.round("score", 8).alias("score"))


@PLANS.add(f"""WITH {INDEX_SQL}, {VECTORS_SQL}, {FUSED_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, first, doc) AS rank FROM fused)
SELECT query, doc AS doc_id, round(score, 6) AS score, rank, substr(text, 1, 500) AS snippet FROM best JOIN documents ON doc_id = doc WHERE rank <= 20""")
def hybrid_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    asked = _asked(spark).join(_asked_vectors(spark, sf_dir), "query", "left")
    found = R.hybrid_search(docs, asked, ["text"], _vectors(spark, sf_dir).select("doc", "vector"), limit=20)
    return found.join(docs, "doc").select("query", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank", T.snippet("text").alias("snippet"))


FACT_ASKED = [(1, "urgent"), (2, "low medium"), (3, "o high")]


@PLANS.add(rf"""WITH {FACTS_SQL}, {INDEX_SQL.replace('doc_id AS doc', 'uuid AS doc').replace(TOKENS.format('text') + ' AS ws FROM documents', TOKENS.format('fact') + ' AS ws FROM facts').replace(ASKED_SQL, '(VALUES ' + ', '.join(f'({q}, {chr(39)}{t}{chr(39)})' for q, t in FACT_ASKED) + ')').replace('rank <= 20', 'rank <= 500')},
w AS (SELECT query, doc, 1 / (60.0 + rank) * (0.5 + 0.5 * power(0.5, greatest(0.0, (epoch_us(TIMESTAMP '1998-09-02') - epoch_us(valid_at)) / 86400000000.0) / 60.0)) AS score, rank
      FROM lex JOIN facts ON uuid = doc),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank, doc) AS place FROM w)
SELECT query, doc AS uuid, round(score, 8) AS score FROM b JOIN facts ON uuid = doc WHERE place <= 200
  AND expired_at IS NULL AND valid_at <= TIMESTAMP '1998-09-02' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-09-02')""")
def hybrid_search_facts_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreweave.operators import temporal

    facts, now = orders_as_facts(spark, sf_dir), F.expr(NOW_ORDERS)
    asked = spark.createDataFrame(FACT_ASKED, "query long, text string")
    lex = index.best(index.kept(facts, "uuid", ["fact"]), asked, 500)
    scored = R.weighed(R.rrf(lex), facts.select(F.col("uuid").alias("doc"), F.col("valid_at").alias("at")), asked, now)
    pool = R.fused_top(scored, 200)  # the pool is cut before the temporal filter
    return temporal.as_of(pool.join(facts, pool.doc == facts.uuid), now).select("query", "uuid", F.round("score", 8).alias("score"))


@PLANS.add(rf"""WITH golden AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)),
{INDEX_SQL.replace(f'SELECT * FROM {ASKED_SQL} AS a(query, text)', "SELECT item_id AS query, array_to_string(string_split(text, ' ')[1:8], ' ') AS text FROM benchmark")},
hits AS (SELECT query, min(rank) AS first FROM lex JOIN golden USING (query, doc) GROUP BY query),
asked2 AS (SELECT DISTINCT query FROM golden WHERE doc IS NOT NULL)
SELECT count(*) AS positives, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr
FROM asked2 LEFT JOIN hits USING (query)""")
def eval_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"))
    golden = items.select("query").join(R.holding(docs, items), "query", "left")
    asked = items.select("query", F.array_join(F.slice(F.split("item", " "), 1, 8), " ").alias("text"))
    # other white space than a space makes more than eight parts of these words: all are asked for
    ranked = index.best_of_texts(docs, "doc", ["text"], asked, 20, parts=None)
    found = R.evaluate(ranked, golden)
    return found.select("positives", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


#: Whole searches over customers, their orders and the documents: number, text, group.
SEARCHED = [(1, "urgent customer", "BUILDING"), (2, "medium idiot customer", "MACHINERY"), (3, "low 000000010 license", "AUTOMOBILE")]
AGED_SQL = "1 / (60.0 + rank) * (0.5 + 0.5 * power(0.5, greatest(0.0, (epoch_us(TIMESTAMP '1998-09-02') - epoch_us(happened)) / 86400000000.0) / 60.0))"


def _by_words_sql(kind: str, rows: str) -> str:
    """The 20 best by words of each query in its group; rows: SQL of doc, group_id, happened, words."""
    idf = "ln((docs - df + 0.5) / (df + 0.5))"
    return rf"""{kind}_idx AS (SELECT doc, group_id, happened, {TOKENS.format('words')} AS ws FROM ({rows})),
{kind}_corpus AS (SELECT count(*) AS docs, avg(len(ws)) AS avgdl FROM {kind}_idx),
{kind}_tf AS (SELECT query, term, doc, count(*) AS tf FROM (SELECT doc, unnest(ws) AS term FROM {kind}_idx) JOIN asked_words USING (term) GROUP BY ALL),
{kind}_df AS (SELECT query, term, count(*) AS df FROM {kind}_tf GROUP BY ALL),
{kind}_bm AS (SELECT query, doc, group_id, happened, round(sum((CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))), 12) AS score
  FROM {kind}_tf JOIN {kind}_df USING (query, term) JOIN {kind}_idx USING (doc), {kind}_corpus GROUP BY query, doc, group_id, happened),
{kind}_top AS (SELECT * FROM (SELECT query, doc, happened, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {kind}_bm JOIN asked USING (query, group_id)) WHERE rank <= 20)"""


@PLANS.add(rf"""WITH {FACTS_SQL}, asked AS (SELECT * FROM (VALUES {", ".join(f"({q}, '{t}', '{g}')" for q, t, g in SEARCHED)}) AS a(query, text, group_id)),
asked_words AS (SELECT query, unnest(string_split(text, ' ')) AS term FROM asked),
{_by_words_sql("e", "SELECT c_custkey AS doc, c_mktsegment AS group_id, NULL AS happened, c_name AS words FROM customer")},
{_by_words_sql("p", "SELECT doc_id AS doc, (['BUILDING', 'MACHINERY', 'AUTOMOBILE'])[1 + doc_id % 3] AS group_id, TIMESTAMP '1998-01-01' + to_days(CAST(doc_id % 240 AS INTEGER)) AS happened, text AS words FROM documents")},
{_by_words_sql("f", "SELECT uuid AS doc, group_id, valid_at AS happened, fact || ' ' || name AS words FROM facts")},
p_aged AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank, doc) AS position FROM (SELECT *, {AGED_SQL} AS score FROM p_top)),
f_aged AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank, doc) AS place FROM (SELECT *, {AGED_SQL} AS score FROM f_top)),
holds AS (SELECT * FROM facts WHERE expired_at IS NULL AND valid_at <= TIMESTAMP '1998-09-02' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-09-02')),
seeds AS (SELECT query, doc AS entity, rank, group_id FROM e_top JOIN asked USING (query) WHERE rank <= 5),
same AS (SELECT c_custkey - 1 AS a, c_custkey AS b FROM customer WHERE c_custkey % 10 = 0),
hops AS (SELECT query, uuid, rank * 10 AS way FROM seeds JOIN holds ON source_uuid = entity AND seeds.group_id = holds.group_id
  UNION ALL SELECT query, uuid, rank * 10 + 1 FROM seeds JOIN (SELECT a, b FROM same UNION SELECT b, a FROM same) ON a = entity JOIN holds ON source_uuid = b),
around AS (SELECT query, uuid, row_number() OVER (PARTITION BY query ORDER BY min(way), uuid) AS place FROM hops GROUP BY query, uuid),
once AS (SELECT query, doc AS uuid, 0 AS part, place, score FROM f_aged WHERE place <= 10 AND doc IN (SELECT uuid FROM holds)
  UNION ALL SELECT query, uuid, 1, place, NULL FROM around WHERE place <= 50
    AND (query, uuid) NOT IN (SELECT (query, doc) FROM f_aged WHERE place <= 10 AND doc IN (SELECT uuid FROM holds))),
f_found AS (SELECT query, uuid, score, row_number() OVER (PARTITION BY query ORDER BY part, place, uuid) AS position FROM once)
SELECT 'fact' AS kind, query, uuid, position, round(score, 8) AS score FROM f_found WHERE position <= 40
UNION ALL SELECT 'entity', query, doc, rank, round(1 / (60.0 + rank), 8) FROM e_top UNION ALL SELECT 'episode', query, doc, position, round(score, 8) FROM p_aged""")
def search_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, entities and episodes of whole searches as of a moment; customers are entities, documents are dealt to three groups."""
    customer, now = table(spark, sf_dir, "customer"), F.expr(NOW_ORDERS)
    entities = customer.select(F.col("c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.lit("").alias("summary"), F.col("c_mktsegment").alias("group_id"))
    links = customer.where("c_custkey % 10 = 0").select((F.col("c_custkey") - 1).alias("a_uuid"), F.col("c_custkey").alias("b_uuid"))
    group = F.expr("element_at(array('BUILDING', 'MACHINERY', 'AUTOMOBILE'), CAST(1 + doc_id % 3 AS INT))")
    created = F.expr("timestampadd(DAY, CAST(doc_id % 240 AS INT), TIMESTAMP_NTZ'1998-01-01 00:00:00')")
    episodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uuid"), group.alias("group_id"), F.col("text").alias("content"), F.lit("").alias("name"), created.alias("created_at"))
    # customers and nations share no ids here: targets are moved out of the customers' range and below -1, to which customer 0 is linked
    facts = orders_as_facts(spark, sf_dir).withColumn("target_uuid", -2 - F.col("target_uuid"))
    asked = spark.createDataFrame(SEARCHED, "query long, text string, group_id string")
    found = R.search(facts, entities, episodes, links, asked, now, as_of=now)
    rows = [found["facts"].select(F.lit("fact").alias("kind"), "query", "uuid", "position", "score")]
    rows += [found[many].select(F.lit(one).alias("kind"), "query", F.col("doc").alias("uuid"), F.col("rank").alias("position"), "score") for one, many in (("entity", "entities"), ("episode", "episodes"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("score", F.round("score", 8))


@PLANS.add(f"""SELECT doc_id AS doc, len({TOKENS.format("CASE WHEN doc_id % 5 = 1 THEN text || ' twice changed' ELSE text END")}) AS dl FROM documents WHERE doc_id % 5 <> 0""")
def postings_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths in an index whose texts changed or went since it was written."""
    docs = _docs(spark, sf_dir)
    changed = docs.where("doc % 5 = 1").withColumn("text", F.concat("text", F.lit(" twice changed")))
    return R.synced_postings(R.postings(docs, "doc", ["text"]), changed, docs.where("doc % 5 = 0"), "doc", ["text"]).select("doc", F.greatest("dl", F.lit(0)).alias("dl"))


CHANGED_SQL = "CASE WHEN doc_id % 5 = 1 THEN text || ' twice changed' ELSE text END"


@PLANS.add(f"""SELECT term, doc, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos - 1 AS VARCHAR), ' ' ORDER BY pos) AS places
FROM (SELECT doc_id AS doc, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {TOKENS.format(CHANGED_SQL)} AS ws FROM documents WHERE doc_id % 5 <> 0)) GROUP BY term, doc""")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of an inverted index with texts, frequencies and places, after an update of changed and removed texts."""
    docs = _docs(spark, sf_dir)
    changed = docs.where("doc % 5 = 1").withColumn("text", F.concat("text", F.lit(" twice changed")))
    newer = index.updated(index.kept(docs, "doc", ["text"]), changed, docs.where("doc % 5 = 0"), "doc", ["text"])
    return newer.entries().select("term", "doc", "tf", F.array_join(F.col("places").cast("array<string>"), " ").alias("places"))


@PLANS.add("""WITH m AS (SELECT l_suppkey % 10 AS query, l_orderkey AS doc, -min((l_linenumber, -CAST(l_extendedprice AS DOUBLE)))[2] AS score FROM lineitem GROUP BY ALL)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM m""")
def groups_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of several groups as one list: line numbers stand for the groups' places."""
    lines = table(spark, sf_dir, "lineitem")
    results = lines.select((F.col("l_suppkey") % 10).alias("query"), F.col("l_linenumber").alias("group_position"), F.col("l_orderkey").alias("doc"), F.col("l_extendedprice").cast("double").alias("score"))
    return R.merged_groups(results).select("query", "doc", "score", "rank")


@PLANS.add("""WITH r AS (SELECT o_custkey AS query, o_orderkey AS doc, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 29 - 5 END AS given FROM orders),
h AS (SELECT *, CASE WHEN rank <= 10 AND max(given) FILTER (WHERE rank <= 10) OVER (PARTITION BY query) IS NOT NULL THEN least(10.0, greatest(0.0, coalesce(given, 0))) ELSE 0.0 END AS relevance FROM r)
SELECT query, doc, CAST(relevance AS DOUBLE) AS relevance, CASE WHEN rank > 10 THEN rank ELSE row_number() OVER (PARTITION BY query, rank <= 10 ORDER BY relevance DESC, score DESC, rank) END AS rank FROM h""")
def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by price; every third has a relevance, some out of bounds."""
    from pyspark.sql import Window as W

    by = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    ranked = orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("score"), F.row_number().over(by).alias("rank"))
    scores = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 29 - 5).cast("double").alias("relevance"))
    return R.rerank(ranked, scores).select("query", "doc", "relevance", "rank")


@PLANS.add(f"""SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE_SQL.format(a='a.embedding', b='b.embedding')}, 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    a, b = v.select(F.col("doc").alias("a"), F.col("vector").alias("va")), v.select(F.col("doc").alias("b"), F.col("vector").alias("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))

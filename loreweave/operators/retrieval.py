"""Ranked retrieval for many queries at once: BM25, cosine, fusion, weights, evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.functions import time as D
from loreweave.functions.vector import cosine
from loreweave.operators import graph, index as inverted, temporal
from loreweave.operators import vectors as V
from loreweave.operators.index import B, K1, LEAST_IDF, SCORE_DIGITS, query_terms
from loreweave.operators.shuffles import stored

#: Fixed value of rank fusion.
RRF_K = 60
#: Queries whose vectors a task holds at a time.
QUERY_BATCH = 2048
#: Items that holding() brings to the texts, bytes of text that a task compares with them at a time; a longer text is compared alone.
HELD_ITEMS, SCAN_BYTES = 5000, 4_000_000


def postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """doc, dl and the token lists of each column; dl counts the tokens of all of them.

    Written once to the shared folder: texts are tokenised once for corpus figures, hits and frequencies.
    """
    lists = docs.select(F.col(id_col).alias("doc"), *[T.tokens(c).alias(c) for c in columns])
    return stored(lists.withColumn("dl", sum((F.size(c) for c in columns), F.lit(0))), "postings")


def synced_postings(index: DataFrame, changed: DataFrame, removed: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The index after an update: rows of changed texts (id_col, columns) replaced, those of removed ids (id_col) gone."""
    fresh = postings(changed, id_col, columns)
    gone = fresh.select("doc").unionByName(removed.select(F.col(id_col).alias("doc"))).distinct()
    return index.join(gone, "doc", "left_anti").unionByName(fresh)


def _containing(items: list[tuple[str, list[str]]]):
    """Rows (number, doc): which rows (doc, text) hold which items (text, inner words).

    An item with inner words is sought in the texts that have all of them, any other in all texts. A batch is worked off in parts
    of a few MB of text.
    """
    most = SCAN_BYTES
    words = sorted({w for _, inner in items for w in inner})
    number = {w: k for k, w in enumerate(words)}
    inner_of = [np.array([number[w] for w in inner], int) for _, inner in items]

    def holders(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        lists = pc.split_pattern(texts, " ")
        values, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(pc.index_in(values, value_set=pa.array(words, values.type)), -1).to_numpy(zero_copy_only=False)
        hit = ids >= 0
        keys = np.unique(ids[hit].astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), lengths)[hit])
        to = np.searchsorted(keys, np.arange(len(words) + 1) * len(texts))
        size = np.diff(to)
        for k, (item, _) in enumerate(items):
            inner = inner_of[k]
            if not len(inner):
                yield k, np.flatnonzero(pc.match_substring(texts, item).to_numpy(zero_copy_only=False))
                continue
            inner = inner[np.argsort(size[inner], kind="stable")]  # the rarest here first
            rows = keys[to[inner[0]] : to[inner[0] + 1]] % len(texts)
            for w in inner[1:]:
                if not len(rows):
                    break
                rows = rows[np.isin(rows, keys[to[w] : to[w + 1]] % len(texts), assume_unique=True)]
            yield k, np.array([r for r in rows.tolist() if item in texts[r].as_py()], int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            begin = 0
            while begin < len(ends):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
                part = batch.slice(begin, end - begin)
                for k, rows in holders(part.column(1)):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k), pa.int32()), part.column(0).take(pa.array(rows))], ["number", "doc"])
                begin = end

    return run


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query, doc: which texts (doc, text) hold an item (query, item) word for word, as a substring.

    An inner word of an item has spaces on both sides, so it is a word of every text that holds the item. Items of one or
    two words have no inner one; they are compared with every text. Up to HELD_ITEMS go to the texts, of which nothing is
    shuffled. More of them are joined to texts by the inner word that fewest texts have, and what meets is compared whole.
    """
    inner_words = F.array_distinct(F.filter(F.slice(F.split("item", " "), 2, F.greatest(F.size(F.split("item", " ")) - 2, F.lit(0))), lambda w: w != ""))
    few = items.where("item is not null").select("query", "item", inner_words.alias("inner")).limit(HELD_ITEMS + 1).collect()
    if len(few) <= HELD_ITEMS:
        numbered = docs.sparkSession.createDataFrame([(k, r["query"]) for k, r in enumerate(few)], f"number int, query {items.schema['query'].dataType.simpleString()}")
        found = docs.select("doc", "text").mapInArrow(_containing([(r["item"], r["inner"]) for r in few]), f"number int, doc {docs.schema['doc'].dataType.simpleString()}")
        return found.join(F.broadcast(numbered), "number").select("query", "doc")
    inner = items.select("query", F.explode(inner_words).alias("word"))
    words = docs.select("doc", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    seen = stored(words.join(inner.select("word").distinct(), "word"), "golden-words")
    counted = inner.join(seen.groupBy("word").agg(F.count("*").alias("df")), "word", "left")
    rarest = counted.groupBy("query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("x")).select("query", F.col("x.word").alias("word"))
    met = seen.join(rarest, "word").select("query", "doc")
    long = met.join(docs, "doc").join(items, "query").where(F.contains("text", "item")).select("query", "doc")
    short = items.join(inner.select("query").distinct(), "query", "left_anti").where("item is not null")
    return long.unionByName(docs.join(short, F.contains("text", "item")).select("query", "doc"))


def bm25(index: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """query, doc, score of all hits in token lists (postings()); operators.index does the same from terms to texts. Phrases stay inside a column, hits of a phrase may overlap.

    The number of texts, their mean length and the frequencies are those of the whole index. Only tokens
    that occur in some query leave the scan.
    """
    terms = query_terms(queries)
    placed = lambda k: lambda t, i: F.struct(F.lit(k).alias("col"), i.alias("pos"), t.alias("term"))
    tagged = F.flatten(F.array(*[F.transform(F.col(c), placed(k)) for k, c in enumerate(columns)]))
    found = index.select("doc", "dl", F.explode(tagged).alias("x")).select("doc", "dl", "x.*").join(terms, "term")
    starts = found.groupBy("query", "phrase", "n", "doc", "dl", "col", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("matched")).where("matched = n")
    tf = starts.groupBy("query", "phrase", "doc", "dl").agg(F.count("*").alias("tf"))
    corpus = index.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("query", "phrase").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus))  # one row of corpus figures
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = tf.join(df.select("query", "phrase", "avgdl", F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)).alias("idf")), ["query", "phrase"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # a query has a few phrases: their parts are added in the phrases' order and rounded, so that scores don't depend on the shuffle
    in_order = F.array_sort(F.collect_list(F.struct("phrase", part.alias("part"))))
    total = F.aggregate(in_order, F.lit(0.0), lambda sum_so_far, x: sum_so_far + x["part"])
    return weighed.groupBy("query", "doc").agg(F.round(total, SCORE_DIGITS).alias("score"))


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query",), item: str = "doc") -> DataFrame:
    """The k best of each query with rank from 1: by score, then by id."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), item))).where(F.col("rank") <= k)


def vector_scores(vectors: DataFrame, queries: DataFrame, by: list[str]) -> DataFrame:
    """query, doc, score of vectors (doc, vector) against queries (query, vector) in the same group. Zero queries have no hits."""
    asked = queries.where(F.exists("vector", lambda x: x != 0)).select("query", F.col("vector").alias("_q"), *by)
    return vectors.join(asked, by).select("query", "doc", F.round(cosine(F.col("vector"), F.col("_q")), SCORE_DIGITS).alias("score")).where(F.col("score").isNotNull())


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, batch: int = QUERY_BATCH) -> DataFrame:
    """query, doc, score, rank: the k nearest of vectors (doc, vector) to each of queries (query, vector), all ids of any type.

    Up to `batch` queries go to all tasks and are multiplied with the vectors where these lie: a task keeps its k best for
    each query and Arrow batch, so few rows are shuffled. More queries meet the vectors in blocks (operators.vectors). Queries that
    are null, zero or not finite have no hits, vectors of another length or without a direction neither.
    """
    known = queries.where(V.finite()).select("query", "vector")
    ids = vectors.where(V.finite()).select("doc", "vector")
    asked = known.limit(batch + 1).collect()
    if len(asked) > batch:
        return V.nearest(ids, known, k)
    schema = f"query {known.schema['query'].dataType.simpleString()}, doc {ids.schema['doc'].dataType.simpleString()}, score double"
    return top_k(ids.mapInPandas(_nearest_to(sorted(((r["query"], list(r["vector"])) for r in asked), key=lambda r: str(r[0])), k), schema), k)


def _nearest_to(asked: list[tuple], k: int):
    """The k best vectors for each query in each Arrow batch, by products of matrices; queries and vectors of one length at a time."""
    lengths = sorted({len(v) for _, v in asked})
    matrices = {n: ([q for q, v in asked if len(v) == n], np.array([v for _, v in asked if len(v) == n], float)) for n in lengths}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, same in pdf.groupby(pdf["vector"].map(len)):
                if width not in matrices:
                    continue
                queries, matrix = matrices[width]
                m = np.stack(same["vector"].to_numpy()).astype(float)
                scores = np.round(m @ matrix.T / (np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(matrix, axis=1)) + 1e-9), SCORE_DIGITS)
                ids = same["doc"].to_numpy()
                best = [np.lexsort([ids, -scores[:, q]])[:k] for q in range(len(queries))]
                yield pd.DataFrame({"query": np.repeat(np.array(queries, object), [len(x) for x in best]), "doc": ids[np.concatenate(best)], "score": np.concatenate([scores[x, q] for q, x in enumerate(best)])})

    return run


def rrf(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """query, doc, score, first_list and best_rank: the sum of 1 / (k + rank) over ranked lists (query, doc, rank from 1)."""
    lists = [df.select("query", "doc", "rank", F.lit(i).alias("list")) for i, df in enumerate(ranked)]
    every = lists[0]
    for df in lists[1:]:
        every = every.unionByName(df)
    first = F.min(F.struct("list", "rank"))
    return every.groupBy("query", "doc").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), first.alias("x")).select("query", "doc", "score", F.col("x.list").alias("first_list"), F.col("x.rank").alias("best_rank"))


def fused_top(fused: DataFrame, k: int) -> DataFrame:
    """The k best of each query: by score, then by first appearance in the lists, then by id."""
    order = W.partitionBy("query").orderBy(F.desc("score"), "first_list", "best_rank", "doc")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weighed(fused: DataFrame, times: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """fused with the score times recency and, where the query names a window that holds the time, its boost.

    times: doc, at; queries: query, text.
    """
    windows = queries.select("query", D.query_window("text", now).alias("_w"))
    joined = fused.join(times, "doc", "left").join(windows, "query", "left")
    factor = D.recency_factor("at", now) * F.coalesce(D.time_factor("at", F.col("_w")), F.lit(1.0))
    return joined.withColumn("score", F.col("score") * factor).drop("at", "_w")


def hybrid_search(docs: DataFrame, queries: DataFrame, columns: list[str], vectors: DataFrame | None = None, times: DataFrame | None = None, now: Column | None = None, limit: int = 20, pool: int = 10, id_col: str = "doc") -> DataFrame:
    """query, doc, score, rank: BM25 and cosine lists of `limit`, fused, weighed, cut to max(pool, limit), then to limit.

    queries: query, text and, with vectors, vector.
    """
    lists = [inverted.best(inverted.kept(docs, id_col, columns), queries, limit)]
    if vectors is not None:
        lists.append(vector_top_k(vectors, queries, limit))
    fused = rrf(*lists)
    if times is not None:
        fused = weighed(fused, times, queries, now)
    return fused_top(fused_top(fused, max(pool, limit)).drop("rank"), limit)


def search(facts: DataFrame, entities: DataFrame, episodes: DataFrame, links: DataFrame, queries: DataFrame, now: Column, as_of: Column | None = None, limit: int = 20, pool: int = 10, seeds: int = 5, vectors: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The whole search for many queries (query, text, group_id and, with vectors, vector): facts, entities and episodes.

    Each kind is ranked by words and vectors among all groups, fused, and then cut to the query's group; facts and
    episodes are weighed by recency and by a time window that the query names. The best `pool` facts are cut first, and
    only then those go that don't hold at as_of (or have expired). Facts at the first `seeds` entities and at entities
    linked to these follow, up to twice the limit. facts gives query, uuid, position, score (null for followers).
    """
    vectors = vectors or {}

    def ranked(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
        of_group = df.select(F.col("uuid").alias("doc"), "group_id").join(queries.select("query", "group_id"), "group_id").select("query", "doc")
        lists = [inverted.bm25(inverted.kept(df, "uuid", columns), queries)]
        if kind in vectors:
            mine = df.select(F.col("uuid").alias("doc"), "group_id").join(vectors[kind].select(F.col("uuid").alias("doc"), "vector"), "doc")
            near = V.nearest(mine, queries.select("query", "group_id", "vector"), limit, "group_id")
            return rrf(top_k(lists[0].join(of_group, ["query", "doc"], "left_semi"), limit), near)
        return rrf(top_k(lists[0].join(of_group, ["query", "doc"], "left_semi"), limit))

    at = lambda df, *c: df.select(F.col("uuid").alias("doc"), F.coalesce(*c).alias("at"))
    reference = [c for c in ("reference_time", "valid_at") if c in facts.columns]
    found_entities = fused_top(ranked(entities, "entity", ["name", "summary"]), limit)
    found_episodes = fused_top(weighed(ranked(episodes, "episode", ["content", "name"]), at(episodes, "created_at"), queries, now), limit)
    best = fused_top(weighed(ranked(facts, "fact", ["fact", "name"]), at(facts, *reference), queries, now), pool)
    holding_now = temporal.as_of(facts, as_of) if as_of is not None else temporal.active(facts)
    direct = best.join(holding_now.select(F.col("uuid").alias("doc")), "doc", "left_semi").select("query", F.col("doc").alias("uuid"), F.lit(0).alias("part"), F.col("rank").alias("place"), "score")
    first = found_entities.where(F.col("rank") <= seeds).join(queries.select("query", "group_id"), "query").select("query", F.col("doc").alias("entity"), "rank", "group_id")
    around = graph.one_hop(first, holding_now, links, 2 * limit + pool).select("query", "uuid", F.lit(1).alias("part"), F.col("position").alias("place"), F.lit(None).cast("double").alias("score"))
    once = direct.unionByName(around).groupBy("query", "uuid").agg(F.min(F.struct("part", "place", "score")).alias("x")).select("query", "uuid", "x.*")
    order = F.row_number().over(W.partitionBy("query").orderBy("part", "place", "uuid"))
    kept = once.withColumn("position", order).where(F.col("position") <= 2 * limit).select("query", "uuid", "position", "score")
    return {"facts": kept, "entities": found_entities, "episodes": found_episodes}


def rerank(ranked: DataFrame, scores: DataFrame, pool: int = 10) -> DataFrame:
    """ranked (query, doc, score, rank) reordered by relevance from 0 to 10 (scores: query, doc, relevance).

    Only the first `pool` are reordered; unscored ones have 0, a query without any keeps its order.
    """
    head = ranked.where(F.col("rank") <= pool).join(scores, ["query", "doc"], "left")
    by = W.partitionBy("query")
    any_score = F.max("relevance").over(by).isNotNull()
    clamped = F.when(any_score, F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce("relevance", F.lit(0.0))))).otherwise(F.lit(0.0))
    new = F.row_number().over(by.orderBy(F.desc("relevance"), F.desc("score"), "rank"))
    out = head.withColumn("relevance", clamped).withColumn("rank", new)
    rest = ranked.where(F.col("rank") > pool).withColumn("relevance", F.lit(0.0))
    return out.select(*ranked.columns, "relevance").unionByName(rest.select(*ranked.columns, "relevance"))


def merged_groups(results: DataFrame) -> DataFrame:
    """Results of several groups (query, group_position, doc, score): a doc's first group counts and its best score there; best score first."""
    once = results.groupBy("query", "doc").agg(F.min(F.struct("group_position", (-F.col("score")).alias("low"))).alias("x")).select("query", "doc", (-F.col("x.low")).alias("score"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc")))


def evaluate(ranked: DataFrame, golden: DataFrame, at: int = 20) -> DataFrame:
    """hit_rate and mrr over the queries that expect something; golden: query, doc (null: nothing is expected)."""
    wanted = golden.where("doc is not null")
    hits = ranked.where(F.col("rank") <= at).join(wanted, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("first"))
    asked = wanted.select("query").distinct().join(hits, "query", "left")
    return asked.agg(F.count("*").alias("positives"), F.avg(F.col("first").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def length_norm(dl: float, avgdl: float) -> float:
    """The denominator's part that depends on a text's length, for tests."""
    return K1 * (1 - B + B * dl / avgdl) if avgdl else math.nan

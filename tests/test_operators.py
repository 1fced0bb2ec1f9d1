import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.operators import dedup, graph, ingest, retrieval, shuffles, temporal
from loreweave.sources import tables


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in shuffles.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert shuffles.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(shuffles, "SMALL", 0)
    left = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.col("id")).alias("k"), "id").union(spark.sql("select cast(null as long), 7L"))
    right = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).union(spark.sql("select 1L, 11L"))
    for how in ("inner", "left"):
        a = sorted(map(str, shuffles.join_unique(left, right, "k", 5001, how).select("k", "id", "v").collect()))
        assert a == sorted(map(str, left.join(right, "k", how).select("k", "id", "v").collect()))


def test_bm25_matches_sqlite(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["red", "green", "blue", "cafe", "the", "x9"]) for _ in range(rng.randrange(1, 30))), rng.choice(["red one", "the cafe", ""])) for i in range(40)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(a, b)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    db.executemany("INSERT INTO f(rowid, a, b) VALUES (?, ?, ?)", docs)
    asked = {1: "red", 2: "red blue red", 3: "red-green", 4: "the-cafe x9", 5: "none"}
    frame = spark.createDataFrame(docs, "doc long, a string, b string")
    got = {}
    for r in retrieval.bm25(retrieval.postings(frame, "doc", ["a", "b"]), spark.createDataFrame(list(asked.items()), "query long, text string"), ["a", "b"]).collect():
        got[(r.query, r.doc)] = r.score
    want = {}
    for q, text in asked.items():
        match = " OR ".join(f'"{w}"' for w in text.split())
        want |= {(q, i): -s for i, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
    assert got == pytest.approx(want)


def test_vector_batches_match_columns(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "doc long, vector array<float>")
    asked = spark.createDataFrame([(q, m[q].tolist()) for q in range(3)], "query long, vector array<float>")
    same = lambda df: df.withColumn("g", F.lit(1))
    a = retrieval.top_k(retrieval.vector_scores(same(vectors), same(asked), ["g"]), 5).collect()
    zero = spark.createDataFrame([(7, [0.0] * 8), (8, None), (9, [1.0])], asked.schema)
    for batch in (2048, 1):
        b = retrieval.vector_top_k(vectors, asked.union(zero), 5, batch).collect()
        assert {(r.query, r.doc, r["rank"]) for r in a} == {(r.query, r.doc, r["rank"]) for r in b}
    named = retrieval.vector_top_k(vectors.selectExpr("'d' || doc AS doc", "vector"), asked.selectExpr("'q' || query AS query", "vector"), 5).collect()
    assert {(r.query, r.doc) for r in named} == {(f"q{r.query}", f"d{r.doc}") for r in a}
    assert retrieval.vector_top_k(vectors, asked.limit(0), 5).count() == 0


def test_vector_pairs_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{i}", "hot" if i < 60 else f"g{i % 3}", rng.normal(size=3).tolist()) for i in range(90)]
    rows += [("n1", "hot", None), ("n2", None, [1.0, 0.0, 0.0]), (None, "hot", [1.0, 0.0, 0.0]), ("z", "hot", [0.0, 0.0, 0.0]), ("short", "hot", [1.0, 0.0]), ("nan", "hot", [math.nan, 0.0, 0.0]), ("twin", "hot", rows[0][2])]
    frame = spark.createDataFrame(rows, "uuid string, group_id string, vector array<double>")
    cos = lambda x, y: np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-9)
    whole = [r for r in rows if None not in r]
    want = {(a[1], a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and a[1] == b[1] and len(a[2]) == len(b[2]) and cos(a[2], b[2]) >= 0.5}
    for block in (7, 1024):
        got = [(r.group_id, r.a, r.b) for r in dedup.vector_pairs(frame, 0.5, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert dedup.vector_pairs(frame.where("false"), 0.5).count() == 0


def test_rrf_and_fused_order(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, doc int, rank int")
    two = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "query int, doc int, rank int")
    out = {r.doc: (r["rank"], r.score) for r in retrieval.fused_top(retrieval.rrf(one, two), 10).collect()}
    assert out[10] == (1, pytest.approx(1 / 61 + 1 / 62)) and out[12][0] == 2 and out[11] == (3, pytest.approx(1 / 62))


def test_evaluate(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (2, 6, 1), (2, 7, 5), (9, 1, 1)], "query int, doc int, rank int")
    golden = spark.createDataFrame([(1, 5), (2, 7), (3, 8), (9, None)], "query int, doc int")
    r = retrieval.evaluate(ranked, golden).first()
    assert (r.positives, r.hit_rate, r.mrr) == (3, pytest.approx(2 / 3), pytest.approx((1 + 0.2) / 3))


FACT = "uuid long, source_uuid long, target_uuid long, group_id string, name string, fact string, episodes array<long>, valid_at timestamp_ntz, invalid_at timestamp_ntz, expired_at timestamp_ntz"


def _facts(spark, *rows):
    base = {"uuid": 0, "source_uuid": 1, "target_uuid": 2, "group_id": "g", "name": "n", "fact": "f", "episodes": [1], "valid_at": None, "invalid_at": None, "expired_at": None}
    from datetime import datetime

    fixed = [{k: datetime.fromisoformat(v) if k.endswith("_at") and v else v for k, v in (base | r).items()} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in fixed], FACT)


def test_as_of_bounds(spark):
    t = "2024-05-01"
    facts = _facts(spark, {"uuid": 1}, {"uuid": 2, "valid_at": t}, {"uuid": 3, "invalid_at": t}, {"uuid": 4, "expired_at": "2024-06-01"}, {"uuid": 5, "valid_at": "2024-05-02"})
    at = F.lit(t).cast("timestamp_ntz")
    assert {r.uuid for r in temporal.as_of(facts, at).collect()} == {1, 2}
    assert {r.uuid for r in temporal.as_of(facts, at, bitemporal=True).collect()} == {1, 2, 4}


def test_loops_and_links(spark):
    facts = _facts(spark, {"uuid": 1, "target_uuid": 1}, {"uuid": 2})
    assert sorted((r.entity, r.uuid) for r in graph.incident(facts).collect()) == [(1, 1), (1, 2), (2, 2)]
    links = spark.createDataFrame([(1, 2, "same_as"), (2, 1, "same_as")], "a_uuid long, b_uuid long, kind string")
    assert sorted(map(tuple, graph.symmetric(links).collect())) == [(1, 2), (2, 1)]


def test_buckets_of_three_pair_the_first_two(spark):
    entities = spark.createDataFrame([(1, "My App", "g"), (2, "my app", "g"), (3, "MY APP", "g"), (4, "my-app", "h"), (5, "myapp", "h")], "uuid long, name string, group_id string")
    refs, none = spark.createDataFrame([(2, 9), (1, 3)], "uuid long, refs long"), spark.createDataFrame([], "uuid long, group_id string, vector array<float>")
    got = {(r.keep_uuid, r.remove_uuid): r.auto_reason for r in dedup.merge_candidates(entities, refs, none).collect()}
    assert got == {(2, 1): "归一化同名", (4, 5): "分隔符差异"}


def test_merges(spark):
    entities = spark.createDataFrame([(1, "a", "g", ["x", "y"], "same"), (2, "b", "g", ["y", "z"], "also"), (3, "c", "g", None, "longer one")], "uuid long, name string, group_id string, labels array<string>, summary string")
    facts = _facts(spark, {"uuid": 1, "source_uuid": 2, "target_uuid": 3})
    mentions = spark.createDataFrame([(7, 1), (7, 2)], "episode_uuid long, entity_uuid long")
    links = spark.createDataFrame([(1, 2, "same_as"), (2, 9, "same_as")], "a_uuid long, b_uuid long, kind string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "uuid long, vector array<float>")
    mapping = dedup.merge_map(spark.createDataFrame([(1, 2)], "keep_uuid long, remove_uuid long"))
    out = dedup.apply_merges(mapping, entities, facts, mentions, links, vectors)
    kept = {r.uuid: (r.labels, r.summary) for r in out["entities"].collect()}
    assert kept == {1: (["x", "y", "z"], "same"), 3: ([], "longer one")}
    assert [(r.source_uuid, r.target_uuid) for r in out["facts"].collect()] == [(1, 3)]
    assert [tuple(r) for r in out["mentions"].collect()] == [(7, 1)]
    assert [(r.a_uuid, r.b_uuid) for r in out["entity_links"].collect()] == [(1, 9)]
    assert [r.uuid for r in out["embeddings"].collect()] == [1]


def test_chains_of_merges(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "keep_uuid long, remove_uuid long")
    assert {r.remove_uuid: r.keep_uuid for r in dedup.merge_map(pairs).collect()} == {2: 1, 3: 1, 8: 9}


def test_forget(spark):
    facts = _facts(spark, {"uuid": 1, "episodes": [7]}, {"uuid": 2, "episodes": [7, 8]}, {"uuid": 3, "episodes": []})
    episodes, mentions = spark.createDataFrame([(7,), (8,)], "uuid long"), spark.createDataFrame([(7, 1), (8, 1)], "episode_uuid long, entity_uuid long")
    vectors = spark.createDataFrame([(7, [1.0]), (1, [1.0]), (2, [1.0])], "uuid long, vector array<float>")
    out = ingest.forget_episodes(episodes.where("uuid = 7"), episodes, facts, mentions, vectors)
    assert {r.uuid: r.episodes for r in out["facts"].collect()} == {2: [7, 8], 3: []}
    assert [r.uuid for r in out["embeddings"].collect()] == [2] and out["mentions"].count() == 1
    pruned = ingest.forget_episodes(episodes.where("uuid = 7"), episodes, facts, mentions, vectors, prune=True)
    assert {r.uuid: r.episodes for r in pruned["facts"].collect()} == {2: [8], 3: []}


def test_resolution(spark):
    entities = spark.createDataFrame([(1, "My App", "g"), (2, "tool", "g")], "uuid long, name string, group_id string")
    items = spark.createDataFrame([(1, "My App", "g", [1.0, 0.0]), (2, "my_app", "g", None), (3, "MyApp", "g", None), (4, "near", "g", [0.0, 1.0]), (5, "far", "g", [-1.0, 0.0])], "item long, name string, group_id string, vector array<float>")
    vectors = spark.createDataFrame([(2, "g", [0.1, 1.0])], "uuid long, group_id string, vector array<float>")
    got = {r.item: (r.uuid, r.layer) for r in ingest.resolve_entities(items, entities, vectors).collect()}
    assert got == {1: (1, "name"), 2: (1, "norm"), 3: (1, "alnum"), 4: (2, "vector"), 5: (None, "new")}
    text = lambda df, *c: df.withColumns({x: F.concat(F.lit("u"), F.col(x)) for x in c})
    more = text(items, "item").union(spark.createDataFrame([("z1", "Zed", "g", None), ("z2", "zed!", "g", None), ("z3", "zed", "h", None)], text(items, "item").schema))
    named = {r.item: (r.uuid, r.layer, r.same_as) for r in ingest.resolve_entities(more, text(entities, "uuid"), text(vectors, "uuid")).collect()}
    assert named["u4"] == ("u2", "vector", None) and [named[z][2] for z in ("z1", "z2", "z3", "u5")] == ["z1", "z1", "z3", "u5"]


def test_links_types_and_ends(spark):
    links = spark.createDataFrame([(1, 2, "same_as"), (3, 4, "same_as")], "a_uuid long, b_uuid long, kind string")
    assert [tuple(r) for r in ingest.remove_links(links, spark.createDataFrame([(2, 1)], "a_uuid long, b_uuid long")).collect()] == [(3, 4, "same_as")]
    items = spark.createDataFrame([("a", "Tool"), ("b", "Other"), ("c", None)], "name string, entity_type string")
    assert [r.name for r in ingest.of_types(items, ("Tool", "Person")).collect()] == ["a"]
    facts = spark.createDataFrame([("a", "b", "f"), ("a", "x", "g"), (None, "b", "h")], "source_name string, target_name string, fact string")
    resolved = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("x", None)], "name string, uuid string")
    assert [(r.source_uuid, r.target_uuid, r.fact) for r in ingest.with_ends(facts, resolved).collect()] == [("u1", "u2", "f")]


def test_index_follows_changes(spark):
    docs = spark.createDataFrame([(1, "red"), (2, "blue"), (3, "green")], "id long, t string")
    index = retrieval.synced_postings(retrieval.postings(docs, "id", ["t"]), spark.createDataFrame([(2, "red red"), (4, "new")], "id long, t string"), docs.where("id = 3"), "id", ["t"])
    assert {r.doc: (r.t, r.dl) for r in index.collect()} == {1: (["red"], 1), 2: (["red", "red"], 2), 4: (["new"], 1)}


def test_texts_that_hold_items(spark):
    docs = [(1, "one two three four five"), (2, "xone two three fourx"), (3, "two three"), (4, ""), (5, None), (6, "one  two three four")]
    items = [(1, "one two three four"), (2, "two three"), (3, "five"), (4, "missing words are here"), (5, None)]
    got = retrieval.holding(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "query long, item string")).collect()
    assert sorted((r.query, r.doc) for r in got) == sorted((q, d) for q, i in items for d, t in docs if i and t and i in t)


@pytest.mark.parametrize(("held", "size"), [(5000, 4_000_000), (5000, 1), (3, 1)])
def test_texts_that_hold_items_however_many(spark, monkeypatch, held, size):
    monkeypatch.setattr(retrieval, "HELD_ITEMS", held)
    monkeypatch.setattr(retrieval, "SCAN_BYTES", size)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "", "dd"]) for _ in range(rng.randrange(12)))) for i in range(80)] + [(99, None)]
    items = [(q, " ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(rng.randrange(1, 5)))) for q in range(20)] + [(30, None), (31, ""), (32, "a  b c")]
    got = retrieval.holding(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "query long, item string")).collect()
    assert sorted((r.query, r.doc) for r in got) == sorted((q, d) for q, i in items for d, t in docs if i is not None and t is not None and i in t)


def test_groups_merge_by_their_first(spark):
    rows = [(1, 0, 7, 0.5), (1, 1, 7, 0.9), (1, 1, 8, 0.6), (1, 1, 8, 0.7), (2, 0, 7, 0.1)]
    got = retrieval.merged_groups(spark.createDataFrame(rows, "query long, group_position int, doc long, score double")).collect()
    assert sorted((r.query, r.rank, r.doc, r.score) for r in got) == [(1, 1, 8, 0.7), (1, 2, 7, 0.5), (2, 1, 7, 0.1)]


def test_whole_search(spark):
    facts = _facts(spark, {"uuid": 1, "source_uuid": 10, "target_uuid": 11, "fact": "nginx listens", "valid_at": "2024-01-01"}, {"uuid": 2, "source_uuid": 10, "target_uuid": 12, "fact": "other thing", "valid_at": "2024-02-01"}, {"uuid": 3, "source_uuid": 20, "target_uuid": 21, "fact": "far away", "group_id": "h"}, {"uuid": 4, "fact": "nginx old", "expired_at": "2024-01-02"}, {"uuid": 5, "fact": "nginx of h", "group_id": "h"}, {"uuid": 6, "fact": "nginx future", "valid_at": "2025-01-01"})
    entities = spark.createDataFrame([(10, "nginx", "g", ""), (20, "proxy", "h", "")], "uuid long, name string, group_id string, summary string")
    episodes = spark.createDataFrame([(100, "g", "nginx was set up", "e", "2024-01-01"), (101, "h", "nginx too", "e", "2024-01-01")], "uuid long, group_id string, content string, name string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    links = spark.createDataFrame([(10, 20, "same_as")], "a_uuid long, b_uuid long, kind string")
    queries = spark.createDataFrame([(1, "nginx", "g")], "query long, text string, group_id string")
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    out = retrieval.search(facts, entities, episodes, links, queries, now, as_of=now)
    got = [(r.uuid, r.score is None) for r in out["facts"].orderBy("position").collect()]
    assert got == [(1, False), (2, True), (3, True)]
    assert [r.doc for r in out["entities"].collect()] == [10] and [r.doc for r in out["episodes"].collect()] == [100]
    current = [r.uuid for r in retrieval.search(facts, entities, episodes, links, queries, now)["facts"].collect()]
    assert set(current) == {1, 2, 3, 6}


def test_upsert_keeps_immutable_columns(spark):
    old = spark.createDataFrame([(1, "g", "a"), (2, "g", "b")], "uuid long, group_id string, v string")
    new = spark.createDataFrame([(1, "h", "c"), (3, "h", "d")], "uuid long, group_id string, v string")
    got = {r.uuid: (r.group_id, r.v) for r in ingest.upsert(old, new, "uuid", ("group_id",)).collect()}
    assert got == {1: ("g", "c"), 2: ("g", "b"), 3: ("h", "d")}
    tables.bootstrap(spark, "lore_upsert")
    try:
        target = spark.table("lore_upsert.entities")
        change = spark.sql("select 'e1' uuid, 'n' name, 'g' group_id, array('x') labels, 's' summary, map('k', v) attributes, timestamp'2024-01-01' + make_dt_interval(i) created_at from values ('a', 1), ('b', 2) as t(v, i)")
        assert [r.attributes for r in ingest.upsert(target, change, "uuid", tables.IMMUTABLE["entities"], "created_at").collect()] == [{"k": "b"}]
    finally:
        spark.sql("DROP DATABASE lore_upsert CASCADE")


def test_bootstrap_is_idempotent(spark):
    for _ in range(2):
        tables.bootstrap(spark, "lore_test")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN lore_test").collect()} == set(tables.SCHEMAS)
    spark.sql("DROP DATABASE lore_test CASCADE")


def test_length_norm():
    assert retrieval.length_norm(10, 10) == pytest.approx(1.2) and math.isnan(retrieval.length_norm(1, 0))


def test_linked_counts_in_small_tasks(spark, monkeypatch):
    rows = [(a % 7, a % 5) for a in range(60)] + [(3, 3), (None, 2), (2, None), (1, 4), (4, 1)]
    links = spark.createDataFrame(rows, "a_uuid long, b_uuid long")
    want = {r.entity: r.n for r in graph.symmetric(links).groupBy("entity").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(shuffles, "PARTITION_ROWS", 2)
    found = graph.linked_counts(links)
    assert {r.entity: r.n_linked for r in found.collect()} == want
    assert f"hashpartitioning(a#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 33), REPARTITION_BY_NUM" in plan  # 65 links


def test_large_joins_are_not_sent_to_the_driver(spark, monkeypatch):
    pairs = [(k - 1, k) for k in range(1, 40) if k % 5]
    frame = spark.createDataFrame(pairs, "keep_uuid long, remove_uuid long")
    want = {k: k - k % 5 for k in range(40)}
    for large in (10**6, 3):
        monkeypatch.setattr(shuffles, "SMALL", 3)
        monkeypatch.setattr(shuffles, "LARGE", large)
        first, _ = dedup.merge_state(frame.where("remove_uuid % 2 = 0"))
        after = dedup.merge_state(frame.where("remove_uuid % 2 = 1"), first)[0]
        assert {r.node: r.head for r in after.collect()} == want
        plan = shuffles.join_unique(frame, frame.select("remove_uuid", F.lit(1).alias("one")), "remove_uuid", 32)._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=merge" in plan) == (large == 3)

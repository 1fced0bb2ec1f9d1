"""Resolved facts against a loop, merges in steps, rewritten groups, bucketed tables, tolerant JSON."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreweave.functions import json as J
from loreweave.operators import dedup, ingest
from loreweave.operators import fact_resolution as R
from loreweave.operators.shuffles import shared_folder
from loreweave.sources import writes

FACTS = "uuid long, name string, fact string, source_uuid string, target_uuid string, group_id string, episodes array<long>, valid_at timestamp_ntz, invalid_at timestamp_ntz, expired_at timestamp_ntz, reference_time timestamp_ntz"
ITEMS = "item long, episode long, uuid long, name string, fact string, source_uuid string, target_uuid string, group_id string, valid_at timestamp_ntz, invalid_at timestamp_ntz, reference_time timestamp_ntz"
DAY = datetime(2024, 1, 1)


def random_facts(seed, n_facts=60, n_items=40):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.15 else DAY + timedelta(days=rng.randrange(30))
    end = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    facts = [(k, "p", "f", end(), end(), rng.choice("gh"), [1000 + k], at(), None, DAY if rng.random() < 0.1 else None, DAY) for k in range(n_facts)]
    items = [(k, 5000 + k if k % 4 else 1000 + k % n_facts, 100 + k, "p", "f", end(), end(), rng.choice("gh"), at(), None, DAY + timedelta(days=40 + k)) for k in range(n_items)]
    return rng, facts, items


def test_touching_equals_a_loop(spark):
    _, facts, items = random_facts(1, 200)
    got = {}
    for r in R.touching(spark.createDataFrame(items, ITEMS), spark.createDataFrame(facts, FACTS), 5).orderBy("item", "position").collect():
        got.setdefault(r.item, []).append(r.uuid)
    want = {}
    for i in items:
        if i[5] is None or i[6] is None:
            continue
        seen = []
        for e in (i[5], i[6]):
            for f in facts:
                if f[9] is None and f[5] == i[7] and None not in (f[3], f[4]) and e in (f[3], f[4]) and (f[3], f[4]) != (i[5], i[6]) and f[0] not in seen:
                    seen.append(f[0])
        if seen:
            want[i[0]] = seen[:5]
    assert got == want
    n = {r.item: r.n for r in R.related(spark.createDataFrame(items, ITEMS), spark.createDataFrame(facts, FACTS)).collect()}
    assert n == {i[0]: c for i in items if (c := sum(f[9] is None and None not in (f[3], f[4]) and (f[3], f[4], f[5]) == (i[5], i[6], i[7]) for f in facts))}


@pytest.mark.parametrize("seed", [2, 3])
def test_decisions_equal_a_loop(spark, seed):
    rng, facts, items = random_facts(seed)
    said = [(i[0], rng.choice(facts)[0], rng.choice(["duplicate", "contradiction", "contradiction"]), rng.randrange(3)) for i in items for _ in range(5)]
    after = {f[0]: {"episodes": set(f[6]), "invalid": f[8], "expired": f[9] is not None, "ref": f[10]} for f in facts}
    known, ended = {f[0]: f for f in facts if f[9] is None}, set()
    for i in items:
        mine = sorted({(p, u, v) for k, u, v, p in said if k == i[0] and u in known and known[u][5] == i[7]})
        same = next((u for p, u, v in mine if v == "duplicate" and i[5] and i[6] and known[u][3:5] == (i[5], i[6])), None)
        begins = known[same][7] if same is not None else i[8]
        if same is None:
            after[i[2]] = {"episodes": {i[1]}, "invalid": i[9], "expired": False, "ref": i[10]}
        elif i[1] not in known[same][6]:
            after[same]["ref"] = i[10]
        own = i[2] if same is None else same
        after[own]["episodes"].add(i[1])
        against = [u for p, u, v in mine if v == "contradiction" and u != same]
        if begins is None or not against:
            continue
        newer = [u for u in against if known[u][7] and known[u][7] > begins]
        for u, until in [(own, known[newer[0]][7])] if newer else [(u, begins) for u in against]:
            if u not in ended:
                ended.add(u)
                after[u].update(invalid=until, expired=True)
    told = spark.createDataFrame(said, "item long, uuid long, verdict string, position int")
    got = R.apply_decisions(spark.createDataFrame(items, ITEMS), spark.createDataFrame(facts, FACTS), told, F.lit("2024-06-01")).collect()
    assert {r.uuid: {"episodes": set(r.episodes), "invalid": r.invalid_at, "expired": r.expired_at is not None, "ref": r.reference_time} for r in got} == after
    assert len(got) == len(after)
    assert R.apply_decisions(spark.createDataFrame(items, ITEMS), spark.createDataFrame([], FACTS), told.where("false"), F.lit("2024-06-01")).count() == len(items)


def test_dated(spark):
    rows = [(1, "2018年3月至2022年6月在职", None, None), (2, "2018年", "2020-05-01", "2021-01-01"), (3, "", "soon", None), (4, None, None, None)]
    items = spark.createDataFrame(rows, "item long, fact string, valid_at string, invalid_at string").withColumn("reference_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.item: (str(r.valid_at)[:10], r.invalid_at and str(r.invalid_at)[:10]) for r in R.dated(items).collect()}
    assert got == {1: ("2018-03-01", "2022-06-01"), 2: ("2020-05-01", "2021-01-01"), 3: ("2024-01-01", None), 4: ("2024-01-01", None)}


def test_merges_in_steps(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    frame = lambda rows: spark.createDataFrame(rows, "keep_uuid long, remove_uuid long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(dedup.merge_state(frame(pairs))[0])
    state, old = None, []
    for at in range(0, 46, 16):
        state, changed = dedup.merge_state(frame(pairs[at : at + 16]), state)
        now = rows(state)
        assert rows(changed) == sorted(set(now) - set(old))
        old = now
    assert old == whole
    again, changed = dedup.merge_state(frame([]), state)
    assert rows(again) == whole and not changed.count()
    mapping = {(r.remove_uuid, r.keep_uuid) for r in dedup.merge_map(frame(pairs)).collect()}
    assert {(n, h) for n, h, _ in whole if n != h} == mapping


def files(spark, name):
    return {f for f in spark.table(name).inputFiles()}


def test_groups_keep_their_files(spark):
    rows = [(f"u{k}", "abc"[k % 3] if k < 9 else None, f"n{k}", [float(k)]) for k in range(10)]
    table = spark.createDataFrame(rows, "uuid string, group_id string, name string, vector array<double>")
    table.repartition("group_id").write.partitionBy("group_id").option("path", shared_folder(spark, "groups")).saveAsTable("rewritten")
    try:
        before = files(spark, "rewritten")
        vectors = spark.createDataFrame([("u0", "z", [9.0]), ("u3", "a", [8.0]), ("v1", "d", [7.0])], "uuid string, group_id string, vector array<double>")
        writes.upsert_groups(spark, "rewritten", vectors)
        want = sorted(map(str, ingest.upsert(table, vectors, "uuid", ("group_id",)).select("uuid", "group_id", "name", "vector").collect()))
        assert sorted(map(str, spark.table("rewritten").select("uuid", "group_id", "name", "vector").collect())) == want
        kept = before & files(spark, "rewritten")
        assert all("group_id=a" not in f for f in kept) and {f for f in before if "group_id=a" not in f} == kept
        writes.delete_rows(spark, "rewritten", spark.createDataFrame([("v1",), ("u9",), ("u1",)], "uuid string"))
        assert {r.uuid for r in spark.table("rewritten").collect()} == {f"u{k}" for k in range(9)} - {"u1"}
        with pytest.raises(ValueError):
            writes.upsert_groups(spark, "rewritten", vectors, immutable=())
    finally:
        spark.sql("DROP TABLE IF EXISTS rewritten")


def test_buckets_need_no_exchange(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.range(1000).select(F.col("id").alias("uuid"), (F.col("id") % 7).alias("v"))
    a, b = (writes.bucketed(df, "uuid", 4) for _ in range(2))
    try:
        joined = spark.table(a).hint("merge").join(spark.table(b).withColumnRenamed("v", "w"), "uuid").groupBy("uuid").count()
        assert "Exchange" not in plan(joined) and joined.count() == 1000
        one = writes.get_one(spark, a, 7)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't show the buckets it reads
        assert "SelectedBucketsCount: 1 out of 4" in plan(writes.get_one(spark, a, 7)) and [tuple(r) for r in one.collect()] == [(7, 0)]
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        ids = spark.createDataFrame([(3,), (3,), (5000,), (None,)], "uuid long")
        many = writes.get_many(spark, a, ids)
        assert plan(many).count("Exchange hashpartitioning") == 1 and [tuple(r) for r in many.collect()] == [(3, 3)]
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        for name in (a, b):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_tolerant_json(spark):
    texts = ['{"a": 1, "b": {"c": [2]}}', '["x", 2, null]', '{"a": 1', "", None, "nonsense", "[]", "{}", '"text"', "3"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(J.json_map("t").alias("m"), J.json_list("t").alias("l"), J.broken_json("t").alias("b")).collect()
    assert [r.m for r in got] == [{"a": "1", "b": '{"c":[2]}'}] + [{}] * 9
    assert [r.l for r in got] == [[], ["x", "2", None]] + [[]] * 8
    assert [r.b for r in got] == [False, False, True, False, False, True, False, False, False, False]

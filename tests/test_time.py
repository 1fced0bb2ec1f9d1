"""Facts that come late, facts that hold at a time, links as classes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreweave.functions import rules
from loreweave.functions import text as T
from loreweave.operators import dedup, graph, temporal
from loreweave.streaming import ingest as streams

DAY = datetime(2024, 1, 1)


def _stream(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


FACT = "source_uuid long, name string, uuid long, valid_at timestamp_ntz"


def test_late_facts_end_where_they_should(spark, tmp_path):
    day = lambda n: DAY + timedelta(days=n)
    first = [(1, "a", 1, day(0)), (1, "a", 2, day(19)), (1, "a", 3, day(24)), (None, "a", 9, day(1))]
    late = [(1, "a", 4, day(9)), (1, "a", 2, day(19)), (None, "a", 10, day(3)), (1, "b", 5, day(2))]
    got = {r.uuid: r.invalid_at for r in streams.supersessions(_stream(spark, f"{tmp_path}/in", [first, late], FACT), ["source_uuid", "name"]).collect()}
    assert got == {1: day(9), 4: day(19), 2: day(24), 9: day(3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_same_ends(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), rng.choice("ab"), k, DAY + timedelta(hours=rng.randrange(300))) for k in range(200)]
    shuffled = rng.sample(rows, len(rows))
    batches = [shuffled[k::5] for k in range(5)]
    batches[3] += batches[1][:10]  # some come again
    got = streams.supersessions(_stream(spark, f"{tmp_path}/in", batches, FACT), ["source_uuid", "name"])
    want = temporal.supersede(spark.createDataFrame(rows, FACT).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz")), ["source_uuid", "name"]).where("invalid_at is not null")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_facts_that_hold_at_a_time(spark):
    rng = random.Random(4)
    at = lambda: DAY + timedelta(microseconds=rng.randrange(10**rng.randrange(1, 14)))
    facts = [(k, rng.choice(["x", "y", None]), a, b, "f") for k in range(150) for a, b in [sorted((at(), at()))]]
    facts += [(200, "x", None, None, "f"), (201, "x", DAY, DAY, "f"), (202, "x", None, DAY + timedelta(seconds=1), "f"), (203, "x", DAY + timedelta(seconds=1), None, "f"), (204, "x", DAY + timedelta(9), DAY, "f")]
    probes = [(k, rng.choice(["x", "y", None]), at() if k % 9 else None, "p") for k in range(80)] + [(500, "x", facts[0][2], "p"), (501, "x", facts[0][3], "p"), (502, "x", DAY + timedelta(seconds=1), "p")]
    f = spark.createDataFrame(facts, "uuid long, k string, valid_at timestamp_ntz, invalid_at timestamp_ntz, note string")
    p = spark.createDataFrame(probes, "probe long, k string, at timestamp_ntz, note string")
    found = temporal.holding_join(p, f, ["k"])
    want = [(q, u) for q, k, t, _ in probes for u, g, a, b, _ in facts if k is not None and k == g and t is not None and (a is None or a <= t) and (b is None or t < b)]
    assert sorted((r.probe, r.uuid) for r in found.collect()) == sorted(want)
    assert found.columns == ["probe", "k", "at", "note", "uuid", "valid_at", "invalid_at", "fact_note"]
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert temporal.holding_join(p.where("false"), f, ["k"]).count() == 0 == temporal.holding_join(p, f.where("false"), ["k"]).count()


def test_few_facts_of_a_key_need_no_grids(spark, monkeypatch):
    rng = random.Random(8)
    when = lambda: DAY + timedelta(hours=rng.randrange(200)) if rng.random() < 0.8 else None
    facts = [(k, rng.choice([1, 1, 1, 2, 3, None]), when(), when()) for k in range(60)]
    probes = [(k, rng.choice([1, 2, 3, 4, None]), when()) for k in range(60)]
    f = spark.createDataFrame(facts, "uuid long, k long, valid_at timestamp_ntz, invalid_at timestamp_ntz")
    p = spark.createDataFrame(probes, "uuid long, k long, at timestamp_ntz")
    want = sorted((x[0], y[0]) for x in probes for y in facts if x[1] and x[1] == y[1] and x[2] and (not y[2] or y[2] <= x[2]) and (not y[3] or x[2] < y[3]))
    for plain, grids in ((64, False), (15, True), (0, True)):
        monkeypatch.setattr(temporal, "PLAIN", plain)
        found = temporal.holding_join(p, f, ["k"])
        assert sorted((r.uuid, r.fact_uuid) for r in found.collect()) == want
        assert ("Generate" in found._jdf.queryExecution().optimizedPlan().toString()) == grids


def test_link_classes_and_pairs(spark, monkeypatch):
    rng = random.Random(3)
    names = ["My App", "my app", "my-app", "myapp", "Other", "", None, "MY  APP"]
    entities = [(k, rng.choice(names), f"g{rng.randrange(4)}") for k in range(120)]
    frame = spark.createDataFrame(entities, "uuid long, name string, group_id string")
    forms = {r.name: (r.n, r.a) for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", T.norm_name("name").alias("n"), T.alnum_only("name").alias("a")).collect()}
    shared = lambda x, y: [k + 1 for k in (0, 1) if forms[x][k] and forms[x][k] == forms[y][k]]
    want = sorted((a[0], b[0], min(shared(a[1], b[1]))) for a in entities for b in entities if a[0] < b[0] and a[2] != b[2] and shared(a[1], b[1]))
    for block in (512, 7):
        monkeypatch.setattr(dedup, "CLASS_BLOCK", block)
        assert sorted((r.a_uuid, r.b_uuid, r.kind) for r in dedup.link_pairs(frame).collect()) == want
    for r in dedup.link_classes(frame).collect():
        members = [e for e in entities if forms[e[1]][r.kind - 1] == r.key]
        assert (r.members, r.groups, r.pairs) == (len(members), len({e[2] for e in members}), sum(a[2] != b[2] for i, a in enumerate(members) for b in members[:i]))
    links = spark.createDataFrame([(want[0][1], want[0][0], "same_as")], "a_uuid long, b_uuid long, kind string")
    candidates = dedup.link_candidates(frame, links)
    assert {(r.a_uuid, r.b_uuid) for r in candidates.collect()} == {w[:2] for w in want[1:]}
    after, made = dedup.apply_links(links, candidates, 5)
    assert made.count() == 5 and after.count() == 6
    again, _ = dedup.apply_links(after, candidates, 5)
    assert again.count() == 6


def test_pairs_of_links_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    entities = [(k, rng.choice(["My App", "my app", "my-app", "myapp", "@s/app", "x/app", "xapp", "--", "-"]), f"g{rng.randrange(4)}") for k in range(90)]
    frame = spark.createDataFrame(entities, "uuid long, name string, group_id string")
    links = spark.createDataFrame([(b, a) for a in range(0, 90, 2) for b in range(90)], "a_uuid long, b_uuid long")
    for block in (512, 7):
        monkeypatch.setattr(dedup, "CLASS_BLOCK", block)
        found = dedup.link_candidates(frame, links)
        above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
        assert "Aggregate" not in above and "Repartition" not in above  # what lies above the first join handles pairs
        every = {(r.a_uuid, r.b_uuid): (r.auto_link, r.auto_reason) for r in dedup.link_candidates(frame).collect()}
        assert {(r.a_uuid, r.b_uuid): (r.auto_link, r.auto_reason) for r in found.collect()} == {k: v for k, v in every.items() if k[0] % 2 and k[1] % 2}
        ruled = spark.createDataFrame([(*k, dict((e[0], e[1]) for e in entities)[k[0]], dict((e[0], e[1]) for e in entities)[k[1]]) for k in every], "a long, b long, x string, y string").select("a", "b", rules.auto_merge(F.col("x"), F.col("y"), F.lit(None).cast("double")).alias("r"))
        assert {(r.a, r.b): tuple(r.r) for r in ruled.collect()} == every
        linked = sorted(k for k, v in every.items() if v[0] and k[0] % 2 and k[1] % 2)
        for limit in (1, 30, 10**6):
            assert [(r.a_uuid, r.b_uuid) for r in dedup.first_links(frame, links, limit).collect()] == linked[:limit]
        monkeypatch.setattr(dedup, "MOST_FIRST", 0)
        assert [(r.a_uuid, r.b_uuid) for r in dedup.first_links(frame, links, 30).collect()] == linked[:30]


def test_members_of_one_name_and_group_are_copied_as_one_row(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CLASS_BLOCK", 20)
    entities = [(k, "my app" if k % 2 else "My App", f"g{k // 2 % 2}") for k in range(100)] + [(7, "my app", "g0"), (200, None, "g0"), (201, "my app", None)]
    frame = spark.createDataFrame(entities, "uuid long, name string, group_id string")
    kind, dealt = type(frame), []
    monkeypatch.setattr(kind, "repartition", lambda self, *a, f=kind.repartition: dealt.append(self.count()) or f(self, *a))
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(entities) for b in entities[:i] if a[0] != b[0] and a[1] and b[1] and a[2] and b[2] and a[2] != b[2])
    assert sorted((r.a_uuid, r.b_uuid) for r in dedup.link_candidates(frame).collect()) == want
    blocks, profiles = 6, 5  # two names in two groups, one name without a group
    assert len(dealt) == 2 and sum(dealt) <= blocks * (blocks + 1) * profiles < len(entities) * (blocks + 1)


def test_history_of_the_nearest_name(spark):
    entities = spark.createDataFrame([(1, "nginx", "g"), (2, "proxy", "g"), (3, "nginx", "h")], "uuid long, name string, group_id string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "uuid long, vector array<double>")
    facts = spark.createDataFrame([(10, 1, 9, "g", DAY, None), (11, 2, 9, "g", DAY, None), (12, 3, 9, "h", DAY, None), (13, 1, 2, "g", DAY + timedelta(1), DAY)], "uuid long, source_uuid long, target_uuid long, group_id string, valid_at timestamp_ntz, expired_at timestamp_ntz")
    names = spark.createDataFrame([("nginx", "g", None), ("ngin", "g", [0.9, 0.1]), ("prox", "g", [0.1, 0.9]), ("zzz", "none", [1.0, 0.0])], "name string, group_id string, vector array<double>")
    assert sorted((r.of, r.entity, r.uuid) for r in graph.history_or_nearest(facts, entities, names, vectors).collect()) == [("ngin", 1, 10), ("nginx", 1, 10), ("prox", 2, 11)]


def test_lines_and_accents(spark):
    one = spark.range(1)
    line = one.select(T.fact_line(F.lit("f"), F.lit(DAY), F.lit(None).cast("timestamp")), T.fact_line(F.lit("f"), F.lit(None).cast("timestamp"), F.lit(DAY)), T.entity_line(F.lit("n"), F.array().cast("array<string>"), F.lit("s" * 90)), T.episode_line(F.lit("x" * 130))).first()
    assert list(line) == ["  • f [2024-01-01 → 现在]", "  • f", "  • n (Entity) — " + "s" * 80, "  • " + "x" * 120]
    assert one.select(T.tokens(F.lit("étude naïve 東京"))).first()[0] == ["etude", "naive", "東", "京"]

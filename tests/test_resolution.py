"""Resolution in order of arrival against a loop over items."""

import random

from pyspark.sql import functions as F

from loreweave.functions import rules
from loreweave.operators import resolution

NAMES = ["My App", "my app", "my-app", "myapp", "MY_APP", "@a/web", "@b/web", "web", "~/.pi", "pi", "/a/x/", "/A/x", "\\a\\x", "www.ex.com", "ex.com", "EX.com", "!!!", "", " my app ", "my.app", "a b", "a-b", "ab", "东京", None]


def test_equals_a_loop(spark):
    frame = spark.createDataFrame([(a, b) for a in NAMES for b in NAMES], "a string, b string")
    one = {(r.a, r.b): r.yes for r in frame.select("a", "b", rules.auto_merge(F.trim("a"), F.trim("b"), F.lit(None).cast("double"))["auto_merge"].alias("yes")).collect()}
    rng = random.Random(6)
    entities = [(f"u{k:02}", rng.choice(NAMES), rng.choice("gh")) for k in range(6)]
    items = [(k, rng.choice(NAMES), rng.choice("gh")) for k in range(90)]
    want, pool = [], {g: [(n, u, None) for u, n, e in sorted(entities) if e == g] for g in "gh"}
    for k, name, g in items:
        if not (name or "").strip():
            want.append((k, None, None))
            continue
        hit = next(((u, i) for n, u, i in pool[g] if one[name, n]), None)
        if hit is None:
            pool[g].append((name, None, k))
        want.append((k, *(hit or (None, k))))
    got = resolution.resolve_in_order(spark.createDataFrame(items, "item long, name string, group_id string"), spark.createDataFrame(entities, "uuid string, name string, group_id string"))
    assert sorted((r.item, r.uuid, r.same_as) for r in got.collect()) == want


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a", "g"), (2, "A", "g")], "item long, name string, group_id string")
    none = spark.createDataFrame([], "uuid string, name string, group_id string")
    assert {r.item: r.same_as for r in resolution.resolve_in_order(items, none).collect()} == {1: 1, 2: 1}
    assert resolution.resolve_in_order(items.where("false"), none).count() == 0

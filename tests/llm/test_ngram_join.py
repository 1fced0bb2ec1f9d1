import random
from collections import Counter
from itertools import combinations

from loreweave.llm import ngram_join as J
from tests.llm import cases


def _sets(text):
    w = text.encode().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def _brute(rows):
    texts = {}
    for d, t in rows:
        if t and _sets(t):
            texts.setdefault(t, []).append(d)
    sets = {t: _sets(t) for t in texts}
    linked = [(a, b) for a, b in combinations(texts, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = {t: {t} for t in texts}
    for a, b in linked:
        both = group[a] | group[b]
        for t in both:
            group[t] = both
    out = Counter()
    for d, t in rows:
        if t not in texts:
            out[(d, d, 0, 0)] += 1
            continue
        near = [b if a == t else a for a, b in linked if t in (a, b)]
        out[(d, min(x for g in group[t] for x in texts[g]), len(near), sum(len(texts[x]) for x in near) + len(texts[t]) - 1)] += 1
    return out


def _got(df):
    return Counter((r.doc_id, r.class_id, r.n_text_links, r.n_links) for r in J.join(df).collect())


def _copies(seed=0):
    rng, rows = random.Random(seed), []
    for base in range(6):
        words = cases.words(120, 50 + base).split()
        for _ in range(rng.randrange(1, 14)):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                rows.append((len(rows), " ".join(copy)))
    return rows


def test_matches_brute_force(spark):
    rows = _copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(df) == _brute(rows)


def test_blocks_match_brute_force(spark, monkeypatch):
    rows = _copies(1)
    monkeypatch.setattr(J, "BLOCK_TEXTS", 3)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


def test_depths_reach_the_recall():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [sorted((rng.randrange(1, 10 ** rng.randrange(1, 6)) for _ in range(J.DEPTH - J.LEAST + 1)), reverse=True) for _ in range(rng.randrange(J.TREES + 1))]
        depths = J.shorten(sizes, 0.8, 1 - 1e-6)
        assert J.recall(0.8, [*depths, *[J.LEAST] * (J.TREES - len(sizes))]) >= 1 - 1e-6
        assert all(J.LEAST <= d <= J.DEPTH for d in depths)


def test_crowded_tries_keep_long_prefixes():
    quiet, crowded = [2, 2, 1, 1, 1], [10**6, 10**5, 10**4, 1000, 100]
    depths = J.shorten([crowded] * 5 + [quiet] * 35, 0.8, 1 - 1e-6)
    assert min(depths[:5]) == J.DEPTH > max(depths[5:])
    # with crowds everywhere they are shortened as far as the recall asks
    assert J.recall(0.8, J.shorten([crowded] * J.TREES, 0.8, 1 - 1e-6)) >= 1 - 1e-6


def test_boilerplate_makes_no_pool(spark):
    """Texts that share a third of their shingles meet by chance in many tries; they are no candidates."""
    frame_words = cases.words(60, 1)
    rows = [(k, f"{frame_words} {cases.words(60, 1000 + k, 10**6)}") for k in range(400)] + [(1000, f"{frame_words} {cases.words(60, 1000, 10**6)} x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = df.select("doc_id", "text").mapInArrow(J._sign(["doc_id"]), "doc_id long, n long, places binary, sketch binary").withColumnRenamed("doc_id", "node")
    assert sorted(r.node for r in J.candidate_pools(signed, 0.8, 1 - 1e-6).collect()) == [0, 1000]
    assert _got(df) == _brute(rows)


def test_prefixes_in_blocks_match_brute_force(spark, monkeypatch):
    rows = _copies(2)
    monkeypatch.setattr(J, "GROUP", 2)
    monkeypatch.setattr(J, "SUBTREE", 3)
    monkeypatch.setattr(J, "CARRIED", 0)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


def test_sizes_of_large_pools(spark, monkeypatch):
    """Texts of one pool whose sizes grow step by step: only neighbouring classes of sizes meet, no link is lost."""
    words, rows = cases.words(400, 77).split(), []
    for k in range(30, 400, 6):
        rows.append((k, " ".join(words[:k])))
    monkeypatch.setattr(J, "BLOCK_TEXTS", 4)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


def test_edge_cases(spark):
    out = J.join(cases.frame(spark)).collect()
    assert len(out) == len(cases.ROWS)
    by_id = {r.doc_id: r for r in out}
    assert by_id[12].class_id == 11 and by_id[11].n_links == 1 and by_id[1].n_links == 1
    assert by_id[3].n_links == 0 and by_id[6].class_id == 6
    assert J.join(cases.empty(spark)).count() == 0
    kept = J.keep_one(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "None", "5", "6", "7", "8", "9", "10", "11"])
    assert J.keep_one(cases.empty(spark)).count() == 0


def test_clashing_names(spark):
    rows = [(1, "one two three four five six", "a", 2, "b", "c"), (2, "one two three four five six", "d", 3, "e", "f"), (3, None, "g", 4, "h", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, digest int, kept_id string, c0 string")
    kept = J.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]

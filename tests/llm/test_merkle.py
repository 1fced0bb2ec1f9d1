import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loreweave.llm import merkle
from tests.llm import cases


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fanout=8):
    """rows: doc_id, source, lang, n_chars, text, other text or None. The manifest by lists."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(one, (*r[:4], text))))
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, r[4] if r[5] is None else r[5]), r[0]))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, at):
        out = []
        for nodes in levels[:-1]:
            first = at // fanout * fanout
            run = nodes[first : first + fanout]
            out.append((run[: at - first], run[at - first + 1 :]))
            at //= fanout
        return out

    trees = {g: (sorted(v), tree([x[2] for x in sorted(v)])) for g, v in by_lang.items()}
    langs = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][1][-1][0] for g in langs])
    root, out = top[-1][0], []
    for k, g in enumerate(langs):
        for at, (_, _, own, other, doc_id) in enumerate(trees[g][0]):
            chain = path(trees[g][1], at) + path(top, k)
            node = other
            for a, b in chain:
                node = sha("".join([*a, node, *b]))
            out.append((doc_id, own, trees[g][1][-1][0], root, sha("".join(x for a, b in chain for x in a + b)), node, node == root))
    return sorted(map(str, out))


def case_rows():
    rows = [(*(r[0], r[3], r[2], r[4], r[1]),) for r in cases.ROWS]
    rng = random.Random(3)
    rows += [(rng.randrange(-(1 << 62), 1 << 62), "s", "de", 5, "Text A") for _ in range(700)]  # far apart, of two signs
    rows += [(77, "s", "fr", k, "Same ID") for k in range(400)] + [(78, None, "fr", 1, "Twin")] * 300  # equal ids, equal rows
    rows += [(k, "s", "es", 1, f"T{k}") for k in range(600)] + [((1 << 63) - 1, "s", "es", 1, "end"), (-(1 << 63), "s", "es", 1, "begin")]
    rows += [(1, "s", g, 0, "") for g in ("日本", "é", "z", "=", "a/1", "a", "b", "c", "d")]
    return [(*r, r[4].lower() if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else None) for r in rows]


@pytest.mark.parametrize("crowded", [merkle.CROWDED, 40])
def test_manifest_matches_lists(spark, monkeypatch, crowded):
    monkeypatch.setattr(merkle, "AIM", 10 if crowded == 40 else merkle.AIM)
    rows = case_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, other string").withColumns({c: F.lit(7) for c in ("part", "digest", "block", "rank", "total", "b", "k0", "n")})
    out = merkle.manifest(docs, F.col("other"), crowded=crowded)
    assert sorted(str(tuple(r)) for r in out.collect()) == plain_manifest(rows)


def test_a_changed_text_is_found(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, f"text {k}") for k in range(20)], "doc_id long, source string, lang string, n_chars long, text string")
    bad = {r.doc_id for r in merkle.manifest(docs, F.when(F.col("doc_id") == 7, F.lit("text 7!"))).where("not verified").collect()}
    assert bad == {7}
    assert merkle.manifest(docs, fanout=2).where("verified").count() == 20


def test_one_leaf_and_empty_table(spark):
    one = spark.createDataFrame([(5, "s", None, 1, None)], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("1:51:s-1:1-") and r.proof_sha256 == sha("")
    assert merkle.manifest(cases.empty(spark)).count() == 0

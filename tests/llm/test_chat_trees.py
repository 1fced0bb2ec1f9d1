from hypothesis import given
from hypothesis import strategies as st

from loreweave.llm import chat_trees as C

CONTROL = st.lists(st.sampled_from(["\\", "#", "##", "###", "</turn>", "</turn", "<", ":", ": ", "\n", "a", "é", ""])).map("".join)


@given(st.lists(st.tuples(CONTROL, CONTROL)))
def test_round_trip(turns):
    formatted, _ = C.format_turns(turns)
    assert C.read_turns(formatted) == turns


@given(st.lists(CONTROL, min_size=1))
def test_loss_mask(texts):
    formatted, spans = C.format_turns([("assistant" if i % 2 else "user", t) for i, t in enumerate(texts)])
    assert [C.unescape(formatted[a:b]) for a, b in spans] == texts[1::2]
    assert all("###" not in formatted[a:b].replace("\\#", "") for a, b in spans)


def _paths(rows):
    """Root-to-leaf paths by walking up."""
    parent = {(t, n): p for t, n, p, _ in rows}
    score = {(t, n): s or 0.0 for t, n, _, s in rows}
    inner = {(t, p) for t, _, p, _ in rows if (t, p) in parent}
    best = {}
    for t, n in parent:
        if (t, n) in inner:
            continue
        path, at = [], (t, n)
        while at in parent and len(path) <= len(rows):
            path.append(at[1])
            at = (t, parent[at])
        if len(path) <= len(rows):
            best.setdefault(t, []).append((-sum(score[t, x] for x in path) / len(path), -len(path), n, path))
    return {t: [x[3] for x in sorted(v)] for t, v in best.items()}


def test_best_branches_match_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = [(t, n, rng.randrange(n) if n else None, float(rng.randrange(4))) for t in range(5) for n in range(20)]
    rows += [(9, n, n - 1 if n else None, 1.0) for n in range(70)] + [(10, 1, 2, 1.0), (10, 2, 1, 1.0), (10, 3, 99, None)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    for branches in (1, 3):
        got = {}
        for r in sorted(C.choose_paths(df, branches).collect(), key=lambda r: (r.tree, r.branch, r.above)):
            got.setdefault((r.tree, r.branch), []).append(r.node)
        want = {(t, i + 1): p for t, paths in _paths(rows).items() for i, p in enumerate(paths[:branches])}
        assert got == want


def test_conversations_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 200_000), (1, 1, None, "tie"), (None, None, "user", "no id"), (2, 5, "assistant", "</turn>\\"), (2, 5, "assistant", "</turn>\\"), (-7, 0, "user", "")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, tree long")
    out = {r.conv_id: r for r in C.read_back(C.format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 3, None: 1, 2: 2, -7: 1}
    assert out[1].loss_chars == 200_000 and out[2].loss_chars == 16 and out[-7].loss_chars == 0
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_a_missing_id_is_no_id(spark):
    rows = [(None, 0, "user", "without"), ((1 << 63) - 1, 0, "user", "largest"), (-(1 << 63), 0, "user", "smallest"), (None, 1, "assistant", "reply")]
    out = C.read_back(C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in out} == {None: (2, 5), (1 << 63) - 1: (1, 0), -(1 << 63): (1, 0)}

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import decontamination as C
from tests.llm import cases


def _align(a, b):
    """Smith-Waterman, cell by cell."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_matches_the_recurrence():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([bytes([rng.choice(b"abcd")]) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        score, lo, hi = C.smith_waterman(a, b)
        assert score == _align(a, b) == _align(a, b[lo:hi])


def _items():
    return [(k, " ".join(w.capitalize() for w in cases.words(25, 700 + k).split()) + ".") for k in range(6)]


def test_matches_brute_force(spark):
    rng, docs, items = random.Random(5), [], _items()
    for i in range(60):
        words = cases.words(80, 300 + i).split()
        if i % 3 == 0:
            copy = items[i % 6][1].upper().split()
            for _ in range(i % 5):
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = copy[: 25 - i % 4]
        docs.append((i, " ".join(words)))
    got = {(r.doc_id, r.item_id): r.score for r in C.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for k, item in items:
            words = C.words_of(item)
            if (s := _align(words, C.words_of(text))) >= 0.5 * len(words):
                want[(d, k)] = s / len(words)
    assert got == pytest.approx(want) and len(want) == 20
    kept = C.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(60) if i % 3]


def test_items_that_are_there_as_edited_copies_only(spark):
    rng, items, docs = random.Random(6), [(k, cases.words(n, 900 + k)) for k, n in enumerate((15, 25, 40, 42, 42) * 6)], []
    for k, item in items:
        for copy in range(4):
            words = item.split()
            every = 7 + copy % 2
            for i, _ in enumerate(words):
                if (i % every == every - 1) if k % 5 > 2 else rng.random() < 0.1 + 0.05 * copy:
                    words[i : i + 1] = [f"edited{i}"] if k % 3 else [words[i], f"edited{i}"]
            docs.append((len(docs), f"{cases.words(30, 5000 + len(docs))} {' '.join(words)} {cases.words(30, 6000 + len(docs))}"))
    got = {(r.doc_id, r.item_id): r.score for r in C.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, item in items:
        words = C.words_of(item)
        for d, text in docs:
            if (s := C.smith_waterman(words, C.words_of(text))[0]) >= 0.5 * len(words):
                want[(d, k)] = s / len(words)
    assert got == pytest.approx(want) and len(want) > 100


@pytest.mark.parametrize("every", [2, 3, 4])
def test_no_pair_at_the_threshold_is_lost(spark, every):
    """Copies with a word inserted or another put in its place at every second, third or fourth: few or no three words in a row are left."""
    rng, docs, items = random.Random(every), [], [(k, cases.words(n, 1300 + k, 10**6)) for k, n in enumerate((6, 12, 24, 40, 70) * 4)]
    for k, item in items:
        for way in ("insert", "replace", "both"):
            words = item.split()
            at = rng.randrange(every)
            for i in reversed(range(at, len(words), every)):
                new = f"edited{rng.randrange(10**6)}"
                words[i : i + 1] = [words[i], new] if way == "insert" or way == "both" and rng.random() < 0.5 else [new]
            docs.append((len(docs), f"{cases.words(45, 15000 + len(docs), 10**6)} {' '.join(words)} {cases.words(45, 16000 + len(docs), 10**6)}"))
    got = {(r.doc_id, r.item_id): r.score for r in C.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, item in items:
        words = C.words_of(item)
        for d, text in docs:
            if (s := C.smith_waterman(words, C.words_of(text))[0]) >= 0.5 * len(words):
                want[(d, k)] = s / len(words)
    assert got == pytest.approx(want) and want


def test_scripts_without_spaces(spark):
    rng = random.Random(8)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    item = han(40)
    docs = [(1, han(60) + item + "。" + han(60)), (2, han(60) + item[:20] + han(2) + item[20:] + han(30)), (3, han(160)), (4, None)]
    got = C.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == {(1, 9): 1.0, (2, 9): pytest.approx(38 / 40)}


def test_common_items_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(C, "CARRIED", 0)
    items = _items()
    docs = [(i, f"{cases.words(10, i)} {items[0][1]}") for i in range(50)] + [(99, items[5][1])]
    got = C.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [*((i, 0) for i in range(50)), (99, 5)]


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "one two three four", 3.0), (3, "one two three four", 3.0), (None, "x y z", 0.0)], "item_id long, text string, score double")
    got = C.find(cases.frame(spark), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(11, 3), (11, 3), (12, 3), (12, 3)]
    kept = C.decontaminate(cases.frame(spark), bench)
    assert kept.count() == len(cases.ROWS) - 2 and kept.columns == cases.frame(spark).columns
    assert C.find(cases.empty(spark), bench).count() == 0
    assert C.find(cases.frame(spark), bench.limit(0)).count() == 0


def test_clashing_names(spark):
    item = cases.words(20, 3)
    rows = [(1, f"x {item}", b"a", 1, "b"), (2, "clean", b"c", 2, "d"), (3, None, b"e", 3, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest binary, item int, c0 string")
    kept = C.decontaminate(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_a_worker_holds_tables_and_words_of_a_small_part_only():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(300_000)}" for _ in range(1000)) for _ in range(600)]  # 4.5 MB
    batch = pa.record_batch({"digest": [b"%d" % i for i in range(len(texts))], "text": texts})
    hasher = C.Hasher()
    grams = hasher.grams(hasher.words(C.words_of(" ".join(t[:200] for t in texts))), 2)
    table = np.zeros(1 << C.FILTER_BITS, bool)
    table[(grams % np.uint64(1 << C.FILTER_BITS)).astype(np.int64)] = True
    packed = np.packbits(table).tobytes()
    del table, hasher
    assert C._in_table(grams, C._open(packed)).all()
    for step in (C._gram_counts(packed), C._passages({k: C.Kind(2, 40, 12, packed, packed) for k in (4, 5, 6)})):
        tracemalloc.start()
        try:
            for _ in step(iter([batch])):
                pass
            assert tracemalloc.get_traced_memory()[1] < 40e6
        finally:
            tracemalloc.stop()

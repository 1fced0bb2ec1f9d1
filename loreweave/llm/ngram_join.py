"""Similarity join on word shingles: a forest of MinHash prefix tries, verified exactly.

Texts become sets of runs of SHINGLE words (characters other than space and \\t to \\r); a shorter text
with a word is one run. Equal texts are one class member to start with. Each text has TREES signatures of DEPTH
minima, and each trie is the sorted list of its signatures: texts with a common prefix stand next to each other.

A text starts with its full signatures in all tries. While the chance that it misses a partner at the threshold
is above 1 - target_recall, the prefix is shortened, one level in one trie at a time, where the gain in recall costs
fewest texts more to compare; LEAST levels are kept. So texts in sparse surroundings match by short prefixes, and
where many texts share a prefix by chance (boilerplate) long ones are kept there and others shortened. Texts under
a chosen prefix are candidates if SKETCH further bytes of their minima agree as often as they would at the
threshold (at a chance of MISSED to be wrong); connected candidates form a pool. A pool that a task can't hold is
dealt to blocks by number of shingles: only blocks whose sizes allow the threshold meet. There the similarity of
every pair is computed from whole shingle sets, as products of matrices; pairs aren't emitted: a block gives each
text's number of links and a spanning forest of them.

Defined results: texts without words (null, empty) have no links, not even to copies; repeated rows and
equal texts are linked; classes are connected by links, and a class id is its smallest doc_id (a class of
rows with null ids only has a null id); texts of any length are read whole; an empty table gives no rows; further
columns are ignored by join() and carried along by keep_one(), whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreweave.llm.common import MIX, as_bytes, as_text, by_place, connected_components, join_unique, keep, mixed, slices, stored

SHINGLE, TREES, LEAST, DEPTH = 5, 40, 4, 8
#: Bytes of minima that candidates are compared by, and the chance at which a pair at the threshold fails that.
SKETCH, MISSED = 128, 1e-7
#: Texts under one prefix that a task compares at a time, and rows of a subtree that it counts at a time.
GROUP, SUBTREE = 4096, 1 << 20
#: Texts and shingles of a block at most (a longer text is a block of its own).
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1_000_000
#: Texts in pools up to which their digests (some 40 bytes each) are broadcast to find them; more are joined by a shuffle.
CARRIED = 500_000
#: Columns of a matrix product, and shingles for which minima are taken at a time.
CHUNK, MINIMA_CHUNK = 4096, 1024


def recall(similarity: float, depths: Iterable[int]) -> float:
    """The chance that two texts of this similarity share the prefix of one trie at least; depths: of each trie."""
    return 1 - math.prod(1 - similarity**d for d in depths)


def shorten(sizes: list[list[int]], threshold: float, target: float) -> list[int]:
    """The depth of each trie in which a text has company. sizes: for each, the texts under its prefix of LEAST to DEPTH levels.

    Tries that aren't given hold the text alone already at LEAST levels. Depths start at DEPTH; steps are taken
    in order of texts more to compare for the gain in log-probability, until target is reached.
    """
    gain = [-math.log1p(-(threshold**d)) for d in range(LEAST, DEPTH + 1)]
    depths = [DEPTH - LEAST] * len(sizes)
    have = gain[0] * (TREES - len(sizes)) + gain[-1] * len(sizes)
    need = -math.log1p(-target)
    step = lambda k, d: ((sizes[k][d - 1] - sizes[k][d]) / (gain[d - 1] - gain[d]), k)
    steps = [step(k, d) for k, d in enumerate(depths)]
    heapq.heapify(steps)
    while steps and have < need:
        _, k = heapq.heappop(steps)
        depths[k] -= 1
        have += gain[depths[k]] - gain[depths[k] + 1]
        if depths[k]:
            heapq.heappush(steps, step(k, depths[k]))
    return [LEAST + d for d in depths]


def agreeing(threshold: float) -> int:
    """How many of SKETCH bytes agree at least in a pair at the threshold, but for a chance of MISSED."""
    below = 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        if below > MISSED:
            return k
    return SKETCH


def _runs(word_hashes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each run of SHINGLE words, or one for a shorter text."""
    n = len(word_hashes)
    width = min(SHINGLE, n)
    out = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        out = mixed(out * MIX + word_hashes[j : n - width + 1 + j])
    return out


def shingles(text: bytes) -> np.ndarray:
    """The text's set of shingles as sorted 64-bit hashes."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(_runs(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))))


class Forest:
    """The hash functions of all tries; signatures() gives a text's place in each."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)[:, None]

    def signatures(self, word_hashes: np.ndarray) -> tuple[int, bytes, bytes]:
        """The number of shingles; for each trie its first LEAST levels as a 64-bit number and 16 bits of each further level; the sketch."""
        x = np.unique((_runs(word_hashes) >> np.uint64(32)).astype(np.uint32))
        least = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for i in range(0, len(x), MINIMA_CHUNK):
            h = x[None, i : i + MINIMA_CHUNK] * self.a
            h += self.b
            np.minimum(least, h.min(axis=1), out=least)
        levels = least.reshape(TREES, DEPTH).astype(np.uint64)
        place = np.empty((TREES, 2), np.uint64)
        place[:, 0] = np.arange(1, TREES + 1, dtype=np.uint64) * MIX
        place[:, 1] = 0
        for level in levels.T[:LEAST]:
            place[:, 0] = mixed(place[:, 0] * MIX + level)
        for level in levels.T[LEAST:]:
            place[:, 1] = (place[:, 1] << np.uint64(16)) | (mixed(level) >> np.uint64(48))
        # levels from the top, of all tries in turn
        sketch = (mixed(levels.T.ravel()[:SKETCH]) >> np.uint64(56)).astype(np.uint8)
        return len(x), place.tobytes(), sketch.tobytes()


def _sign(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for part in slices(batch):
                rows = []
                seen: dict[bytes, int] = {}
                for text in as_bytes(part):
                    words = text.split()
                    hashes = np.fromiter((h if (h := seen.get(w)) is not None else seen.setdefault(w, zlib.crc32(w)) for w in words), np.uint64, len(words))
                    rows.append(forest.signatures(mixed(hashes)))
                yield pa.RecordBatch.from_arrays([*keep(part, names).values(), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], [*names, "n", "places", "sketch"])

    return run


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and trie: root (the first LEAST levels), deep (the others), node."""
    for batch in batches:
        place = np.frombuffer(b"".join(as_bytes(batch, "places")), np.int64).reshape(-1, 2)
        node = np.repeat(batch.column(batch.schema.get_field_index("node")).to_numpy(), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(place[:, 0].copy()), pa.array(place[:, 1].copy()), pa.array(node)], ["root", "deep", "node"])


def _prefix(deep: np.ndarray, levels: int) -> np.ndarray:
    """The first levels of deep, as a number."""
    return deep.view(np.uint64) >> np.uint64(16 * (DEPTH - LEAST - levels)) if levels else np.zeros(len(deep), np.uint64)


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by root and deep, so that a trie's prefixes are runs of rows: how many texts are under each of a text's prefixes.

    Texts alone under their root are left out. Of a subtree of more than SUBTREE rows parts are counted by
    themselves, which makes its prefixes seem rarer; how a text shortens its prefixes depends on these figures,
    what it finds by them doesn't.
    """
    cut, cut_rows = None, 0

    def counted(root: np.ndarray, deep: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        sizes = []
        for levels in range(DEPTH - LEAST + 1):
            top = _prefix(deep, levels)
            start = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (top[1:] != top[:-1])]))
            n = np.diff(np.append(start, len(root)))
            sizes.append(np.repeat(n, n))
        if cut is not None:
            sizes[0] = sizes[0] + np.where(root == cut, cut_rows, 0)
        shared = sizes[0] > 1
        table = np.ascontiguousarray(np.stack(sizes, axis=1)[shared])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, DEPTH - LEAST + 1), pa.int32()), pa.array(table.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(root[shared]), pa.array(deep[shared]), pa.array(node[shared]), lists], ["root", "deep", "node", "sizes"])

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        if not len(held[0]):
            continue
        end = int(np.searchsorted(held[0], held[0][-1]))  # where the last subtree begins
        if end:
            yield counted(*(h[:end] for h in held))
            held = [h[end:] for h in held]
        if len(held[0]) > SUBTREE:
            cut, cut_rows = held[0][0], (cut_rows if cut == held[0][0] else 0)
            yield counted(*held)
            cut_rows += len(held[0])
            held = [h[:0] for h in held]
    if len(held[0]):
        yield counted(*held)


def _chosen(threshold: float, target: float):
    """Rows: a text with its tries in which it has company (at most TREES). The prefixes by which it looks for partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, deep, levels = [], [], []
            for tries in as_text(batch, "tries"):
                for t, d in zip(tries, shorten([t["sizes"] for t in tries], threshold, target), strict=True):
                    if t["sizes"][d - LEAST] > 1:
                        root.append(t["root"])
                        deep.append(t["deep"])
                        levels.append(d - LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(deep, pa.int64()), pa.array(levels, pa.int32())], ["root", "deep", "levels"])

    return run


def _candidates(least: int):
    """Groups of rows (prefix, i, j, block, node, sketch): edges that connect all texts of blocks i and j whose sketches agree."""

    def edges(first: list[tuple[int, bytes]], second: list[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
        # one side of texts that meet each other, or two of which each meets the other's
        sides = [first, second] if second else [first]
        sketch = [np.frombuffer(b"".join(s for _, s in side), np.uint8).reshape(len(side), -1) for side in sides]
        left = [np.arange(len(side)) for side in sides]
        while len(left[0]):
            todo = [(0, int(left[0][0]))]
            left[0] = left[0][1:]
            while todo:
                side, at = todo.pop()
                other = len(sides) - 1 - side
                near = (sketch[other][left[other]] == sketch[side][at]).sum(axis=1) >= least
                if near.any():
                    found = left[other][near].tolist()
                    left[other] = left[other][~near]
                    todo += [(other, k) for k in found]
                    yield from ((sides[side][at][0], sides[other][k][0]) for k in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(as_text(batch, c) for c in ("prefix", "i", "j", "block", "node", "sketch")), strict=True))
        a: list[int] = []
        b: list[int] = []
        for (_, i, j), members in groupby(rows, key=lambda r: r[:3]):
            sides: tuple[list, list] = ([], [])
            for _, _, _, block, node, sketch in members:
                sides[block != i].append((node, sketch))
            if i != j and not (sides[0] and sides[1]):
                continue
            for x, y in edges(*sides):
                a.append(x)
                b.append(y)
            if len(a) > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def overlaps(sets: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray:
    """The sizes of all pairwise intersections of the sets, or of them with the others."""
    both = sets if other is None else [*sets, *other]
    values, times = np.unique(np.concatenate(both), return_counts=True)
    shared = values[times > 1]
    out = np.zeros((len(sets), len(sets if other is None else other)), np.float32)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    flat = np.concatenate(both)
    column = np.searchsorted(shared, flat)
    column[column == len(shared)] = 0
    hit = shared[column] == flat if len(shared) else np.zeros(len(flat), bool)
    row, column = row[hit], column[hit]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for i in range(0, len(shared), CHUNK):
        lo, hi = np.searchsorted(column, [i, i + CHUNK])
        x = np.zeros((len(both), min(CHUNK, len(shared) - i)), np.float32)
        x[row[lo:hi], column[lo:hi] - i] = 1
        out += x[: len(sets)] @ (x.T if other is None else x[len(sets) :].T)
    return out


def _forest_edges(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect all texts that are linked directly or through others; linked: symmetric, boolean."""
    left = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            near = np.flatnonzero(linked[todo.pop()] & left)
            left[near] = False
            todo += near.tolist()
            yield from ((root, int(k)) for k in near)


FOUND = "node long, other long, texts long, documents long"


def _verify(threshold: Fraction):
    """Groups of rows (pool, i, j, block, node, copies, text): all pairs of block i with block j."""
    num, den = threshold.numerator, threshold.denominator

    def linked(sets_a: list, sets_b: list | None) -> np.ndarray:
        common = overlaps(sets_a, sets_b)
        size = np.array([len(s) for s in sets_a], float)[:, None] + np.array([len(s) for s in (sets_a if sets_b is None else sets_b)], float)[None, :]
        # common / (size - common) >= num / den, in whole numbers
        return (common > 0) & (common * (den + num) >= num * size)

    def group(rows: dict, i: int, j: int) -> list[tuple]:
        out: list[tuple] = []
        first = {k: v for k, v in rows.items() if v[0] == i}
        second = {k: v for k, v in rows.items() if v[0] == j} if i != j else None
        if not first or second is not None and not second:
            return out
        nodes, copies = list(first), np.array([v[1] for v in first.values()])
        sets = [v[2] for v in first.values()]
        if second is None:
            m = linked(sets, None)
            np.fill_diagonal(m, False)
            out += zip(nodes, [None] * len(nodes), m.sum(1).tolist(), (m @ copies).tolist(), strict=True)
            out += [(nodes[a], nodes[b], 0, 0) for a, b in _forest_edges(m)]
            return out
        nodes2, copies2 = list(second), np.array([v[1] for v in second.values()])
        m = linked(sets, [v[2] for v in second.values()])
        out += zip(nodes, [None] * len(nodes), m.sum(1).tolist(), (m @ copies2).tolist(), strict=True)
        out += zip(nodes2, [None] * len(nodes2), m.sum(0).tolist(), (copies @ m).tolist(), strict=True)
        square = np.zeros((len(nodes) + len(nodes2),) * 2, bool)
        square[: len(nodes), len(nodes) :], square[len(nodes) :, : len(nodes)] = m, m.T
        both = [*nodes, *nodes2]
        return out + [(both[a], both[b], 0, 0) for a, b in _forest_edges(square)]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"node": [r[0] for r in out], "other": pd.array([r[1] for r in out], "Int64"), "texts": [int(r[2]) for r in out], "documents": [int(r[3]) for r in out]}).astype({"node": "int64"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("texts", pa.int64()), ("documents", pa.int64())])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part in slices(batch):
                    yield from zip(*(as_text(part, c) for c in ("pool", "i", "j", "block", "node", "copies")), as_bytes(part), strict=True)

        for (_, i, j), group_rows in groupby(rows(), key=lambda r: r[:3]):
            held: dict[int, tuple] = {}
            for _, _, _, block, node, copies, text in group_rows:
                if node not in held:
                    held[node] = (block, copies, shingles(text))
            if len(held) > 1:
                yield pa.RecordBatch.from_pandas(frame(group(held, i, j)), schema, preserve_index=False)

    return run


def _meetings(own: Column, blocks: Column) -> Column:
    """All pairs (i, j) of block `own` with the blocks 0 to blocks - 1 of its kind, smaller first."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k.cast("long")).alias("i"), F.greatest(own, k.cast("long")).alias("j")))


def candidate_pools(classes: DataFrame, threshold: float, target_recall: float) -> DataFrame:
    """node and pool of all texts (classes: node, places, sketch) that have a candidate; candidates are in one pool."""
    leaves = classes.select("node", "places").mapInArrow(_leaves, "root long, deep long, node long")
    company = leaves.repartition("root").sortWithinPartitions("root", "deep", "node").mapInArrow(_company, "root long, deep long, node long, sizes array<long>")
    company = stored(company, "ngram-company")
    prefix = F.xxhash64("root", "levels", F.when(F.col("levels") > 0, F.expr(f"shiftrightunsigned(deep, 16 * ({DEPTH - LEAST} - levels))")).otherwise(F.lit(0).cast("long"))).alias("prefix")
    tries = company.groupBy("node").agg(F.collect_list(F.struct("root", "deep", "sizes")).alias("tries"))  # TREES entries at most
    chosen = tries.select("tries").mapInArrow(_chosen(threshold, target_recall), "root long, deep long, levels int").select(prefix).distinct()
    chosen = stored(chosen, "ngram-prefixes")
    under = company.select("node", "root", "deep", F.explode(F.transform("sizes", lambda n, k: F.struct(k.alias("levels"), n.alias("size")))).alias("x")).where("x.size > 1").select("node", "root", "deep", "x.levels").select("node", "root", "levels", prefix)
    found = join_unique(under, chosen, "prefix", 5 * company.count())
    # of a trie's prefixes over a text the shortest one holds the others' texts too
    held = stored(found.groupBy("node", "root").agg(F.min_by("prefix", "levels").alias("prefix")).select("node", "prefix"), "ngram-held")
    blocks = held.groupBy("prefix").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    dealt = join_unique(held, blocks, "prefix", held.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    compared = dealt.join(classes.select("node", "sketch"), "node").select("prefix", F.explode(_meetings(F.col("block"), F.col("blocks"))).alias("p"), "block", "node", "sketch").select("prefix", "p.i", "p.j", "block", "node", "sketch")
    edges = compared.repartition("prefix", "i", "j").sortWithinPartitions("prefix", "i", "j").mapInArrow(_candidates(agreeing(threshold)), "a long, b long")
    return connected_components(edges).withColumnRenamed("component", "pool")


def _tasks(members: DataFrame, threshold: float) -> DataFrame:
    """members (pool, node, n, ...) with i, j and block: a row for each meeting of two blocks that the text is part of.

    A pool that one block holds is one. Others are dealt by size: texts whose numbers of shingles differ by
    more than the threshold allows are never in neighbouring classes of sizes.
    """
    total = members.count()
    base = math.log(1 / threshold) * 1.0001 if threshold < 1 else math.log(1.0001)
    fits = lambda m, w: F.greatest(F.ceil(m / BLOCK_TEXTS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    pools = members.groupBy("pool").agg((fits(F.count("*"), F.sum("n")) > 1).alias("large"))
    sized = join_unique(members, pools, "pool", total).withColumn("size_class", F.when(F.col("large"), F.floor(F.log(F.col("n")) / base).cast("int")).otherwise(0)).drop("large")
    sized = sized.withColumn("cell", F.concat_ws(":", "pool", "size_class"))
    cells = sized.groupBy("cell", "pool", "size_class").agg(fits(F.count("*"), F.sum("n")).alias("blocks"))
    by = W.partitionBy("pool").orderBy("size_class")  # some dozen classes in a pool
    beside = lambda f, d: F.when(f("size_class").over(by) == F.col("size_class") + d, f("blocks").over(by)).otherwise(0)
    cells = cells.withColumns({"after": beside(F.lead, 1), "before": beside(F.lag, -1)}).drop("pool", "size_class")
    dealt = join_unique(sized, cells, "cell", total).withColumn("place", F.pmod(F.xxhash64("node"), F.col("blocks")))
    label = lambda c, b: F.shiftleft((c + 1).cast("long"), 32) + b
    own = label(F.col("size_class"), F.col("place"))
    others = lambda n, d, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: f(label(F.col("size_class") + d, k)))).otherwise(F.array().cast("array<struct<i: bigint, j: bigint>>"))
    same = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, label(F.col("size_class"), k)).alias("i"), F.greatest(own, label(F.col("size_class"), k)).alias("j")))
    met = F.concat(same, others("after", 1, lambda x: F.struct(own.alias("i"), x.alias("j"))), others("before", -1, lambda x: F.struct(x.alias("i"), own.alias("j"))))
    rest = [c for c in members.columns if c != "n"]
    return dealt.select(*rest, own.alias("block"), F.explode(met).alias("p")).select(*rest, "block", "p.i", "p.j")


def join(documents: DataFrame, threshold: float = 0.8, target_recall: float = 1 - 1e-6) -> DataFrame:
    """doc_id, class_id, n_text_links (different texts that are as similar) and n_links (their documents and copies).

    Also digest and is_kept: true in the rows of one document of each class.
    """
    key = F.unhex(F.md5("text"))
    with_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    ids = documents.select("doc_id", "text", F.when(with_words, key).alias("digest"))
    known = ids.where(F.col("digest").isNotNull())
    schema = known.select("doc_id", "digest").schema.add("n", "long").add("places", "binary").add("sketch", "binary")
    signed = stored(known.mapInArrow(_sign(["doc_id", "digest"]), schema), "ngram-signed")
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("places").alias("places"), F.max("sketch").alias("sketch"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    pools = candidate_pools(classes, threshold, target_recall)
    members = stored(classes.select("node", "digest", "first_id", "copies", "n").join(pools, "node"), "ngram-pools")
    no_id = F.lit(-(1 << 63))
    # one row of each class: of equal rows the verification takes one
    wanted = members.select("digest", F.coalesce("first_id", no_id).alias("one"), "node", "pool", "copies", "n")
    texts = known.select("digest", "text", F.coalesce("doc_id", no_id).alias("one"))
    held = texts.join(F.broadcast(wanted) if members.count() <= CARRIED else wanted, ["digest", "one"]).select("node", "text")
    tasks = _tasks(members.select("pool", "node", "n", "copies"), threshold)
    tasks = tasks.join(held, "node").select("pool", "i", "j", "block", "node", "copies", "text")
    checked = tasks.repartition("pool", "i", "j").sortWithinPartitions("pool", "i", "j").mapInArrow(_verify(Fraction(str(threshold))), FOUND)
    found = stored(checked, "ngram-links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = classes.select("digest", "node", "first_id", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("class", F.coalesce("component", "node"))
    placed = stored(placed.drop("component"), "ngram-classed")
    least = placed.groupBy("class").agg(F.min("first_id").alias("class_id"), F.min_by("digest", F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("kept_digest"))
    classed = join_unique(placed, least, "class", placed.count()).select("digest", "class_id", "kept_digest", "first_id", F.coalesce("texts", F.lit(0)).alias("n_text_links"), (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = join_unique(signed.select("doc_id", "digest"), classed, "digest", signed.count())
    out = out.select("doc_id", "class_id", "n_text_links", "n_links", "digest", ((F.col("digest") == F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("is_kept"))
    alone = ids.where(F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_text_links"), F.lit(0).cast("long").alias("n_links"), "digest", F.lit(True).alias("is_kept"))
    return out.unionByName(alone)


def keep_one(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """documents with one row of each class, and all texts without words."""
    numbered, names = by_place(documents)
    text, doc_id = F.col(names["text"]), F.col(names["doc_id"])
    joined = join(documents.select("doc_id", "text"), threshold)
    chosen = joined.where(F.col("is_kept") & F.col("digest").isNotNull()).select(F.col("digest").alias("digest"), F.col("doc_id").alias("kept_id")).distinct()
    with_words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = numbered.withColumn("digest", F.unhex(F.md5(text)))
    matched = keyed.where(with_words).join(chosen, "digest").where(doc_id.eqNullSafe(F.col("kept_id")))
    one = matched.dropDuplicates(["digest"]).select(numbered.columns)
    return one.unionByName(numbered.where(~with_words)).toDF(*documents.columns)

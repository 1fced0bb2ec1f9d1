"""Near-duplicate components by odd sketches of MinHash samples, confirmed on full shingle sets.

A text, A-Z in lower case, becomes its set of runs of five words. SAMPLES minima of the set make BANDS band keys of ROWS minima
each, and an odd sketch: every sample flips one of BITS bits, so the bits that differ between two sketches count the samples
that differ, the more precisely the fewer they are. Texts with a band in common are candidates; a pair whose sketches
differ in more bits than a pair at the threshold would (but for a chance of MISSED) is none.

Only components are asked for, so no group's pairs are listed. First each text is compared with one earlier text: of the
smallest members of its bands that whose sketch is nearest. Confirmed pairs make first components. Where a band still has
members of several, their sketches are compared across components, in blocks; components that may touch form a pool, and
there all pairs of texts of different large components, or with small ones, are confirmed block by block as products of matrices.

Defined results: texts without words (null, empty) have no shingles and are components of their own, as is each of their
rows; equal texts are one component; a component's id is its smallest doc_id (null if all are null); repeated rows get the
same values; kept is true where doc_id is the component's id (both may be null); texts of any length are read whole; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from loreweave.llm import ngram_join
from loreweave.llm.common import MIX, as_bytes, as_text, connected_components, join_unique, keep, mixed, slices, stored

SAMPLES, BANDS, ROWS, BITS = 256, 32, 5, 512
MISSED = 1e-7
#: Texts that meet one earlier text in a task, texts of a band that a task compares at a time, and texts of a block.
PART, GROUP, BLOCK = 512, 4096, 1024
#: Shingles for which minima are taken at a time.
CHUNK = 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def recall(similarity: float) -> float:
    """The chance that two texts of this similarity have a band in common."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def similarity(differing_bits: float) -> float:
    """The similarity that a number of differing bits tells of."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * differing_bits / BITS))


def most_bits(threshold: float) -> int:
    """How many bits of two sketches differ at most in a pair at the threshold, but for a chance of MISSED.

    Each sample that differs flips a bit by each of its two values: a walk over the number of odd bits.
    """
    odd = np.zeros(BITS + 1)
    odd[0], total = 1.0, np.zeros(BITS + 1)
    at = np.arange(BITS + 1)
    for differing in range(SAMPLES + 1):
        total += math.comb(SAMPLES, differing) * (1 - threshold) ** differing * threshold ** (SAMPLES - differing) * odd
        for _ in range(2):
            up, down = odd * (BITS - at) / BITS, odd * at / BITS
            odd = np.concatenate([[0.0], up[:-1]]) + np.concatenate([down[1:], [0.0]])
    above = np.cumsum(total[::-1])[::-1]
    return int(np.flatnonzero(above > MISSED)[-1])


class Samples:
    """The hash functions; sign() gives a set's band keys and odd sketch."""

    def __init__(self, seed: int = 12):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, SAMPLES, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)[:, None]
        self.number = np.arange(1, SAMPLES + 1, dtype=np.uint64) * MIX
        self.band = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = np.unique((shingles >> np.uint64(32)).astype(np.uint32))
        least = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
        for i in range(0, len(x), CHUNK):
            h = x[None, i : i + CHUNK] * self.a
            h += self.b
            np.minimum(least, h.min(axis=1), out=least)
        return least.astype(np.uint64)

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BANDS keys, and the sketch as BITS / 64 numbers."""
        least = self.minima(shingles)
        bands = self.band.copy()
        for level in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
            bands = mixed(bands * MIX + level)
        flips = np.bincount((mixed(self.number + least) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
        return bands.view(np.int64), np.packbits(flips.astype(np.uint8)).view(np.int64)


def _sign(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = Samples()
        lists = lambda rows, width: pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * width + 1, width), pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))
        for batch in batches:
            for part in slices(batch):
                seen: dict[bytes, int] = {}
                n, bands, sketches = [], [], []
                for text in as_bytes(part):
                    words = text.lower().split()
                    hashes = np.fromiter((h if (h := seen.get(w)) is not None else seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
                    shingles = np.unique(ngram_join._runs(hashes)) if words else hashes
                    n.append(len(shingles))
                    b, s = samples.sign(shingles)
                    bands.append(b)
                    sketches.append(s)
                yield pa.RecordBatch.from_arrays([*keep(part, names).values(), pa.array(n, pa.int64()), lists(bands, BANDS), lists(sketches, BITS // 64)], [*names, "n", "bands", "sketch"])

    return run


def differing(a: Column, b: Column) -> Column:
    """The bits that differ between two sketches."""
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(BITS // 64)), F.lit(0))


def _meets(num: int, den: int, a: int | Column, b: int | Column):
    """Whether sets of these sizes can have the similarity."""
    return (a * den >= b * num) & (b * den >= a * num)


def stars(held: DataFrame, buckets: DataFrame, classes: DataFrame, threshold: Fraction, bound: int) -> DataFrame:
    """node and pivot: for each text of held (band, node) that of its bands' smallest members whose sketch is nearest; buckets: band, pivot."""
    pairs = stored(join_unique(held, buckets, "band", held.count()).where("node <> pivot").select("node", "pivot").distinct(), "odd-pairs")
    side = lambda name: classes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))
    near = join_unique(pairs, side("pivot"), "pivot", pairs.count()).join(side("node"), "node").withColumn("bits", differing(F.col("node_sketch"), F.col("pivot_sketch")))
    near = near.where((F.col("bits") <= bound) & _meets(threshold.numerator, threshold.denominator, F.col("node_n"), F.col("pivot_n")))
    return near.groupBy("node").agg(F.min(F.struct("bits", "pivot")).alias("x")).select("node", F.col("x.pivot").alias("pivot"))


def _confirm(threshold: Fraction):
    """Groups of rows (pivot, part, node, text), the pivot's first: the texts that are as similar to it as threshold asks."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, base = None, np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch):
                a, b = [], []
                for pivot, k, node, text in zip(*(as_text(part, c) for c in ("pivot", "part", "node")), as_bytes(part), strict=True):
                    if node == pivot:
                        if of != (pivot, k):
                            of, base = (pivot, k), ngram_join.shingles(text.lower())
                        continue
                    own = ngram_join.shingles(text.lower())
                    common = len(np.intersect1d(base, own, assume_unique=True))
                    if common * (den + num) >= num * (len(base) + len(own)):
                        a.append(node)
                        b.append(pivot)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(edges: DataFrame, texts: DataFrame, threshold: Fraction) -> DataFrame:
    """The edges (node, pivot) whose texts (node, text) have the similarity, as a and b. A text is shuffled once, a pivot's once for each PART texts."""
    parts = edges.groupBy("pivot").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = join_unique(edges, parts, "pivot", edges.count()).select("pivot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    heads = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("node"))
    rows = dealt.unionByName(heads).join(texts, "node").select("pivot", "part", "node", "text")
    return rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("node") != F.col("pivot")).mapInArrow(_confirm(threshold), "a long, b long")


def _across(bound: int):
    """Groups of rows (band, i, j, node, comp, sketch): pairs of components that a pair of near sketches connects, as a forest."""

    def forest(comp: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.ones(len(comp), bool)
        for start in range(len(comp)):
            if not left[start]:
                continue
            todo = [comp[start]]
            left &= comp != comp[start]
            while todo and left.any():
                c = todo.pop()
                for x in np.flatnonzero(comp == c):
                    others = np.flatnonzero(left)
                    if not len(others):
                        break
                    near = np.bitwise_count(sketch[others] ^ sketch[x]).sum(axis=1) <= bound
                    for d in np.unique(comp[others[near]]):
                        left &= comp != d
                        todo.append(d)
                        yield int(c), int(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(as_text(batch, c) for c in ("band", "i", "j", "comp", "sketch")), strict=True))
        for _, members in groupby(rows, key=lambda r: r[:3]):
            held = list(members)
            found = list(forest(np.array([r[3] for r in held], np.int64), np.array([r[4] for r in held], np.int64).view(np.uint64)))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def touching(held: DataFrame, comps: DataFrame, classes: DataFrame, bound: int) -> DataFrame:
    """node (a component) and component (its pool): components that may touch, of bands that hold several; comps: node, comp."""
    placed = stored(held.join(comps, "node"), "odd-placed")
    mixed_bands = placed.groupBy("band").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", F.ceil(F.col("m") / GROUP).cast("int").alias("blocks"))
    dealt = join_unique(placed, mixed_bands, "band", placed.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = dealt.join(classes.select("node", "sketch"), "node").select("band", F.explode(ngram_join._meetings(F.col("block"), F.col("blocks"))).alias("p"), "comp", "sketch").select("band", "p.i", "p.j", "comp", "sketch")
    return connected_components(rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_across(bound), "a long, b long"))


def meetings(members: DataFrame, threshold: float) -> DataFrame:
    """members (pool, comp, node, n) with block, i and j: a row for each meeting of two blocks that a text is part of.

    A component of over BLOCK texts has blocks of its own, which don't meet each other; smaller ones share blocks. Blocks
    hold sizes of one class; classes that are further apart than the threshold allows don't meet.
    """
    base = math.log(1 / threshold) * 1.0001
    sizes = members.groupBy("comp").agg((F.count("*") > BLOCK).alias("large"))
    sized = join_unique(members, sizes, "comp", members.count()).withColumns({"class": F.floor(F.log(F.col("n")) / base).cast("int"), "own": F.when(F.col("large"), F.col("comp")).otherwise(F.lit(-1))})
    cell = F.concat_ws(":", "pool", "own", "class")
    cells = sized.groupBy(cell.alias("cell"), "pool", "own", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = join_unique(sized.withColumn("cell", cell), cells.select("cell", "blocks"), "cell", members.count())
    label = lambda c, k: F.xxhash64(F.concat_ws(":", c, k))
    dealt = stored(dealt.select("node", label(F.col("cell"), F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block")), "odd-dealt")
    blocks = cells.select("pool", "own", "class", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: label(F.col("cell"), k))).alias("block"))
    near = blocks.select("pool", F.col("own").alias("other_own"), F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("block").alias("other"))
    met = blocks.join(near, ["pool", "class"]).where("block <= other and (own = -1 or own <> other_own)").select(F.col("block").alias("i"), F.col("other").alias("j"))
    sides = met.select(F.col("i").alias("block"), "i", "j").unionByName(met.where("i <> j").select(F.col("j").alias("block"), "i", "j"))
    return join_unique(sides, dealt.groupBy("block").agg(F.collect_list("node").alias("nodes")), "block", sides.count()).select("i", "j", "block", F.explode("nodes").alias("node"))


def components(documents: DataFrame, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    known, bound = documents.where("text is not null").select("doc_id", "text", F.unhex(F.md5("text")).alias("digest")), most_bits(float(threshold))
    schema = known.select("doc_id", "digest").schema.add("n", "long").add("bands", ArrayType(LongType())).add("sketch", ArrayType(LongType()))
    signed = stored(known.mapInArrow(_sign(["doc_id", "digest"]), schema), "odd-signed")
    # texts that differ in case or white space only are classes of their own, with equal sets
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bands").alias("bands"), F.max("sketch").alias("sketch"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "odd-classes")

    # bands with the same members are one bucket
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("print"), F.min("node").alias("pivot"), F.max("node").alias("last")).where("m > 1")
    buckets = stored(buckets.groupBy("m", "print", "pivot", "last").agg(F.min("band").alias("band")).select("band", "pivot"), "odd-buckets")
    held = stored(join_unique(banded, buckets.select("band"), "band", BANDS * classes.count()).select("band", "node"), "odd-held")

    no_id = F.lit(-(1 << 63))
    wanted = lambda nodes: classes.join(nodes, "node").select("node", "digest", F.coalesce("first_id", no_id).alias("one"), "n", "copies")
    texts = known.select("digest", "text", F.coalesce("doc_id", no_id).alias("one"))

    def fetched(nodes: DataFrame) -> DataFrame:
        few = wanted(nodes)
        return texts.join(F.broadcast(few) if nodes.count() <= ngram_join.CARRIED else few, ["digest", "one"]).select("node", "text")

    edges = stored(stars(held, buckets, classes, threshold, bound), "odd-stars")
    ends = stored(edges.select("node").unionByName(edges.select(F.col("pivot").alias("node"))).distinct(), "odd-ends")
    first = connected_components(confirmed(edges, fetched(ends), threshold))
    comps = stored(classes.select("node").join(first, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "odd-comps")

    pools = touching(held, comps, classes, bound).select(F.col("node").alias("comp"), F.col("component").alias("pool"))
    members = join_unique(comps, pools, "comp", comps.count())
    members = stored(members.join(classes.select("node", "n", "copies"), "node"), "odd-members")
    rows = meetings(members.select("pool", "comp", "node", "n"), float(threshold)).join(fetched(members.select("node")), "node").join(members.select("node", "pool", "copies"), "node")
    lowered = F.translate("text", UPPER, UPPER.lower()).alias("text")
    checked = rows.select("pool", "i", "j", "block", "node", "copies", lowered).repartition("i", "j").sortWithinPartitions("pool", "i", "j").mapInArrow(ngram_join._verify(threshold), ngram_join.FOUND)
    links = stored(checked.where("other is not null").select("node", "other"), "odd-links")
    comp_of = lambda name, to: members.select(F.col("node").alias(name), F.col("comp").alias(to))
    second = connected_components(links.join(comp_of("node", "a"), "node").join(comp_of("other", "b"), "other").select("a", "b"))
    joined = join_unique(comps, second.select(F.col("node").alias("comp"), "component"), "comp", comps.count(), "left").select("node", F.coalesce("component", "comp").alias("comp"))
    placed = stored(classes.select("digest", "node", "first_id").join(joined, "node"), "odd-classed")
    least = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    classed = join_unique(placed, least, "comp", placed.count()).select("digest", "component_id")
    out = join_unique(signed.where("n > 0").select("doc_id", "digest", "n"), classed, "digest", signed.count())
    wordless = signed.where("n = 0").select("doc_id").unionByName(documents.where("text is null").select("doc_id"))
    alone = wordless.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    every = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

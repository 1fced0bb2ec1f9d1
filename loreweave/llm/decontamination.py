"""Benchmark decontamination: rare n-gram seeds joined to passages, then Smith-Waterman alignment.

A match counts 1, a substitution, insertion or deletion of a word -1; the best local score by the item's
words is the score of a pair, which is found if it reaches the threshold. A score of s means that s - 1 pairs of
neighbouring words at least are in both, so an item has as many word pairs as it can miss, and one more, as seeds:
those that are rarest in the corpus. No pair that reaches the threshold is without a seed.

Texts are cut into overlapping passages that hold any such match whole, for each class of items of one length
(from a power of two to the next). A passage is written down if it has as many word pairs of the class's items as a match
needs; its seeds are joined to the items', and each pair of a passage and an item that this gives is aligned.
Word pairs that belong to no item are sifted out in the scan by a bit table of FILTER_BITS, of one size for any
benchmark: what passes it by chance is dropped in the join.

Defined results: case and punctuation don't count; characters of scripts without spaces are words of their own;
a pair needs a word pair in common, an item of one word that word; a null or empty text or item matches nothing;
equal items and repeated rows give a match each, a pair of rows its best one, of equally good ones the first; texts
of any length are searched whole; an empty table gives no rows; further columns are ignored by find() and carried
along by decontaminate(), whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loreweave.llm.common import MIX, as_bytes, as_text, by_place, keep, mixed, slices, spaced_scripts, stored

#: Slots of a bit table, as a power of two; tables stay packed in workers too (half a megabyte each).
FILTER_BITS = 22
#: Rows up to which seeds, items and matched digests are broadcast; more are joined by a shuffle.
CARRIED = 200_000
#: Distinct words whose hashes a task remembers.
REMEMBERED = 50_000
#: Bytes of text whose words a task holds at a time: as separate values they take ten times as much.
HELD_BYTES = 1 << 20
#: All bytes that are neither letters nor digits in ASCII become spaces.
ALNUM_ONLY = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return spaced_scripts(text.lower()).encode("utf-8", "replace").translate(ALNUM_ONLY).split() if text else []


def _align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The best local score and the region's position after its end; all columns of a row at once."""
    column = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        fresh = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(region == word, 1, -1), row[1:] - 1, out=fresh[1:])
        np.maximum(fresh, 0, out=fresh)
        # a run of inserted words costs one each
        row = np.maximum.accumulate(fresh + column) - column
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def smith_waterman(item: list[bytes], region: list[bytes]) -> tuple[int, int, int]:
    """The best local score and the words of the region, from and up to, that it covers."""
    ids: dict[bytes, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in (item, region))
    score, end = _align(a, b)
    back = _align(a[::-1], b[:end][::-1])[1] if score else 0
    return score, end - back, end


def match(item: list[bytes], region: list[bytes], threshold: float) -> tuple[float, int, int] | None:
    """Score, first and last word of the item in the region, if it reaches the threshold."""
    for start in (i for i, w in enumerate(region) if w == item[0]):
        if region[start : start + len(item)] == item:
            return 1.0, start, start + len(item) - 1
    # no alignment scores more than the words in common
    count = Counter(item)
    if sum(min(n, count[w]) for w, n in Counter(w for w in region if w in count).items()) < threshold * len(item):
        return None
    score, a, b = smith_waterman(item, region)
    return (score / len(item), a, b - 1) if score >= threshold * len(item) else None


class Hasher:
    """64-bit hashes of words and of pairs of neighbours; remembers common words."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        seen = self.seen
        return np.fromiter((h if (h := seen.get(w)) is not None else seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))

    @staticmethod
    def grams(word_hashes: np.ndarray, width: int) -> np.ndarray:
        return mixed(word_hashes if width == 1 else mixed(word_hashes[:-1]) * MIX + word_hashes[1:])


def _in_table(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which grams' slots are set in a packed table."""
    slots = (grams & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int32)
    return (table[slots >> 3] & (0x80 >> (slots & 7))) != 0


def _items(threshold: float):
    """Each item with its class (the bits of its length), the word pairs that a match has at least, and all of its own in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for key, text in zip(as_bytes(part, "item"), as_text(part), strict=True):
                    if words := words_of(text):
                        grams = hasher.grams(hasher.words(words), min(2, len(words))).view(np.int64)
                        rows.append({"item": key, "text": text, "n": len(words), "kind": len(words).bit_length(), "need": max(1, math.ceil(threshold * len(words)) - 1), "grams": grams.tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item", pa.binary()), ("text", pa.string()), ("n", pa.int32()), ("kind", pa.int32()), ("need", pa.int32()), ("grams", pa.list_(pa.int64()))]))

    return run


@dataclass
class Kind:
    """Items of one class: words of a gram, of the longest match, and grams that a match needs; which grams they have, and which of these are seeds."""

    width: int
    span: int
    need: int
    grams: bytes
    seeds: bytes = b""


def _bit_table(grams: DataFrame) -> bytes:
    """The slots that the grams (column gram) fall into. They are as many as the table has at most."""
    slots = grams.select(F.expr(f"gram & {(1 << FILTER_BITS) - 1}").cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()
    table = np.zeros(1 << FILTER_BITS, bool)
    table[slots] = True
    return np.packbits(table).tobytes()


def _open(table: bytes) -> np.ndarray:
    return np.frombuffer(table, np.uint8)


def _flat(hasher: Hasher, part: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of the part's texts, where each text begins (and the last ends), and the hashes of all words."""
    texts = [words_of(t) for t in as_text(part)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return texts, bounds, np.concatenate([hasher.words(t) for t in texts]) if texts else np.empty(0, np.uint64)


def _inside(grams: np.ndarray, width: int, bounds: np.ndarray) -> np.ndarray:
    """Which grams lie in one text."""
    ok = np.ones(len(grams), bool)
    if width > 1:
        last = bounds[1:-1] - 1
        ok[last[(last >= 0) & (last < len(ok))]] = False
    return ok


def _gram_counts(table: bytes):
    """How often the grams of two words that the table has are in the task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher = _open(table), Hasher()
        for batch in batches:
            for part in slices(batch, most=HELD_BYTES):
                _, bounds, hashes = _flat(hasher, part)
                grams = hasher.grams(hashes, 2)
                found, n = np.unique(grams[_in_table(grams, bits) & _inside(grams, 2, bounds)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return run


PASSAGES = pa.schema([("digest", pa.binary()), ("kind", pa.int32()), ("start", pa.int64()), ("passage", pa.binary()), ("seeds", pa.list_(pa.int64()))])


def _passages(kinds: dict[int, Kind]):
    """Overlapping passages of each text with grams enough for a match with an item of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        tables = {k: (_open(kind.grams), _open(kind.seeds)) for k, kind in kinds.items()}
        for batch in batches:
            for part in slices(batch, most=HELD_BYTES):
                texts, bounds, hashes = _flat(hasher, part)
                digests, out = as_bytes(part, "digest"), []
                of_width = {w: hasher.grams(hashes, w) for w in {kind.width for kind in kinds.values()}}
                for k, kind in kinds.items():
                    grams, (bits, seed_bits) = of_width[kind.width], tables[k]
                    hit = _in_table(grams, bits) & _inside(grams, kind.width, bounds)
                    up_to = np.concatenate([[0], np.cumsum(hit)])
                    up_to = np.append(up_to, np.repeat(up_to[-1], len(hashes) + 1 - len(up_to)))
                    for d in np.flatnonzero(up_to[bounds[1:]] - up_to[bounds[:-1]] >= kind.need):
                        at, n = bounds[d], len(texts[d])
                        for start in range(0, n, kind.span):
                            stop = min(n, start + 2 * kind.span)
                            lo, hi = at + start, max(at + start, at + stop - kind.width + 1)
                            if up_to[hi] - up_to[lo] < kind.need:
                                continue
                            mine = grams[lo:hi][hit[lo:hi]]
                            seeds = np.unique(mine[_in_table(mine, seed_bits)])
                            if len(seeds):
                                out.append((digests[d], k, start, b" ".join(texts[d][start:stop]), seeds.view(np.int64)))
                yield pa.RecordBatch.from_pylist([dict(zip(PASSAGES.names, r, strict=True)) for r in out], schema=PASSAGES)

    return run


FOUND = pa.schema([("digest", pa.binary()), ("item", pa.binary()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def _aligned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "passage"):
                rows = []
                for digest, item, start, passage, text in zip(*(as_text(part, c) for c in ("digest", "item", "start", "passage", "text")), strict=True):
                    if found := match(words_of(text), passage.split(b" "), threshold):
                        rows.append(dict(zip(FOUND.names, (digest, item, found[0], start + found[1], start + found[2]), strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema=FOUND)

    return run


def _carried(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= CARRIED else df


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def find_texts(texts: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every pair of a different text (digest) and a different item text (item) that it holds, with score, first_word, last_word.

    texts: digest, text; benchmark: text.
    """
    items = benchmark.where("text is not null").select(_digest("text").alias("item"), "text").dropDuplicates(["item"])
    items = stored(items.mapInArrow(_items(threshold), "item binary, text string, n int, kind int, need int, grams array<long>"), "leak-items")
    spans = items.groupBy("kind").agg(F.max("n").alias("longest"), F.min("need").alias("need")).orderBy("kind").collect()  # a row for each power of two
    empty = texts.sparkSession.createDataFrame([], "digest binary, item binary, score double, first_word long, last_word long")
    if not spans:
        return empty
    places = items.select("item", "kind", "n", "need", F.posexplode("grams").alias("place", "gram"))
    counts = texts.select("text").mapInArrow(_gram_counts(_bit_table(places.where("n > 1"))), "gram long, n long")
    in_corpus = counts.groupBy("gram").agg(F.sum("n").alias("times"))
    in_items = places.groupBy("gram").agg(F.count("*").alias("own"))
    # items' own use counts too: what all of them have in common is a bad seed
    rated = places.join(in_items, "gram").join(in_corpus, "gram", "left").withColumn("times", F.coalesce("times", F.lit(0)) + F.col("own"))
    rank = F.row_number().over(W.partitionBy("item").orderBy("times", "gram", "place"))
    seeds = rated.withColumn("rank", rank).where("rank <= greatest(n - 1, 1) - need + 1").select("kind", "gram", "item").distinct()
    seeds = stored(seeds, "leak-seeds")
    kinds = {}
    for r in spans:
        of_kind = F.col("kind") == r["kind"]
        most = r["longest"] + math.floor((1 - threshold) * r["longest"]) + 2  # a match that reaches the threshold has no more inserted words
        kinds[r["kind"]] = Kind(1 if r["kind"] == 1 else 2, most, r["need"], _bit_table(places.where(of_kind)), _bit_table(seeds.where(of_kind)))
    passages = texts.mapInArrow(_passages(kinds), "digest binary, kind int, start long, passage binary, seeds array<long>")
    passages = stored(passages.dropDuplicates(["digest", "kind", "start"]), "leak-passages")
    hits = passages.select("digest", "kind", "start", F.explode("seeds").alias("gram"))
    pairs = hits.join(_carried(seeds), ["kind", "gram"]).select("digest", "kind", "start", "item").distinct()
    both = pairs.join(passages.drop("seeds"), ["digest", "kind", "start"]).join(_carried(items.select("item", "text")), "item")
    found = both.select("digest", "item", "start", "passage", "text").mapInArrow(_aligned(threshold), empty.schema)
    best = found.groupBy("digest", "item").agg(F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("x"))
    return best.select("digest", "item", "x.*")


def find(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every pair of a text and a test item that it holds: doc_id, item_id, score (to 1), first_word, last_word."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text").alias("digest"), "text")
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _digest("text").alias("item"), "text")
    found = stored(find_texts(texts.select("digest", "text"), named.select("text"), threshold), "leaks")
    with_items = _carried(found.join(named.drop("text"), "item").drop("item"))
    return texts.select("doc_id", "digest").join(with_items, "digest").select("doc_id", "item_id", "score", "first_word", "last_word")


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """documents without the texts that hold a test item."""
    numbered, names = by_place(documents)
    texts = numbered.select(_digest(names["text"]).alias("digest"), F.col(names["text"]).alias("text"))
    leaked = stored(find_texts(texts, benchmark.select("text"), threshold).select("digest").distinct(), "leaks")
    clean = numbered.withColumn("digest", _digest(names["text"])).join(_carried(leaked), "digest", "left_anti")
    return clean.select(list(names.values())).toDF(*documents.columns)

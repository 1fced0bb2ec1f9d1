"""Fill-in-the-middle: texts are cut at two random unit boundaries and their parts reordered around sentinels.

Where a unit begins is told by two adjacent bytes, so a text falls into chunks that overlap by one byte and are
counted apart from each other. Prefix sums of the counts give the number of units and route both cut ranks to the chunks
that own them; only these are scanned again for the byte at which the cut lies. Texts up to LONG bytes are counted in
the task that reads them; of longer ones pieces of PIECE bytes are dealt to all tasks, each different text once, and
their counts come back to the text's rows.

Units are code points ("char") or words with the white space that follows them ("word"; white space before the first
word is a unit of its own). Cut ranks, form and order are drawn from the sha256 of the seed and doc_id, so reruns agree.

Defined results: a null text is empty; empty texts and texts that contain a sentinel are plain, that is, unchanged; a
null doc_id draws like an empty id; rows with equal doc_id and text (ties, repeated rows) get equal results; texts of any
length are cut whole; an empty table gives no rows; further columns are carried along if asked for, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loreweave.llm.common import as_bytes, as_text, keep, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk that is counted at a time, of texts that one task counts, and of a longer text's pieces.
CHUNK, LONG, PIECE = 1 << 16, 1 << 20, 1 << 18
FORMS = ("plain", "psm", "spm")


def begins(data: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Which bytes begin a unit, from each byte and the one before it; before: the byte before the first, -1 at the text's start."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    after_white = np.concatenate([[before == 0x20 or 0x09 <= before <= 0x0D], white[:-1]])
    out = after_white & ~white
    if before < 0:
        out[:1] = True
    return out


def _chunk(data: np.ndarray, k: int, size: int, unit: str) -> np.ndarray:
    return begins(data[k * size : (k + 1) * size], int(data[k * size - 1]) if k else -1, unit)


def counts(data: np.ndarray, unit: str, size: int = CHUNK) -> np.ndarray:
    """The units that begin in each chunk of the text."""
    return np.array([np.count_nonzero(_chunk(data, k, size, unit)) for k in range(-(-len(data) // size))], np.int64)


def offset(data: np.ndarray, up_to: np.ndarray, rank: int, unit: str, size: int) -> int:
    """The byte at which the unit of this rank begins; up_to: units up to each chunk's end. Only the chunk that owns it is scanned."""
    if not len(up_to) or rank >= up_to[-1]:
        return len(data)
    k = int(np.searchsorted(up_to, rank, "right"))
    inside = rank - (int(up_to[k - 1]) if k else 0)
    return k * size + int(np.flatnonzero(_chunk(data, k, size, unit))[inside])


def _cut(names: list[str], unit: str, sentinels: tuple[str, str, str], piece: int):
    """Rows (names, text, h1, h2, form, pieces): n, prefix_units, middle_units, output; pieces: counts that were taken elsewhere, or null."""
    p, s, m = (x.encode() for x in sentinels)

    def one(text: bytes, h1: int, h2: int, form: str, pieces: list[int] | None) -> tuple[int, int | None, int | None, bytes]:
        data = np.frombuffer(text, np.uint8)
        size = CHUNK if pieces is None else piece
        up_to = np.cumsum(counts(data, unit) if pieces is None else pieces)
        n = int(up_to[-1]) if len(up_to) else 0
        if form == "plain":
            return n, None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = (offset(data, up_to, rank, unit, size) for rank in (low, high))
        parts = (p, text[:i], s, text[j:], m, text[i:j]) if form == "psm" else (s, text[j:], p, text[:i], m, text[i:j])
        return n, low, high - low, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [one(t or b"", *x) for t, *x in zip(as_bytes(part), *(as_text(part, c) for c in ("h1", "h2", "form", "pieces")), strict=True)]
                made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*keep(part, [*names, "form"]).values(), *made], [*names, "form", "n", "prefix_units", "middle_units", "output"])

    return run


def _count_pieces(unit: str):
    """Rows (digest, k, piece): the units that begin in each piece; all but a text's first piece have the byte before it in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, piece in zip(as_text(batch, "k"), as_bytes(batch, "piece"), strict=True):
                data = np.frombuffer(piece, np.uint8)
                found.append(np.count_nonzero(begins(data[1:], int(data[0]), unit) if k else begins(data, -1, unit)))
            yield pa.RecordBatch.from_arrays([*keep(batch, ["digest", "k"]).values(), pa.array(found, pa.int64())], ["digest", "k", "units"])

    return run


def piece_counts(texts: DataFrame, unit: str, piece: int = PIECE) -> DataFrame:
    """digest and pieces (the units that begin in each piece, in order) of each different text (digest, text)."""
    once = texts.select("digest", F.col("text").cast("binary").alias("raw")).dropDuplicates(["digest"])
    numbered = once.select("digest", "raw", F.explode(F.sequence(F.lit(0), F.floor((F.length("raw") - 1) / piece).cast("int"))).alias("k"))
    from_ = F.greatest(F.col("k") * piece, F.lit(1))
    pieces = numbered.select("digest", "k", F.substring("raw", from_, F.when(F.col("k") > 0, piece + 1).otherwise(piece)).alias("piece"))
    counted = pieces.repartition("digest", "k").mapInArrow(_count_pieces(unit), "digest binary, k int, units long")
    # a text has 8,192 pieces at most
    return counted.groupBy("digest").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "units"))), lambda x: x["units"]).alias("pieces"))


def draw(doc_id: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(documents: DataFrame, columns: tuple[str, ...] = ("doc_id",), unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), long_bytes: int = LONG, piece: int = PIECE) -> DataFrame:
    """The given columns of documents with form, n, prefix_units, middle_units (null if plain) and output.

    Of texts that can be cut plain_percent stay plain; of the others spm_percent have the suffix first.
    """
    own = [f"c{k}" for k in range(len(columns))]
    numbered = documents.select(*[F.col(c).alias(o) for c, o in zip(columns, own, strict=True)], F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    h1, h2, h3, h4 = draw("id", seed)
    with_sentinel = F.lit(False)
    for s in sentinels:
        with_sentinel |= F.contains(text, F.lit(s))
    form = F.when((text == "") | with_sentinel | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = numbered.select(*own, "text", h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    schema = StructType([*rows.select(*own, "form").schema]).add("n", "long").add("prefix_units", "long").add("middle_units", "long").add("output", "string")
    long = rows.where(F.octet_length("text") > long_bytes).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # rows of one text that many documents repeat are split by adaptive execution: the other side is one small row
    routed = long.join(piece_counts(long.select("digest", "text"), unit, piece), "digest").drop("digest")
    short = rows.where(F.octet_length("text") <= long_bytes).withColumn("pieces", F.lit(None).cast("array<bigint>"))
    cut = short.unionByName(routed).mapInArrow(_cut(own, unit, sentinels, piece), schema)
    return cut.select(*[F.col(o).alias(c) for c, o in zip(columns, own, strict=True)], "form", "n", "prefix_units", "middle_units", "output")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = sentinels
    at = {x: F.position(F.lit(x), output) for x in sentinels}
    between = lambda a, b: F.substring(output, at[a] + len(a), at[b] - at[a] - len(a))
    tail = F.substring(output, at[m] + len(m), F.length(output))
    psm = F.concat(between(p, s), tail, between(s, m))
    spm = F.concat(between(p, m), tail, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)

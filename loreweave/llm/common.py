"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.shuffles import connected_components, join_unique, shared_folder, stored

__all__ = ["MIX", "apart", "as_bytes", "as_text", "by_place", "connected_components", "join_unique", "keep", "mixed", "remainder", "shared_folder", "slices", "small_batches", "spaced_scripts", "stored", "unit_hash"]

#: Bytes of text that a task works on at a time, so that memory doesn't depend on Spark's batch size.
SLICE_BYTES = 4 << 20
#: Bytes of a batch of rows between Spark and its Python workers: both sides hold some batches at a time.
BATCH_BYTES = 3 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters of scripts that are written without spaces between words: each is a unit of its own.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
NO_WORD = re.compile(r"[^\w]+")


def apart(text: str) -> str:
    """The text with spaces around the characters of unspaced scripts."""
    return text if text.isascii() or not UNSPACED.search(text) else UNSPACED.sub(r" \1 ", text)


def spaced_scripts(text: str) -> str:
    """The text with punctuation outside ASCII as spaces, and with spaces around the characters of unspaced scripts."""
    if text.isascii():
        return text
    return apart(NO_WORD.sub(" ", text))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit of which depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_place(df: DataFrame, *but: str) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ... and which each column became: no name of df is in the way of further ones.

    Columns named in `but` keep their names.
    """
    names = {c: c if c in but else f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo modulus; null for null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def unit_hash(*columns: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of the column, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n) + 1
    yield batch.slice(start)


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def as_text(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands rows to the session's Python workers in batches of BATCH_BYTES at most, one row at least.

    The setting stays, as what a caller gets is executed later; where the user has set another size, that holds.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, f"{BATCH_BYTES}b")


def keep(batch: pa.RecordBatch, names: Iterable[str]) -> dict[str, pa.Array]:
    return {n: batch.column(batch.schema.get_field_index(n)) for n in names}

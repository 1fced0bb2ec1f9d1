"""Token counts of a subword tokenizer without token ids.

A piece of the tokenizer never holds a space after another character, so a text falls apart into
pre-tokens (a run of spaces and the non-spaces after it) that are tokenised independently of each other.
Each text becomes its pre-tokens' frequencies. A bounded number of common pre-tokens (`common`) are counted once on the
executors and sent to all tasks; all others are partitioned and sorted, so that a distinct pre-token is
counted once and joined to its per-document frequencies, which follow it; the products are summed per document.
Which pre-tokens are common is read from a sample and changes the speed only: one that a thousandth of
the texts holds is among them, so that no partition has a hot one, of whatever length (those of over SHORT bytes
are known by their 128-bit digest).

Defined results: a null or empty text has no tokens and no bytes; a text without spaces is one pre-token
of any length; different texts of one id, or of none, are kept apart by 64 bits of their hash and the id, or by
128 bits, and repeated rows give equal rows; an empty table gives no rows; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import as_text, keep, slices, unit_hash

#: The tokenizer's sign for a space.
SPACE = "▁"
#: Bytes up to which a common pre-token is its own key.
SHORT = 64
#: Texts on which a vocabulary's treatment of spaces is tried.
PROBES = ("a", " a", "a ", "a b", "a  b", "  a", "a   ", " ", "   ", "a\tb", "a\n b", "▁a", "a▁b", "Ab c1 ß", "x　y z", " a b", "ﬁ ½ x", "é b")


def load(model: bytes):
    """The tokenizer, if its pre-tokens are independent: pieces stay between spaces and no normalisation changes a space."""
    import sentencepiece

    tokenizer = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any(re.search(f"[^{SPACE}]{SPACE}", tokenizer.id_to_piece(i)) for i in range(tokenizer.get_piece_size())):
        raise ValueError("this vocabulary has pieces that go beyond a space: pre-tokens depend on each other")
    check(tokenizer)
    return tokenizer


def check(tokenizer) -> None:
    """Raises for a vocabulary that joins, drops or adds spaces: its texts aren't the sum of their pre-tokens."""
    for text in PROBES:
        if len(tokenizer.encode(text)) != sum(count_pieces(tokenizer, w) for w in pre_tokens(text)):
            raise ValueError(f"this vocabulary treats the spaces of {text!r} in another way than pre-tokens do")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space, which the tokenizer adds again.

    Spaces at the end of a text form a pre-token of their own; a single one is the empty string.
    """
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    parts = text.split(" ")
    if parts[0] and parts[-1] and "  " not in text:
        return parts
    return [m[1:] for m in re.findall(" +[^ ]*", f" {text}")]


def count_pieces(tokenizer, pre_token: str) -> int:
    return len(tokenizer.encode(pre_token)) if pre_token else 1


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            seen: Counter = Counter()
            for text in as_text(part):
                seen.update(pre_tokens(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre_token", "n"])


def _key(pre_token: str) -> str:
    """The pre-token, or the digest of a long one; no pre-token holds the sign for a space."""
    if len(pre_token) * 4 <= SHORT or len(raw := pre_token.encode()) <= SHORT:
        return pre_token
    return SPACE + md5(raw, usedforsecurity=False).hexdigest()


def _counted(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model)
        for batch in batches:
            words = as_text(batch, "pre_token")
            yield pa.RecordBatch.from_arrays([pa.array([_key(w) for w in words], pa.string()), pa.array([count_pieces(tokenizer, w) for w in words], pa.int32())], ["key", "pieces"])

    return run


def common_pre_tokens(documents: DataFrame, model: bytes, common: int, sampled_rows: int = 8_000) -> dict[str, int]:
    """The pieces of the most frequent pre-tokens in a sample of rows, `common` of them at most."""
    total = documents.count()
    sample = documents.where(unit_hash("text", seed="pre-token sample") < min(1.0, sampled_rows / max(total, 1)))
    seen = sample.mapInArrow(_frequencies, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    top = seen.where("n > 1").orderBy(F.desc("n"), "pre_token").limit(common).select("pre_token")
    table = top.mapInArrow(_counted(model), "key string, pieces int").toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


#: What tells the rows of documents apart.
ROW = ["id", "hash", "no_id"]
COUNTS = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("no_id", pa.bool_()), ("n_bytes", pa.int64()), ("tokens", pa.int64()), ("row_count", pa.int64())])
COUNTS_DDL = "id long, hash long, no_id boolean, n_bytes long, tokens long, row_count long"


def _split(common: dict[str, int]):
    """A row for each text, with the tokens of its common pre-tokens, and one for each other pre-token of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = common.get
        for batch in batches:
            for part in slices(batch):
                row = keep(part, ROW)
                n_bytes, tokens = [], []
                rest: list[str] = []
                times: list[int] = []
                at: list[int] = []
                for i, text in enumerate(as_text(part)):
                    text = text or ""
                    words = pre_tokens(text)
                    pieces = list(map(get, words))
                    known = sum(filter(None, pieces))
                    for w, n in Counter(w for w, k in zip(words, pieces, strict=True) if k is None).items():
                        if len(w) * 4 > SHORT and (k := get(_key(w))) is not None:
                            known += k * n
                            continue
                        rest.append(w)
                        times.append(n)
                        at.append(i)
                    tokens.append(known)
                    n_bytes.append(len(text.encode()))
                place, n = pa.array(at, pa.int64()), len(at)
                out = {c: pa.concat_arrays([row[c], row[c].take(place)]) for c in ROW} | {
                    "n_bytes": pa.concat_arrays([pa.array(n_bytes, pa.int64()), pa.nulls(n, pa.int64())]),
                    "tokens": pa.concat_arrays([pa.array(tokens, pa.int64()), pa.nulls(n, pa.int64())]),
                    "row_count": pa.concat_arrays([pa.array(np.ones(len(tokens), np.int64)), pa.nulls(n, pa.int64())]),
                    "pre_token": pa.concat_arrays([pa.nulls(len(tokens), pa.string()), pa.array(rest, pa.string())]),
                    "n": pa.concat_arrays([pa.nulls(len(tokens), pa.int64()), pa.array(times, pa.int64())]),
                }
                yield pa.RecordBatch.from_pydict(out)

    return run


def _joined(model: bytes):
    """Rows come sorted by pre-token, all of one in this partition: each is counted once, and its frequencies are multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model)
        last, last_pieces = None, 0
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("pre_token")).dictionary_encode()
            words = col.dictionary.to_pylist()
            counts = [last_pieces if w == last else count_pieces(tokenizer, w) for w in words]
            if words:
                last, last_pieces = words[-1], counts[-1]
            part = keep(batch, [*COUNTS.names, "n"])
            products = pc.multiply(pa.array(counts, pa.int64()).take(col.indices), part["n"])
            part["tokens"] = pc.coalesce(part["tokens"], products)
            yield pa.RecordBatch.from_arrays([part[c] for c in COUNTS.names], COUNTS.names)

    return run


def count_tokens(documents: DataFrame, model_path: str, common: int = 131_072) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text of documents (doc_id, text), as the tokenizer file gives them."""
    model = Path(model_path).read_bytes()
    load(model)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = documents.select(F.coalesce(doc_id, F.xxhash64(F.lit("no id"), text)).alias("id"), F.xxhash64(text).alias("hash"), doc_id.isNull().alias("no_id"), "text")
    parts = rows.mapInArrow(_split(common_pre_tokens(rows.select("text"), model, common)), f"{COUNTS_DDL}, pre_token string, n long")
    together = parts.repartition(F.coalesce("pre_token", F.concat(F.lit(SPACE), F.col("hash").cast("string")))).sortWithinPartitions("pre_token")
    sums = together.mapInArrow(_joined(model), COUNTS_DDL).groupBy(*ROW).agg(F.sum("tokens").alias("tokens"), F.max("n_bytes").alias("n_bytes"), F.sum("row_count").alias("row_count"))
    # repeated rows were summed together and become as many rows again
    one = sums.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_bytes", F.expr("tokens div row_count").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("row_count"))).alias("copy"))
    return one.drop("copy")

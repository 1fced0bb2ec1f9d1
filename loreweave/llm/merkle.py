"""A Merkle manifest of a data set: a tree for each language, a tree over their roots, a proof for each document.

A leaf is the sha256 of a row's fields, each `-` if null and else its byte count, a colon and the value. The leaves of a
language ascend by doc_id (null first, equal ids by leaf); FANOUT consecutive nodes at a time become the sha256 of their hex
digests, until one is left, the language's subroot; subroots, ascending by language (null first), give the root likewise.

A leaf's rank needs no global sort: doc_id is read as digits, most significant first, and a histogram of leading digits per
language, summed hierarchically (over the digits' upper half, then inside it), says how many leaves come before each bucket.
Buckets of over CROWDED rows are split by their next digits, which go on with the leaf and the row's number where ids are
equal, so no bucket is large whatever the ids are; inside a bucket rows are numbered. A rank in base FANOUT is a
leaf's path in the trie of nodes: nodes with the same prefix are one run. SPAN levels are reduced for each shuffle, since
all leaves below one prefix meet in a block of FANOUT ** SPAN; from the top down each block then gets the siblings
above it, and proofs are made block by block.

Defined results: null fields count as `-`, empty texts as `0:`; rows that are equal in all fields are leaves of their own
with equal digests; texts of any length are hashed whole; a lone leaf is its language's subroot; an empty table gives no rows;
further columns are ignored, whatever their names. Subroots (one row for each language) are ordered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreweave.llm.common import as_text, join_unique, stored

FANOUT, SPAN = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a bucket that are aimed at, and rows above which it is split further.
AIM, CROWDED = 1024, 8192
#: Bits of a digit at most, and of its lower half.
DIGIT, HALF = 20, 10
KEYS = ("k0", "k1", "k2", "k3")


def leaf(*fields: Column) -> Column:
    """The sha256 of the fields, in hex."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def leaves(documents: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, part (the language), digest and altered (the digest with that text, null where it is null), keys that order a part's rows."""
    own = documents.select(*[F.col(c) for c in FIELDS], (F.lit(None).cast("string") if altered is None else altered).alias("other"))
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(F.col("other").isNotNull(), F.unhex(leaf(*fields[:-1], F.col("other"))))
    part = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    return stored(own.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.unhex(leaf(*fields)).alias("digest"), changed.alias("altered"), F.monotonically_increasing_id().alias("k3")), "merkle-leaves")


def _keyed(rows: DataFrame) -> DataFrame:
    upper = F.coalesce(F.shiftright("doc_id", 32), F.lit(-(1 << 31) - 1).cast("long"))
    lower = F.coalesce(F.col("doc_id").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0).cast("long"))
    return rows.withColumns({"k0": upper, "k1": lower, "k2": F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")})


def _spec(buckets: DataFrame) -> DataFrame:
    """b, base, key (the first one that differs inside the bucket), lo and shift: how a bucket (b, n, base, least and most of each key) is split."""
    differs = lambda k: F.col(f"lo_{k}") < F.col(f"hi_{k}")
    pick = lambda f: F.coalesce(*[F.when(differs(k), f(k)) for k in KEYS], f(KEYS[-1]))
    bits = lambda c: F.when(c > 0, F.length(F.bin(c))).otherwise(0)
    width = F.greatest(F.lit(1), F.least(F.lit(DIGIT), F.ceil(F.log2(F.col("n") / AIM)).cast("int")))
    return buckets.select("b", "base", pick(lambda k: F.lit(k)).alias("key"), pick(lambda k: F.col(f"lo_{k}")).alias("lo"), F.greatest(F.lit(0), bits(pick(lambda k: F.col(f"hi_{k}") - F.col(f"lo_{k}"))) - width).alias("shift"))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[f(k).alias(f"{name}_{k}") for k in KEYS for f, name in ((F.min, "lo"), (F.max, "hi"))])


def ranked(rows: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """part, rank (from 0, by k0 to k3, digests before k3), total (rows of the part), doc_id, digest, altered."""
    todo = _keyed(rows).withColumn("b", F.col("part"))
    parts = stored(_sums(todo, "b").withColumn("base", F.lit(0).cast("long")), "merkle-parts")
    totals, buckets, out = parts.select(F.col("b").alias("part"), F.col("n").alias("total")), parts, None
    while (n := buckets.agg(F.sum("n")).first()[0]) is not None:
        dug = join_unique(todo, _spec(buckets), "b", n)
        value = F.coalesce(*[F.when(F.col("key") == k, F.col(k)) for k in KEYS])
        digit = F.expr("shiftright(value - lo, shift)")
        dug = dug.withColumn("value", value).withColumn("digit", digit).withColumn("path", F.concat_ws("/", "b", "digit")).drop("key", "lo", "shift", "value")
        histogram = _sums(dug, "b", "base", "digit", "path").withColumn("upper", F.shiftright("digit", HALF))
        # both sums run over 2 ** HALF rows at most
        uppers = histogram.groupBy("b", "upper").agg(F.sum("n").alias("m"))
        before = uppers.withColumn("before", F.sum("m").over(W.partitionBy("b").orderBy("upper")) - F.col("m")).drop("m")
        inside = histogram.withColumn("inside", F.sum("n").over(W.partitionBy("b", "upper").orderBy("digit")) - F.col("n"))
        found = inside.join(before, ["b", "upper"]).select(F.col("path").alias("b"), "n", (F.col("base") + F.col("before") + F.col("inside")).alias("base"), *[f"{x}_{k}" for k in KEYS for x in ("lo", "hi")])
        found = stored(found, "merkle-buckets")
        moved = dug.drop("b", "base", "digit").withColumnRenamed("path", "b")
        small = moved.join(found.where(F.col("n") <= crowded).select("b", "base"), "b")
        order = W.partitionBy("b").orderBy("k0", "k1", "digest", "k3")
        placed = small.select("part", (F.col("base") + F.row_number().over(order) - 1).alias("rank"), "doc_id", "digest", "altered")
        out = placed if out is None else out.unionByName(placed)
        buckets = found.where(F.col("n") > crowded)
        if left := buckets.agg(F.sum("n")).first()[0]:
            todo = stored(join_unique(moved, buckets.select("b"), "b", left), "merkle-crowded")
    empty = rows.select("part", F.lit(0).cast("long").alias("rank"), "doc_id", "digest", "altered").where("false")
    return stored(join_unique(empty if out is None else out, totals, "part", rows.count()), "merkle-ranked")


def run_hash(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _grown(nodes: list[str], whole: bool, fanout: int) -> list[list[str]]:
    """The levels of a block from its nodes up: SPAN runs up, or up to one node if the block holds a whole tree."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= SPAN:
        below = levels[-1]
        levels.append([run_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def _siblings(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """What stands before and after a node and its ancestors in their runs, from the bottom up."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def _packed(chain: list[tuple[str, str]]) -> bytes:
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + bytes.fromhex(a + b) for a, b in chain)


def _unpacked(packed: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(packed):
        a, b = packed[at], packed[at + 1]
        text = packed[at + 2 : at + 2 + 32 * (a + b)].hex()
        out.append((text[: 64 * a], text[64 * a :]))
        at += 2 + 32 * (a + b)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[str, int, list[tuple]]]:
    """Rows that come sorted by part and block, block by block."""
    rows = (r for batch in batches for r in zip(*(as_text(batch, c) for c in ("part", "block", *columns)), strict=True))
    for (part, block), members in groupby(rows, key=lambda r: r[:2]):
        yield part, block, [r[2:] for r in members]


def _reduced(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = fanout**SPAN
        for part, block, rows in _blocks(batches, ("digest", "total")):
            total = rows[0][1]
            top = _grown([d.hex() for d, _ in rows], total <= size, fanout)[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.string()), pa.array([block], pa.int64()), pa.array([-(-total // size)], pa.int64()), pa.array([bytes.fromhex(top)], pa.binary())], ["part", "rank", "total", "digest"])

    return run


NODE = "part string, rank long, total long, digest binary"


def _in_blocks(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("part", "block").sortWithinPartitions("part", "block", *order)


def _block(fanout: int) -> Column:
    return F.expr(f"rank div {fanout**SPAN}").alias("block")


def reduced(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes SPAN levels up (part, rank, total, digest), one for each block of nodes."""
    rows = nodes.select("part", _block(fanout), "rank", "total", "digest")
    return stored(_in_blocks(rows, "rank").mapInArrow(_reduced(fanout), NODE), "merkle-nodes")


def tower(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The nodes and those of each SPAN levels above, until each part has one; two tables at least."""
    most = nodes.agg(F.max("total")).first()[0] or 1
    out = [nodes, reduced(nodes, fanout)]
    while (most := -(-most // fanout**SPAN)) > 1:
        out.append(reduced(out[-1], fanout))
    return out


def _chained(fanout: int, bottom: bool, root: str):
    """Blocks that begin with their header: for each row the siblings above it, or at the bottom what they prove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, (head, *rows) in _blocks(batches, ("rank", "total", "digest", "chain", "doc_id", "altered")):
            subroot, above = head[2], _unpacked(head[3])
            levels = _grown([r[2].hex() for r in rows], rows[0][1] <= fanout**SPAN, fanout)
            chains = [_siblings(levels, k, fanout) for k in range(len(rows))]
            if not bottom:
                own = [_packed([*c, *above]) for c in chains]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([subroot] * len(rows), pa.binary()), pa.array(own, pa.binary())], ["part", "block", "digest", "chain"])
                continue
            rest = "".join(a + b for a, b in above)
            proofs, folded = [], []
            for (*_, digest, _, _, altered), chain in zip(rows, chains, strict=True):
                proofs.append(run_hash([*(a + b for a, b in chain), rest]))
                node = (altered or digest).hex()
                for a, b in (*chain, *above):
                    node = run_hash([a, node, b])
                folded.append(node)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[4] for r in rows], pa.int64()), pa.array(levels[0]), pa.array([subroot.hex()] * len(rows)), pa.array([root] * len(rows)),
                pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded]),
            ], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


HEADER = "part string, block long, digest binary, chain binary"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def chained(nodes: DataFrame, headers: DataFrame, fanout: int, bottom: bool = False, root: str = "") -> DataFrame:
    """The siblings above each node (as headers of the blocks below it), or proofs; headers: of the nodes' blocks."""
    heads = headers.select("part", "block", F.lit(-1).cast("long").alias("rank"), F.lit(None).cast("long").alias("total"), "digest", "chain", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))
    none = lambda c, kind: F.col(c) if c in nodes.columns else F.lit(None).cast(kind).alias(c)
    rows = nodes.select("part", _block(fanout), "rank", "total", "digest", F.lit(None).cast("binary").alias("chain"), none("doc_id", "long"), none("altered", "binary"))
    made = _in_blocks(heads.unionByName(rows), "rank").mapInArrow(_chained(fanout, bottom, root), PROOF if bottom else HEADER)
    return made if bottom else stored(made, "merkle-chains")


def manifest(documents: DataFrame, altered: Column | None = None, fanout: int = FANOUT, crowded: int = CROWDED) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    proof_sha256 is the sha256 of the siblings from the leaf up to the root; folded_root is what a leaf and
    its siblings give, for rows whose `altered` isn't null the leaf of the row with that text; verified: it is the root.
    """
    trees = tower(ranked(leaves(documents, altered), crowded), fanout)
    subroots = trees[-1]
    numbered = subroots.select(F.lit("").alias("part"), (F.row_number().over(W.orderBy(F.col("part"))) - 1).cast("long").alias("rank"), "digest", F.col("part").alias("own"))
    numbered = stored(numbered, "merkle-subroots")
    top = tower(numbered.select("part", "rank", F.lit(numbered.count()).cast("long").alias("total"), "digest"), fanout)
    root = top[-1].first()
    if root is None:
        return documents.sparkSession.createDataFrame([], PROOF)
    headers = top[-1].select("part", F.col("rank").alias("block"), "digest", F.lit(b"").alias("chain"))
    for nodes in reversed(top[:-1]):
        headers = chained(nodes, headers, fanout)
    over = headers.select(F.col("block").alias("rank"), "chain")  # a row for each language
    headers = stored(numbered.join(over, "rank").select(F.col("own").alias("part"), F.lit(0).cast("long").alias("block"), "digest", "chain"), "merkle-chains")
    for nodes in reversed(trees[1:-1]):
        headers = chained(nodes, headers, fanout)
    return chained(trees[0], headers, fanout, True, bytes(root["digest"]).hex())

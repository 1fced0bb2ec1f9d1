"""Chat formatting of reply trees.

A message names its parent; a root has none (or one that isn't there). Root-to-leaf paths are enumerated
by self-joins that double their reach: after k rounds each message knows its ancestor 2**k above and the
score and length of the stretch up to it, so the rounds grow with the logarithm of the depth and no path
is carried along. Branches are ranked by mean score, and the chosen ones are unfolded from their leaves
through the same jumps. Each path becomes one text:

    ### role: text</turn>\\n        for each turn

In roles and texts a backslash goes before each backslash, `###` and `</turn>` (in roles before `:` too),
which is undone by taking away each backslash that isn't itself behind one.

Defined results: null text or role is empty; messages of one tree with the same id are ordered by role and
text and become replies to each other; rows without a conversation id are one conversation, apart from every id; texts of
any length are formatted whole; messages in a cycle are on no path; ties between branches go to the
longer and then to the smaller leaf; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loreweave.llm.common import as_text, slices, stored

IN_TEXT, IN_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)"), re.compile(r"[\\:]|#(?=##)|<(?=/turn>)")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
TRAINED = "assistant"


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and where in it the assistant's (escaped) texts are."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {IN_ROLE.sub(r'\\\g<0>', role)}: ", IN_TEXT.sub(r"\\\g<0>", text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that format_turns() got."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def choose_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best branches of each tree. messages: tree, node, parent, score (all long but score).

    Gives tree, leaf, branch (rank from 1), node, above (steps up from the leaf). Nodes are unique in a tree.
    """
    known = messages.select("tree", F.col("node").alias("parent"))
    at_root = F.col("_p").isNull()
    base = messages.join(known.withColumn("_p", F.lit(True)), ["tree", "parent"], "left")
    base = base.select("tree", "node", F.when(at_root, None).otherwise(F.col("parent")).alias("jump"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("length"))
    base = stored(base, "chat-jumps")
    n = base.count()
    # a message that has reached its root is in no later round, but to be looked up; what has more above it than there is, is in a cycle
    opened, closed = [base.where("jump is not null")], [base.where("jump is null")]
    while 1 << (len(opened) - 1) <= n and not opened[-1].isEmpty():
        known = reduce(DataFrame.unionByName, closed, opened[-1])
        up = known.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("total").alias("more"), F.col("length").alias("further"))
        further = opened[-1].join(up, ["tree", "jump"]).select("tree", "node", F.col("next").alias("jump"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("further")).alias("length"))
        further = stored(further, "chat-jumps")
        opened.append(further.where("jump is not null"))
        closed.append(further.where("jump is null"))
    parents = opened[0].select("tree", F.col("jump").alias("node")).distinct()
    leaves = reduce(DataFrame.unionByName, closed).join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), F.desc("length"), "node"))
    paths = [stored(leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree", F.col("node").alias("leaf"), "branch", "node", F.lit(0).cast("long").alias("above")), "chat-paths")]
    for k, level in enumerate(opened[:-1]):
        up = reduce(DataFrame.unionByName, paths).join(level.select("tree", "node", "jump"), ["tree", "node"])
        paths.append(stored(up.select("tree", "leaf", "branch", F.col("jump").alias("node"), (F.col("above") + (1 << k)).alias("above")), "chat-paths"))
    return reduce(DataFrame.unionByName, paths)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tree, branch and from root to leaf; one conversation is held at a time."""

    kind = pa.int64()

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("tree").type
            for part in slices(batch):
                yield from zip(*(as_text(part, c) for c in ("tree", "branch", "role", "text")), strict=True)

    for (tree, branch), turns in groupby(rows(), key=lambda r: r[:2]):
        formatted, spans = format_turns([(role or "", text or "") for _, _, role, text in turns])
        yield pa.RecordBatch.from_arrays([pa.array([tree], kind), pa.array([branch], pa.int32()), pa.array([formatted], pa.string()), pa.array([[{"start": a, "stop": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["tree", "branch", "formatted", "loss_spans"])


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """tree, branch, formatted and loss_spans (start, stop: characters of formatted) of each chosen path."""
    full = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "branch", "above", "role", "text")
    ordered = full.repartition("tree", "branch").sortWithinPartitions("tree", "branch", F.desc("above"))
    return ordered.select("tree", "branch", "role", "text").mapInArrow(_assemble, f"tree {paths.schema['tree'].dataType.simpleString()}, branch int, formatted string, loss_spans array<struct<start: long, stop: long>>")


#: Stands for a missing conv_id.
NO_ID = Decimal(1 << 63)


def threads(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as trees in which each row replies to the one before it.

    A tree has its conversation's id; rows without one are a tree of their own, whose number is NO_ID, beyond all longs.
    """
    tree = F.coalesce(F.col("conv_id").cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)"))
    order = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation."""
    messages = stored(threads(conversations), "chat-messages")
    done = format_paths(choose_paths(messages), messages)
    return done.select(F.when(F.col("tree") < NO_ID, F.col("tree").cast("long")).alias("conv_id"), "formatted", "loss_spans")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for conv_id, formatted, spans in zip(*(as_text(batch, c) for c in ("conv_id", "formatted", "loss_spans")), strict=True):
            turns = read_turns(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in spans)
            values = (conv_id, len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss), len(formatted))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, as parsed from the formatted texts."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

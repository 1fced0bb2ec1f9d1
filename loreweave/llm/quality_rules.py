"""Quality rules whose limits follow the data.

Each text yields counts over its words (runs of characters other than space and \\t to \\r) and measures:
shares in thousandths and the mean length of a word in hundredths. A group (lang, source) has for each
measure a quantile sketch: counts of buckets that are exact up to 2 * STEPS and then STEPS to each power of
two, so that a quantile is off by 1 / STEPS of itself at most, and sketches merge by adding counts. Of a share only texts
that have some of it are ranked (Q); how many have none is a count beside. A group's own limits:

- fence: Q(level) + reach * (Q(level) - median), for both ends also below; none where the ranked texts are all alike;
- a rare measure, where at least half of the texts have none: half of the value at which the lower tenth of the others ends.

Limits are pulled towards those of the merged sketches of the language, and these towards all texts', as if SUPPORT texts
more spoke for them: few texts of a group say little, many say all, and no size switches from one to the other. Without
a limit of its own a group has its language's. Limits are joined to the texts of their group; a text in the bucket of
the limit is kept.

Defined results: a null or empty text has no words and fails; texts without words are in no sketch; null
lang or source is a group of its own; ties and repeated rows are judged alike; texts of any length are read
whole; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loreweave.llm.common import as_bytes, join_unique, keep, slices, stored

WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Words of a window that counts as repeated.
SPAN = 8
#: How many texts the wider sketch counts for beside a group's own.
SUPPORT = 200
#: Buckets of a sketch for each power of two.
STEPS = 128


@dataclass(frozen=True)
class Rule:
    """level: the quantile, in thousandths, from which on texts are unusual; reach: how far beyond it they may be; both: low values are unusual too; rare: see above."""

    level: int
    reach: int
    both: bool = False
    rare: bool = False


RULES = {
    "symbol_share": Rule(900, 1, rare=True),
    "dup_line_share": Rule(900, 2),
    "repeat_share": Rule(900, 2),
    "word_length": Rule(750, 8, both=True),
}


def repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each text the words in SPAN-word windows that occur twice or more in it.

    ids: the words of all texts as numbers; doc: the text that each belongs to, ascending. Windows of 2, 4
    and 8 words get numbers in turn, equal for equal windows only.
    """
    out = np.zeros(docs, np.int64)
    width = 1
    while width < SPAN:
        if len(ids) <= width:
            return out
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    start = np.flatnonzero(doc[: len(ids)] == doc[SPAN - 1 :])
    if not len(start):
        return out
    _, inverse, n = np.unique(ids[start] * docs + doc[start], return_inverse=True, return_counts=True)
    again = start[n[inverse] > 1]
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + SPAN, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs).astype(np.int64)


def _measure(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in as_bytes(part)]
                seen: dict[bytes, int] = {}
                flat: list[int] = []
                n_words = np.zeros(len(texts), np.int64)
                chars, symbols, lines, dup_lines = (np.zeros(len(texts), np.int64) for _ in range(4))
                for i, text in enumerate(texts):
                    words = text.split()
                    n_words[i] = len(words)
                    flat += [seen.setdefault(w, len(seen)) for w in words]
                    solid = text.translate(None, WHITE)
                    chars[i] = len(solid) if solid.isascii() else int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) != 0x80))
                    symbols[i] = len(text) - len(text.translate(None, SYMBOLS))
                    with_words = [x for x in text.split(b"\n") if x and not x.isspace()]
                    lines[i] = len(with_words)
                    dup_lines[i] = len(with_words) - len(set(with_words))
                repeats = repeated_words(np.array(flat, np.int64), np.repeat(np.arange(len(texts)), n_words), len(texts))
                yield pa.RecordBatch.from_arrays([*keep(part, names).values(), *map(pa.array, (n_words, chars, symbols, lines, dup_lines, repeats))], [*names, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])

    return run


def bucket(value: str) -> Column:
    """The least value of the bucket that a number of 0 or more falls into."""
    shift = f"length(bin({value})) - {STEPS.bit_length()}"
    return F.expr(f"CASE WHEN {value} < {2 * STEPS} THEN {value} ELSE shiftleft(shiftright({value}, {shift}), {shift}) END")


def measure(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns with the counts, base_failed, and the measures as buckets (null without words)."""
    schema = documents.select(columns).schema
    for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(c, "long")
    per = lambda part, whole, unit: F.when(F.col("n_words") > 0, F.expr(f"{unit} * {part} div {whole}"))
    counted = documents.select(*columns, "text").mapInArrow(_measure(columns), schema)
    measured = counted.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "symbol_share": per("n_symbols", "word_chars", 1000),
        "dup_line_share": per("n_dup_lines", "n_lines", 1000),
        "repeat_share": per("n_repeat_words", "n_words", 1000),
        "word_length": per("word_chars", "n_words", 100),
    })
    return measured.withColumns({m: bucket(m) for m in RULES})


def limits(measured: DataFrame) -> DataFrame:
    """Group and the lower and upper limit of each measure, from the merged sketches."""
    by_group = lambda: F.array(F.struct(F.lit(1).alias("level"), F.col("group").alias("of")), F.struct(F.lit(2).alias("level"), F.col("lang_key").alias("of")), F.struct(F.lit(3).alias("level"), F.lit("").alias("of")))
    longer = measured.where("n_words > 0").select("group", "lang_key", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in RULES])).alias("x"))
    sketch = longer.groupBy("group", "lang_key", "x.measure", "x.value").count()
    merged = sketch.select(F.explode(by_group()).alias("l"), "measure", "value", "count").groupBy("l.level", "l.of", "measure", "value").agg(F.sum("count").alias("n"))
    # a sketch has some hundred buckets at most, however many texts it counts
    by = W.partitionBy("level", "of", "measure")
    rule = lambda f: F.coalesce(*[F.when(F.col("measure") == m, F.lit(f(r))) for m, r in RULES.items()])
    counts = F.when((F.col("value") > 0) | rule(lambda r: r.both), F.col("n")).otherwise(0)
    ranked = merged.withColumn("w", counts).withColumns({"up_to": F.sum("w").over(by.orderBy("value")), "total": F.sum("w").over(by), "texts": F.sum("n").over(by)})
    at = lambda q: F.min(F.when((F.col("w") > 0) & (1000 * F.col("up_to") >= q * F.col("total")), F.col("value")))
    quantiles = ranked.groupBy("level", "of", "measure").agg(F.max("total").alias("total"), F.max("texts").alias("texts"), at(F.lit(100)).alias("tenth"), at(F.lit(500)).alias("middle"), at(rule(lambda r: r.level)).alias("high"), at(rule(lambda r: 1000 - r.level)).alias("low"))
    reach, both = rule(lambda r: r.reach), rule(lambda r: r.both)
    seldom = rule(lambda r: r.rare) & (2 * F.col("total") <= F.col("texts"))
    spread = (F.col("high") > F.col("middle")) | both & (F.col("low") < F.col("middle"))
    most = F.when(seldom, F.expr("tenth div 2")).when(spread, F.col("high") + reach * (F.col("high") - F.col("middle")))
    least = F.when(seldom | ~both, most * 0).when(spread, F.greatest(F.lit(0), F.col("low") - reach * (F.col("middle") - F.col("low"))))
    own = quantiles.select("level", "of", "measure", "texts", least.alias("least"), most.alias("most"))
    # a row for each group, level that applies to it and measure
    wanted = sketch.select("group", "lang_key").distinct().select("group", F.explode(by_group()).alias("l")).select("group", "l.level", "l.of")
    of = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c))).alias(f"{c}{level}")
    levels = wanted.join(own, ["level", "of"]).groupBy("group", "measure").agg(*[of(k, c) for k in (1, 2, 3) for c in ("texts", "least", "most")])
    pulled = lambda n, x, to: F.coalesce(F.expr(f"({n} * {x} + {SUPPORT} * {to}) div ({n} + {SUPPORT})"), F.col(x), F.col(to))
    for c in ("least", "most"):
        levels = levels.withColumn(f"{c}2", pulled("texts2", f"{c}2", f"{c}3")).withColumn(f"{c}1", pulled("texts1", f"{c}1", f"{c}2"))
    best = levels.select("group", "measure", F.struct(F.col("least1").alias("least"), F.col("most1").alias("most")).alias("limit"))
    return best.groupBy("group").agg(*[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"{m}_limit") for m in RULES])


def judge(documents: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of documents, the counts and measures, the limits of the text's group, base_failed and kept."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    source = documents.select(*[F.col(c) for c in columns], "text", key("lang").alias("lang_key"), F.concat_ws("\u0001", key("lang"), key("source")).alias("group"))
    measured = stored(measure(source, [*columns, "lang_key", "group"]), "quality-measures")
    judged = join_unique(measured, limits(measured), "group", measured.count(), "left")
    within = F.lit(True)
    for m in RULES:
        within &= F.coalesce(F.col(m).between(F.col(f"{m}_limit.least"), F.col(f"{m}_limit.most")), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & within)

"""Toxic passages by maximum-scoring segments.

A word is known by itself and by its beginnings of STEMS bytes, so that the inflections of a stem count
together. Each of these has log-odds between toxic and clean training texts under a Dirichlet prior
proportional to its overall frequency. Those likelier in toxic texts by a factor of least_ratio at least
keep them: smaller differences come from a text's topic or language. Chance is no yes or no: the odds are
weighed by the probability that the counts aren't those of a common word, so that few training texts give
low scores and not none. A word scores as the best of its own; all words without one share one slightly
negative score. A linear-time scan finds every maximal-scoring segment of a text. A segment's score S in a
text of n words is calibrated as an extreme value: E = K n exp(-lambda S) is the number of segments as good
that clean text yields for each toxic one, and its probability is 1 / (1 + E). A document's score is that of
its best segment: odds summed over all segments would add up the chance matches of clean texts. lambda and K
are those that make the labels of the training sample likeliest by the best segment of each text.

The training sample is bounded (labelled_rows); everything else reads all rows and whole texts. Words are
runs of letters in lower case, single characters where a script has no spaces between words, so a null or empty text has none and gets the score of texts without a
segment, as do all texts if nothing can be learned. Ties between segments go to the earlier one. Rows are
scored one by one: repeated rows repeat results, further columns are ignored or carried along.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from loreweave.llm.common import apart, as_text, keep, slices, unit_hash

#: All bytes that are no letters in ASCII become spaces.
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

#: Lengths of a word's beginnings.
STEMS = (4, 5, 6, 7)


def words_of(text: str | None) -> list[bytes]:
    return apart(text.lower()).encode("utf-8", "replace").translate(LETTERS_ONLY).split() if text else []


def units(word: bytes) -> set[bytes]:
    return {word, *(word[:n] for n in STEMS)}


@dataclass
class ToxicityModel:
    """scores: of words and beginnings that are likelier in toxic texts; rest: of any other word; decay, size: lambda and K; base: without a segment."""

    scores: dict[bytes, float] = field(default_factory=dict)
    rest: float = -0.01
    decay: float = 1.0
    size: float = 1.0
    base: float = 0.0

    def probability(self, segments: list[float], n: int) -> float:
        """That a text of n words with segments of these scores is toxic, by the best of them."""
        if not segments:
            return self.base
        return 1 / (1 + math.exp(min(700.0, math.log(self.size * max(n, 1)) - self.decay * max(segments))))


def heads_of(scores: dict[bytes, float]) -> set[bytes]:
    return {u[: STEMS[0]] for u in scores}


def maximal_segments(scores: dict[bytes, float], rest: float, words: list[bytes], heads: set[bytes]) -> list[tuple[int, int, float]]:
    """scores: above 0; rest: below 0; heads: heads_of(scores). All maximal-scoring segments (start, end, score) of a text, in order, in time linear in its words.

    A segment is maximal if no extension scores more and no proper part of it has as high a total. The
    stretches between scored words are runs of one negative score, so they are stepped over at once.
    """
    hits = [i for i, w in enumerate(words) if w[: STEMS[0]] in heads]
    starts: list[int] = []
    ends: list[int] = []
    before: list[float] = []  # total score left of the segment
    after: list[float] = []  # total score up to its end
    lower: list[int] = []  # the nearest segment to the left with a smaller total before it
    total, at = 0.0, 0
    for i in hits:
        s = max((scores[u] for u in units(words[i]) if u in scores), default=0.0)
        if not s:
            continue
        total += rest * (i - at)
        at = i + 1
        left = total
        total += s
        start = i
        while True:
            k = len(starts) - 1
            while k >= 0 and before[k] >= left:
                k = lower[k]
            if k < 0 or after[k] >= total:
                starts.append(start)
                ends.append(i + 1)
                before.append(left)
                after.append(total)
                lower.append(k)
                break
            start, left = starts[k], before[k]
            del starts[k:], ends[k:], before[k:], after[k:], lower[k:]
    return [(a, b, r - q) for a, b, q, r in zip(starts, ends, before, after, strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts of the task hold each word."""
    for batch in batches:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(as_text(batch), as_text(batch, "label"), strict=True):
            found[label].update(set().union(*map(units, set(words_of(text)))))
        for label, counter in found.items():
            values = np.fromiter(counter.values(), np.int64, len(counter))
            zero = np.zeros_like(values)
            yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(values if label else zero), pa.array(zero if label else values)], ["word", "toxic", "clean"])


def _maxima(scores: dict[bytes, float], rest: float):
    """The number of words and the score of the best segment of each text of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = heads_of(scores)
        for batch in batches:
            for part in slices(batch):
                texts = [words_of(t) for t in as_text(part)]
                best = [max((s for _, _, s in maximal_segments(scores, rest, words, heads)), default=0.0) for words in texts]
                yield pa.RecordBatch.from_arrays([*keep(part, ["label"]).values(), pa.array([len(w) for w in texts], pa.int64()), pa.array(best, pa.float64())], ["label", "n", "best"])

    return run


def fit_extreme_values(best: np.ndarray, n: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """lambda and K that make 1 / (1 + K n exp(-lambda S)) likeliest, under a weak normal prior around 1; best: S of each text's maximum."""
    if not len(best):
        return 1.0, 1.0
    x = np.stack([best, -np.ones_like(best)], axis=1)
    offset, w, prior = -np.log(np.maximum(n, 1)), np.array([1.0, 0.0]), np.array([[0.1, 0], [0, 0.01]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (toxic - p) - prior @ (w - np.array([1.0, 0.0])))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(np.exp(np.clip(w[1], -50, 50)))


def marked(toxic: np.ndarray, clean: np.ndarray, times: np.ndarray, share: float, rounds: int = 60) -> np.ndarray:
    """How likely words with these counts of toxic and clean texts are marks of toxic ones; times: words with these counts.

    Common words are in toxic texts at the share of these, marks at a share that is Beta(2, 1/2)
    distributed. How many words are marks is fitted to all counts.
    """
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    common = toxic * math.log(share) + clean * math.log(1 - share)
    mark = np.array([beta(a + 2, b + 0.5) - beta(2, 0.5) for a, b in zip(toxic.tolist(), clean.tolist(), strict=True)])
    marks, p = 0.01, np.zeros(len(times))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(math.log(marks / (1 - marks)) + mark - common, -60, 60)))
        marks = min(max(1e-6, float((p * times).sum() / times.sum())), 1 - 1e-6)
    return p


def train(documents: DataFrame, labels: DataFrame, learnable: Column, labelled_rows: int = 20_000, prior_share: float = 0.1, least_ratio: float = 4.0) -> ToxicityModel:
    """A model from labels (doc_id, toxic) of the learnable rows: about labelled_rows of them at most, half of each class."""
    known = labels.where(learnable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        return ToxicityModel()
    rate = F.when(F.col("label") == 1, min(1.0, labelled_rows / 2 / counts[1])).otherwise(min(1.0, labelled_rows / 2 / counts[0]))
    chosen = known.where(unit_hash("doc_id", seed="toxicity sample") < rate)
    # bounded by labelled_rows; equal texts count once, so that copies don't make their words significant
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    texts = texts.groupBy(F.xxhash64("text").alias("k")).agg(F.max(F.struct("label", "text")).alias("x")).select("x.text", "x.label").persist()
    try:
        words = texts.mapInArrow(_count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))
        words = words.where(F.col("y1") + F.col("y0") >= 3).persist()
        n1, n0 = (float(x or 0) for x in words.agg(F.sum("y1"), F.sum("y0")).first())
        if not n1 or not n0:
            return ToxicityModel()
        prior_total = prior_share * (n1 + n0)
        prior = prior_total * (F.col("y1") + F.col("y0")) / (n1 + n0)
        odds = lambda y, n: F.log((y + prior) / (n + prior_total - y - prior))
        scored = words.withColumn("score", odds(F.col("y1"), n1) - odds(F.col("y0"), n0))
        # the pairs of counts that occur, far fewer than words
        pairs = words.groupBy("y1", "y0").count().sort("y1", "y0").toPandas()
        pairs["p"] = marked(*(pairs[c].to_numpy(float) for c in ("y1", "y0", "count")), n1 / (n1 + n0))
        weights = documents.sparkSession.createDataFrame(pairs[["y1", "y0", "p"]], "y1 long, y0 long, p double")
        scored = scored.where(F.col("score") >= math.log(least_ratio)).join(F.broadcast(weights), ["y1", "y0"])
        # words of the bounded sample only
        significant = scored.select("word", "y1", "y0", F.log1p(F.col("p") * (F.exp("score") - 1)).alias("score")).collect()
        words.unpersist()
        scores = {bytes(r["word"]): float(r["score"]) for r in sorted(significant, key=lambda r: bytes(r["word"]))}
        y1, y0 = sum(r["y1"] for r in significant), sum(r["y0"] for r in significant)
        rest = min(-1e-3, math.log(max(n1 - y1, 1) / n1) - math.log(max(n0 - y0, 1) / n0))
        # texts of the bounded sample only
        best = texts.mapInArrow(_maxima(scores, rest), "label int, n long, best double").toPandas()
    finally:
        texts.unpersist()
    best = best.sort_values(["best", "n", "label"])
    # the sample's classes don't stand as 1 to 1 among all rows: clean ones are weighed by repeating odds in K
    hit, none = best[best["best"] > 0], best[best["best"] <= 0]
    decay, size = fit_extreme_values(hit["best"].to_numpy(), hit["n"].to_numpy(float), hit["label"].to_numpy(float))
    taken1, taken0 = min(1.0, labelled_rows / 2 / counts[1]), min(1.0, labelled_rows / 2 / counts[0])
    toxic, clean = (none["label"] == 1).sum() / taken1, (none["label"] == 0).sum() / taken0
    return ToxicityModel(scores, rest, decay, size * taken1 / taken0, float(min(0.5, (toxic + 0.5) / (toxic + clean + 1))))


PASSAGES = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("probability", pa.float64())]))


def _score(model: ToxicityModel, names: list[str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = heads_of(model.scores)
        for batch in batches:
            for part in slices(batch):
                p, found = [], []
                for text in as_text(part):
                    words = words_of(text)
                    segments = maximal_segments(model.scores, model.rest, words, heads)
                    p.append(model.probability([s for _, _, s in segments], len(words)))
                    each = [(a, b - 1, model.probability([s], len(words))) for a, b, s in segments]
                    found.append([dict(zip(("first_word", "last_word", "probability"), x, strict=True)) for x in each if x[2] >= least])
                yield pa.RecordBatch.from_arrays([*keep(part, names).values(), pa.array(p, pa.float64()), pa.array(found, PASSAGES)], [*names, "score", "passages"])

    return run


def score(documents: DataFrame, model: ToxicityModel, columns: list[str] | None = None, least: float = 0.7) -> DataFrame:
    """The given columns of documents (all by default) with score (0 to 1, higher: toxic likelier) and passages.

    passages: first and last word (from 0) and probability of each passage that is toxic at `least` by itself.
    """
    documents = documents.drop("score", "passages")
    columns = [c for c in documents.columns if columns is None or c in columns]
    schema = documents.select(columns).schema.add("score", "double").add("passages", from_arrow_type(PASSAGES))
    return documents.mapInArrow(_score(model, columns, least), schema)


def passages(documents: DataFrame, model: ToxicityModel, least: float = 0.7) -> DataFrame:
    """Every significant toxic passage: doc_id, first_word, last_word (from 0), passage_score, probability, passage (its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = heads_of(model.scores)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(as_text(part, "doc_id"), as_text(part), strict=True):
                    words = words_of(text)
                    for a, b, s in maximal_segments(model.scores, model.rest, words, heads):
                        if (p := model.probability([s], len(words))) >= least:
                            rows.append({"doc_id": doc_id, "first_word": a, "last_word": b - 1, "passage_score": s, "probability": p, "passage": b" ".join(words[a:b]).decode("utf-8", "replace")})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("passage_score", pa.float64()), ("probability", pa.float64()), ("passage", pa.string())]))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first_word long, last_word long, passage_score double, probability double, passage string")

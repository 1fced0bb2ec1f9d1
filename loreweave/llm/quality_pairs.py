"""Document quality by a Bradley-Terry model.

A pair of a good and a bad labelled text is a preference. The model gives each text a linear score of
features of its whole text and maximises the likelihood that good texts win their pairs: a logistic loss
on feature differences, minimised by Newton steps. The scores of all documents are then cut at the
quantile that corresponds to the share of bad texts among the labels.

The pairs come from a bounded sample of labelled rows (labelled_rows, pairs); the quantile is taken over
all documents. Defined results: a null or empty text has the features of no words; if one of the classes
is missing, all scores are equal; repeated rows repeat results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import apart, as_text, keep, slices, stored, unit_hash

SYMBOLS = b"#*$%&|<>"
FEATURES = 20
#: Marks that end a sentence, and those after which a word counts as closed.
SENTENCE_END = tuple(".!?。！？।؟…")
CLOSED = tuple(x.encode() for x in ".,;:!?。、，；：！？।؟")


def features(text: str | None) -> list[float]:
    """Shares and logarithms that don't grow with the text's length, but for its logarithm."""
    raw = (text or "").encode("utf-8", "replace")
    words, lines = apart(text or "").encode("utf-8", "replace").split(), [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, chars = max(len(words), 1), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    letters = int(counts[65:91].sum() + counts[97:123].sum()) or 1
    upper, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    symbols, marks, pipes = sum(int(counts[b]) for b in SYMBOLS), int(counts[33] + counts[63]), int(counts[124])
    seen = Counter(words)
    top = max(seen.values(), default=0)
    same_next = sum(a == b for a, b in zip(words, words[1:], strict=False))
    dup_lines = len(lines) - len(set(lines))
    window_dup = len(words) - 3 - len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) if len(words) > 3 else 0
    long_words = sum(len(w) > 20 for w in words)
    ended = sum(w.endswith(CLOSED) for w in words)
    logs = lambda x: math.log1p(100 * x)
    return [
        math.log1p(len(words)), math.log1p(min(len(words), 30)), logs(symbols / chars), logs(marks / n), upper / letters, logs(digits / chars),
        logs(pipes / n), logs(dup_lines / max(len(lines), 1)), logs(window_dup / n), logs(same_next / n), top / n, len(seen) / n,
        sum(map(len, words)) / n / 10, logs(long_words / n), logs(ended / n), math.log1p(n / max(len(lines), 1)),
        float(bool(lines) and lines[-1].decode("utf-8", "replace").rstrip().endswith(SENTENCE_END)), logs(counts[10] / n), symbols / n, float(len(words) < 5),
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bad_share: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight


def fit_pairs(difference: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights that maximise the mean log sigmoid(weight . difference), less ridge."""
    w = np.zeros(difference.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))  # the chance that the pair is lost
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / len(difference) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, difference.T @ p / len(difference) - ridge * w)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def _featured(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t) for t in as_text(part)], float).reshape(-1, FEATURES)
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*keep(part, names).values(), col], [*names, "features"])

    return run


def train(documents: DataFrame, labels: DataFrame, learnable: Column, labelled_rows: int = 20_000, pairs: int = 200_000, seed: int = 3) -> QualityModel | None:
    """A model from labels (doc_id, quality) of the learnable rows: about labelled_rows of them at most, half of each class."""
    known = labels.where(learnable & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        return None
    rate = F.when(F.col("label") == 1, min(1.0, labelled_rows / 2 / counts[1])).otherwise(min(1.0, labelled_rows / 2 / counts[0]))
    chosen = known.where(unit_hash("doc_id", seed="quality sample") < rate)  # bounded by labelled_rows
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    table = rows.mapInArrow(_featured(["label"]), "label int, features array<double>").distinct().toPandas()
    x, y = np.array(table["features"].tolist(), float), table["label"].to_numpy()
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, 20 * len(x))
    weight = fit_pairs(z[rng.choice(good, n)] - z[rng.choice(bad, n)])
    return QualityModel(mean, scale, weight, counts[0] / (counts[0] + counts[1]))


def score(documents: DataFrame, model: QualityModel | None, columns: list[str], cut: float = 0.3, benefit: float = 0.98) -> DataFrame:
    """The given columns of documents, raw and score (0 to 1): below cut where raw is below the quantile of bad texts.

    benefit: of the share of bad texts, what the quantile takes, so that doubtful texts are kept.
    """
    if model is None:
        return documents.select(*columns).withColumns({"raw": F.lit(0.0), "score": F.lit(0.5)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t) for t in as_text(part)], float).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([*keep(part, columns).values(), pa.array(model.raw(x), pa.float64())], [*columns, "raw"])

    raw = stored(documents.select(*columns, "text").mapInArrow(run, documents.select(*columns).schema.add("raw", "double")), "quality-raw")
    limit = raw.agg(F.percentile_approx("raw", F.lit(model.bad_share * benefit), F.lit(10_000))).first()[0] or 0.0
    shift = math.log(cut / (1 - cut))
    return raw.withColumn("score", 1 / (1 + F.exp(-(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("raw") - limit)) + shift))))

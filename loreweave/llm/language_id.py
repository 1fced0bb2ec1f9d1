"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a run of letters byte by byte in both directions and gives each byte position a
probability for every language; a document's probabilities are the mean over all its positions. It is
trained here, in numpy, by backpropagation through time.

Defined results: a text that is null or has no letter is `und` with score 0. Runs of letters longer than
WINDOW bytes are read in parts of WINDOW bytes, so a text of any length is read whole. Rows are scored one
by one: repeated rows give repeated results, an empty table an empty result, further columns are ignored.
If no row can be learned from, every text is `und`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import as_text, keep, slices, unit_hash

#: Bytes of one reading window at most.
WINDOW = 24
#: Rows of a matrix product.
ROWS = 2048
#: Windows whose probabilities a task gathers at a time, for one text at least.
GATHERED = 1 << 16
#: Distinct windows that a task remembers.
REMEMBERED = 400_000
#: All bytes that are no letters in ASCII become spaces.
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def windows(text: str) -> list[bytes]:
    """The runs of letters of a text, in lower case, cut at WINDOW bytes."""
    runs = text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split()
    if max(map(len, runs), default=0) <= WINDOW:
        return runs
    return [run[i : i + WINDOW] for run in runs for i in range(0, len(run), WINDOW)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class BiGru:
    """Two gated recurrent layers, one for each direction, and a softmax over both at every position."""

    def __init__(self, languages: list[str], hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(languages)
        self.languages, self.hidden = languages, hidden
        self.p: dict[str, np.ndarray] = {"bias": np.zeros((n, 1), np.float32)}
        for d in "fb":
            self.p[f"embed_{d}"] = rng.normal(0, 0.4, (3 * hidden, 256)).astype(np.float32)
            self.p[f"state_{d}"] = (rng.normal(size=(3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"out_{d}"] = rng.normal(0, 0.2, (n, hidden)).astype(np.float32)

    def _run(self, d: str, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """x: (steps, rows) bytes. The states after each step, (steps, hidden, rows)."""
        h_n, embed, state = self.hidden, self.p[f"embed_{d}"], self.p[f"state_{d}"]
        h = np.zeros((h_n, x.shape[1]), np.float32)
        states = np.empty((len(x), h_n, x.shape[1]), np.float32)
        for t, row in enumerate(x):
            a, u = embed.take(row, axis=1), state @ h
            gates = _sigmoid(a[: 2 * h_n] + u[: 2 * h_n])
            z, r = gates[:h_n], gates[h_n:]
            new = np.tanh(a[2 * h_n :] + r * u[2 * h_n :])
            if tape is not None:
                tape.append((row, h, z, r, new, u[2 * h_n :]))
            h = new + z * (h - new)
            states[t] = h
        return states

    def _logits(self, x: np.ndarray, tapes: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fwd = self._run("f", x, None if tapes is None else tapes.setdefault("f", []))
        bwd = self._run("b", x[::-1], None if tapes is None else tapes.setdefault("b", []))[::-1]
        return self.p["out_f"] @ fwd + self.p["out_b"] @ bwd + self.p["bias"], fwd, bwd

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def position_probabilities(self, same_length: list[bytes]) -> np.ndarray:
        """(positions, languages, rows) for windows of one length."""
        x = np.frombuffer(b"".join(same_length), np.uint8).reshape(len(same_length), -1).T
        return self._softmax(self._logits(x)[0])

    def summed(self, words: list[bytes]) -> np.ndarray:
        """For each window, the sum of its positions' probabilities: (windows, languages)."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, bounds):
            for i in range(0, len(group), ROWS):
                rows = group[i : i + ROWS]
                out[rows] = self.position_probabilities([words[k] for k in rows]).sum(axis=0).T
        return out

    def _back(self, d: str, tape: list, d_states: np.ndarray, grads: dict) -> None:
        """Backpropagation through time over one direction's steps."""
        h_n, state = self.hidden, self.p[f"state_{d}"]
        g_embed, g_state = np.zeros_like(self.p[f"embed_{d}"]), np.zeros_like(state)
        carry = np.zeros_like(d_states[0])
        for t in range(len(tape) - 1, -1, -1):
            row, h, z, r, new, u_new = tape[t]
            dh = d_states[t] + carry
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * u_new * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_new * r])
            one_hot = np.zeros((len(row), 256), np.float32)
            one_hot[np.arange(len(row)), row] = 1
            g_embed += np.concatenate([d_z, d_r, d_new]) @ one_hot
            g_state += d_u @ h.T
            carry = dh * z + state.T @ d_u
        grads[f"embed_{d}"], grads[f"state_{d}"] = g_embed, g_state

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions of x (steps, rows) with labels y (rows), and its gradients."""
        tapes: dict = {}
        logits, fwd, bwd = self._logits(x, tapes)
        p = self._softmax(logits)
        rows = np.arange(len(y))
        loss = float(-np.log(p[:, y, rows] + 1e-12).mean())
        delta = p
        delta[:, y, rows] -= 1
        delta /= np.float32(x.size)
        grads = {"bias": delta.sum(axis=(0, 2))[:, None], "out_f": np.einsum("tnb,thb->nh", delta, fwd), "out_b": np.einsum("tnb,thb->nh", delta, bwd)}
        self._back("f", tapes["f"], self.p["out_f"].T @ delta, grads)
        self._back("b", tapes["b"], (self.p["out_b"].T @ delta)[::-1], grads)
        return loss, grads

    def fit(self, words: list[bytes], labels: list[int], steps: int, rows: int = 256, rate: float = 0.01, seed: int = 11) -> BiGru:
        """Adam over batches of windows of one length each, languages drawn alike often."""
        rng = np.random.default_rng(seed)
        by_length: dict[int, dict[int, list[bytes]]] = {}
        for w, y in zip(words, labels, strict=True):
            by_length.setdefault(len(w), {}).setdefault(y, []).append(w)
        lengths = sorted(by_length)
        weight = np.array([n * sum(map(len, by_length[n].values())) for n in lengths], float)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            groups = by_length[int(rng.choice(lengths, p=weight / weight.sum()))]
            kinds = sorted(groups)
            y = rng.choice(kinds, rows)
            batch = [groups[k][rng.integers(len(groups[k]))] for k in y]
            x = np.frombuffer(b"".join(batch), np.uint8).reshape(rows, -1).T
            _, grads = self.gradients(x, y)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def _training_windows(per_document: int):
    """From each row, per_document windows spread evenly over the whole text at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(as_text(batch, "lang"), as_text(batch), strict=True):
                words = windows(text)
                picked = words if len(words) <= per_document else [words[i * len(words) // per_document] for i in range(per_document)]
                langs += [lang] * len(picked)
                found += picked
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    return run


def train(documents: DataFrame, learnable: Column, docs_per_language: int = 400, windows_per_doc: int = 40, hidden: int = 16, steps: int = 900) -> BiGru | None:
    """A network fitted to a bounded sample of the learnable rows.

    The sample holds about docs_per_language different texts of each language, chosen by a hash of text, and
    windows_per_doc windows of each row at most. None if there is nothing to learn from.
    """
    rows = documents.where(learnable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    # texts are chosen by their hash, copies together: the rate is that of different texts
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    if not counts:
        return None
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, docs_per_language / n))) for k, n in sorted(counts.items())])
    sample = rows.where(unit_hash("text", seed="language sample") < rate)
    # copies of one text all fall into the sample or none does: distinct() makes one of them
    table = sample.mapInArrow(_training_windows(windows_per_doc), "lang string, window binary").distinct()
    # the sample is bounded: one task fits it, with that task's number of threads
    fitted = table.repartition(1).mapInArrow(_fit(8 * docs_per_language * windows_per_doc, hidden, steps), "languages array<string>, name string, shape array<int>, value binary").collect()
    if not fitted:
        return None
    model = BiGru(fitted[0]["languages"], hidden)
    model.p = {r["name"]: np.frombuffer(r["value"], np.float32).reshape(r["shape"]) for r in fitted}
    return model


def _fit(most: int, hidden: int, steps: int):
    """Fits the network to (lang, window) rows, in an order that depends on their values only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, window in zip(as_text(batch, "lang"), as_text(batch, "window"), strict=True):
                by_language.setdefault(lang, []).append(bytes(window))
        languages = sorted(by_language)
        if not languages:
            return
        # beyond the bound the windows that stay are chosen by a hash, so that none of their beginnings is preferred
        rows = [(w, y) for y, k in enumerate(languages) for w in sorted(sorted(by_language[k], key=lambda w: (zlib.crc32(w), w))[:most])]
        model = BiGru(languages, hidden).fit([w for w, _ in rows], [y for _, y in rows], steps)
        names = list(model.p)
        yield pa.RecordBatch.from_arrays([pa.array([languages] * len(names)), pa.array(names), pa.array([list(model.p[k].shape) for k in names], pa.list_(pa.int32())), pa.array([np.ascontiguousarray(model.p[k], np.float32).tobytes() for k in names], pa.binary())], ["languages", "name", "shape", "value"])

    return run


def _label(model: BiGru, names: list[str]):
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        sums = np.zeros((0, len(languages)), np.float32)
        for batch in batches:
            for part in slices(batch):
                texts = as_text(part)
                flat: list[bytes] = []
                counts = np.zeros(len(texts), np.int64)
                for i, text in enumerate(texts):
                    if has_letter(text):
                        words = windows(text)
                        counts[i] = len(words)
                        flat += words
                if len(seen) > REMEMBERED:
                    seen, sums = {}, sums[:0]
                new = sorted({w for w in flat if w not in seen}, key=lambda w: (len(w), w))
                if new:
                    seen.update(zip(new, range(len(sums), len(sums) + len(new)), strict=True))
                    sums = np.concatenate([sums, model.summed(new)])
                rows = np.fromiter(map(seen.__getitem__, flat), np.int64, len(flat))
                total = np.zeros((len(texts), len(languages)), np.float64)
                read = np.flatnonzero(counts)
                ends = np.cumsum(counts[read])
                for some in np.split(np.arange(len(read)), np.flatnonzero(np.diff(ends // GATHERED)) + 1) if len(read) else []:
                    starts = ends[some] - counts[read[some]]
                    total[read[some]] = np.add.reduceat(sums[rows[starts[0] : ends[some[-1]]]].astype(np.float64), starts - starts[0])
                positions = total.sum(axis=1)
                mean = total / np.maximum(positions, 1e-9)[:, None]
                best = mean.argmax(axis=1)
                known = positions > 0
                pred = [languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                score = np.clip(np.where(known, mean[np.arange(len(best)), best], 0.0), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*keep(part, names).values(), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return run


def identify(documents: DataFrame, model: BiGru | None, columns: list[str] | None = None) -> DataFrame:
    """The given columns of documents (all by default) with lang_pred (a learned language or `und`) and score (0 to 1)."""
    documents = documents.drop("lang_pred", "score")
    columns = [c for c in documents.columns if columns is None or c in columns]
    if model is None:
        return documents.select(columns).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    schema = documents.select(columns).schema.add("lang_pred", "string").add("score", "double")
    return documents.mapInArrow(_label(model, columns), schema)


def least_score(documents: DataFrame, held_out: Column, model: BiGru, tail: float = 0.01, part: float = 0.5) -> float:
    """A score below which a text stands out from all that the network has read rightly.

    It is `part` of the score under which `tail` of the held-out rows lie whose lang the network finds, so it
    depends on how sure the network is and not on the number of languages. Scores are counted in thousandths: all
    held-out rows count, the driver gets 1,001 sums at most and reruns agree. 0 if the network finds no
    held-out row's lang.
    """
    rows = documents.where(held_out & F.col("lang").isNotNull()).select("lang", "text")
    right = identify(rows, model).where("lang_pred = lang")
    counts = sorted((r["share"], r["count"]) for r in right.groupBy(F.floor(F.col("score") * 1000).alias("share")).count().collect())
    left = tail * sum(n for _, n in counts)
    for share, n in counts:
        left -= n
        if left < 0:
            return part * share / 1000
    return 0.0

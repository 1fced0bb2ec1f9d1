import numpy as np
from pyspark.sql import functions as F

from loreweave.llm import quality_pairs as Q
from tests.llm import cases


def test_weights_are_a_minimum():
    rng = np.random.default_rng(0)
    d = rng.normal(size=(400, 3)) + [1.0, 0, -0.5]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    w = Q.fit_pairs(d)
    assert all(loss(w) <= loss(w + e) for e in 1e-3 * np.vstack([np.eye(3), -np.eye(3)]))


def _corpus(spark):
    rows = [cases.row(i, " ".join(w + "###" for w in cases.words(40, i).split()) if i % 5 == 0 else cases.words(40, i)) for i in range(300)]
    return spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(300)], "doc_id long, quality int")


def test_learns_and_cuts_at_the_quantile(spark):
    docs, labels = _corpus(spark)
    model = Q.train(docs, labels, F.col("doc_id") < 200)
    out = {r.doc_id: r.score for r in Q.score(docs, model, ["doc_id"]).collect()}
    assert all((s >= 0.3) == (i % 5 != 0) for i, s in out.items() if i >= 200)


def test_edge_cases(spark):
    docs, labels = _corpus(spark)
    model = Q.train(docs, labels, F.lit(True))
    out = Q.score(cases.frame(spark), model, ["doc_id"]).collect()
    assert len(out) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in out)
    assert Q.train(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert Q.score(cases.frame(spark), None, ["doc_id"]).count() == len(cases.ROWS)
    assert Q.score(cases.empty(spark), model, ["doc_id"]).count() == 0
    assert len(Q.features(None)) == len(Q.features("a b")) == Q.FEATURES


def test_unspaced_scripts_have_words_and_sentences():
    import numpy as np

    from loreweave.llm.quality_pairs import features

    zh = features("今天天气很好。我们去公园散步。")
    assert zh[-1] == 0.0 and zh[-4] == 1.0 and np.isclose(np.expm1(zh[0]), 15)
    assert features("今天天气很好")[-4] == 0.0


def _plain_features(text):
    """The features from their meanings, character by character and word by word."""
    import math
    import re

    text = text or ""
    size = len(text.encode())
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n, chars, per_line = len(words) or 1, size or 1, len(lines) or 1
    letters = sum(c.isascii() and c.isalpha() for c in text) or 1
    symbols = sum(c in "#*$%&|<>" for c in text)
    repeats, seen = 0, set()
    for i in range(len(words) - 3):
        gram = tuple(words[i : i + 4])
        repeats += gram in seen
        seen.add(gram)
    log = lambda share: math.log(1 + 100 * share)
    return [
        math.log(1 + len(words)), math.log(1 + min(len(words), 30)), log(symbols / chars), log((text.count("!") + text.count("?")) / n),
        sum("A" <= c <= "Z" for c in text) / letters, log(sum("0" <= c <= "9" for c in text) / chars), log(text.count("|") / n),
        log(sum(x in lines[:i] for i, x in enumerate(lines)) / per_line), log(repeats / n), log(sum(words[i] == words[i - 1] for i in range(1, len(words))) / n),
        max((words.count(w) for w in words), default=0) / n, len(set(words)) / n, sum(len(w.encode()) for w in words) / n / 10,
        log(sum(len(w.encode()) > 20 for w in words) / n), log(sum(w[-1] in ".,;:!?" for w in words) / n), math.log(1 + n / per_line),
        1.0 if lines and lines[-1].rstrip()[-1] in ".!?" else 0.0, log(text.count("\n") / n), symbols / n, 1.0 if len(words) < 5 else 0.0,
    ]


def test_query_equals_a_plain_recomputation(spark, tmp_path):
    """Features, pairs' loss, quantile and score of op1_quality again, by plain loops."""
    import math

    from loreweave.llm.queries import op1_quality

    rng = np.random.default_rng(5)
    texts = []
    for i in range(160):
        lines = [cases.words(int(rng.integers(1, 30)), 100 * i + k) + rng.choice([".", "", "!", "?", " |"]) for k in range(int(rng.integers(1, 5)))]
        if i % 4 == 0:
            lines = [x.replace(" ", " # ", 3) + " Aa 12" for x in lines] + lines[:1] * 3 + ["same same same same same same"]
        texts.append("\n".join(lines))
    texts += [None, "", " \n ", "one", "a b c d a b c d a b c d", texts[0], "x" * 50_000, "pq " * 20_000]
    rows = [cases.row(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    x = np.array([_plain_features(t) for t in texts])
    assert np.allclose(x, [Q.features(t) for t in texts])
    remainders = [r[0] for r in docs.select(F.crc32(F.col("doc_id").cast("string")) % 5).collect()]
    model = Q.train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    learned = [i for i in range(160) if remainders[i]]
    distinct = np.array(sorted({(*x[i], i % 4 != 0) for i in learned}))
    assert np.allclose(model.mean, distinct[:, :-1].mean(0)) and np.allclose(model.scale, distinct[:, :-1].std(0) + 1e-6)
    assert math.isclose(model.bad_share, sum(i % 4 == 0 for i in learned) / len(learned))
    raw = [sum(max(-8.0, min(8.0, (v - m) / s)) * w for v, m, s, w in zip(row, model.mean, model.scale, model.weight, strict=True)) for row in x]
    limit = sorted(raw)[max(0, math.ceil(model.bad_share * 0.98 * len(raw)) - 1)]
    out = {r.doc_id: r for r in op1_quality(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for i, value in enumerate(raw):
        odds = 3 / 7 * math.exp(max(-500.0, min(500.0, value - limit)))
        assert math.isclose(out[i].score, odds / (1 + odds), rel_tol=1e-6, abs_tol=1e-12), i
        assert abs(value - limit) < 1e-9 or out[i].predicted == int(value > limit)
        assert out[i].held_out == (remainders[i] == 0)

import pytest

from loreweave.llm import token_counts as K
from tests.llm import cases

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "▁a▁▁b ", "<s> </s> <unk>", "x\ny\tz", "   lead and trail   ", "日本語 の 文", "\u0000 nul", "é é", "word " * 50]


def test_counts_are_those_of_the_library(spark):
    path = tokenizers.path("piece_bpe_32k.model")
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for common in (4, 1000):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in K.count_tokens(docs, path, common).collect()}
        assert got == {i: (len(t.encode()), len(tokenizer.encode(t))) for i, t in enumerate(TEXTS)}


def test_edge_cases(spark):
    path = tokenizers.path("piece_bpe_32k.model")
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in K.count_tokens(cases.frame(spark), path).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), len(tokenizer.encode(r[1] or ""))) for r in cases.ROWS)
    assert K.count_tokens(cases.empty(spark), path).count() == 0


def test_pre_tokens():
    assert K.pre_tokens("a  b ") == ["a", " b", ""]


def test_rows_of_one_id_keep_apart(spark):
    """Texts of null ids whose 32-bit hashes are equal (found by search) are counted each by themselves."""
    from pyspark.sql import functions as F

    path = tokenizers.path("piece_bpe_32k.model")
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
    words = spark.range(300_000).select(F.concat(F.lit("w "), F.conv(F.col("id").cast("string"), 10, 36), F.repeat(F.lit(" x"), (F.col("id") % 7).cast("int"))).alias("text")).withColumn("h", F.hash("text"))
    twins = [r.texts for r in words.groupBy("h").agg(F.collect_list("text").alias("texts")).where(F.size("texts") > 1).collect()]
    texts = [t for pair in twins for t in pair] + ["same", "same"]
    assert len(texts) > 4
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, t) for t in texts], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in K.count_tokens(docs, path, 2).collect())
    assert got == sorted((i, len(t.encode()), len(tokenizer.encode(t))) for t in texts for i in ("None", "7"))


def test_hot_and_long_pre_tokens(spark):
    path = tokenizers.path("piece_bpe_32k.model")
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
    url, line = "https://example.org/" + "a/" * 400, "日本語の同じ行" * 30
    texts = [f"{url} n{k} {line} {url}" for k in range(1500)] + [url, line, url[:-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    common = K.common_pre_tokens(docs, open(path, "rb").read(), 100)
    assert {K._key(url), K._key(line)} <= set(common) and max(len(k.encode()) for k in common) <= 64
    got = {r.doc_id: r.n_tokens for r in K.count_tokens(docs, path).collect()}
    assert got == {i: len(tokenizer.encode(t)) for i, t in enumerate(texts)}


class _Spaces:
    """A tokenizer with other rules for spaces."""

    def __init__(self, change):
        self.change = change

    def encode(self, text):
        return self.change(text).replace("▁", " ").split(" ")


@pytest.mark.parametrize("change", [lambda t: " ".join(t.split()), lambda t: t.strip(), lambda t: t.replace("  ", " "), lambda t: t + " "])
def test_refuses_other_rules_for_spaces(change):
    K.check(_Spaces(lambda t: t))
    with pytest.raises(ValueError, match="spaces"):
        K.check(_Spaces(change))


def test_refuses_pieces_beyond_a_space(monkeypatch):
    class Joined:
        def __init__(self, model_proto=None):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Joined)
    with pytest.raises(ValueError, match="beyond a space"):
        K.load(b"")

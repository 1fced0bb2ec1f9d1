"""Rows that every operator over documents must take: nulls, empties, long texts, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, node long, label int, copies int, key string, raw double, n long, block int, size long, pool long"
EXTRA = (0.5, "x", 7, 1, 2, "k", 0.25, 3, 4, 5, 6)


def word(k):
    """A word of letters for each number."""
    return "".join("bcdfghklmn"[int(d)] + "aeiou"[int(d) % 5] for d in str(k))


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(word(rng.randrange(vocabulary)) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


ROWS = [
    row(1, words(40, 1)), row(1, words(40, 1)), row(2, None), row(3, ""), row(4, words(20_000, 4)), row(None, words(30, 5)), row(None, None, None, None),
    row(5, words(30, 6), None, None), row(6, " \n\t \r\x0b\x0c "), row(7, "日本語の文章 текст на русском"), row(8, "1234 5678 !!! ###"), row(9, "x" * 300_000), row(10, "one"), row(11, "one two three four"), row(12, "one two three four"),
]


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

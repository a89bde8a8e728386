"""Shared inputs of the operator tests."""

from __future__ import annotations

import random

SMALL = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n int, f int, h int, t int, label string, line string, pos int, " \
           "site string, k1 int, kept boolean, score double, token int, seg int, queue string, epoch int, tokens int, spans string"


def words(n: int, seed: int = 0, vocabulary: int = 5000) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def document(doc_id, text, source="src1", lang="en"):
    return doc_id, text, lang, source, len(text or ""), 1, 2, 3, 4, "x", "line", 5, "s", 6, True, 0.5, 7, 8, "q", 9, 10, "z"


def odd_rows() -> list[tuple]:
    """NULLs in every column, empty and very long texts, ties, repeated rows."""
    long_text = words(30_000, 3)
    near = words(300, 4).split()
    return [
        document(1, None), document(2, ""), document(3, " \n\t \r\n"), document(4, "One"), document(5, "one two three"),
        document(6, long_text, "src2"), document(7, long_text, "src3"),
        document(8, " ".join(near), "src4"), document(9, " ".join(["changed", *near[1:]]), None), document(10, " ".join([*near, "more"]), "src6", None),
        document(None, "nobody owns this text at all", "src7"), document(None, None, None, None),
        document(12, "same row"), document(12, "same row"), document(13, "é ñ ß ½ 𝟘 <|endoftext|> ok", "src8"),
        (14, "only text", None, None, None) + (None,) * 17,
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), CLASHING)


def none(spark):
    return spark.createDataFrame([], CLASHING)


def labels(spark, rows=((8, 1, 0), (9, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")

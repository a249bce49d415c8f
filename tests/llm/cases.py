"""Documents with what real tables hold: nulls, empty and very long texts, repeats, odd columns."""

from __future__ import annotations

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is it for on with as at by from or an be this that which".split()


def prose(seed: int, n: int = 60) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i) % len(WORDS)]}{(seed * 31 + i) % 97}" for i in range(n))


ROWS = [
    (1, prose(1), "en", "a", None),
    (2, None, "en", "a", None),
    (3, "", "en", "b", 0),
    (None, prose(4), None, None, None),
    (5, prose(1), "en", "b", None),
    (5, prose(1), "en", "b", None),
    (6, prose(6, 40_000), "de", "a", None),
    (7, "one", None, "a", None),
    (8, "!!! ???", "en", None, None),
    (9, "é ü\n\n  x\ty", "fr", "b", None),
    (10, "0" * 5000, "en", "a", None),
]

CLASHES = (
    "copies", "copy", "shuffle_key", "keep", "score", "evidence", "shard", "node", "bucket", "label",
    "class_id", "component", "h", "_h", "n", "s", "p", "a", "size", "start", "tie", "raw", "features",
    "query", "rank", "term", "block", "slot",
)


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, DDL)


def with_clashes(frame):
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in frame.columns])


def empty(spark):
    return spark.createDataFrame([], DDL)


def labels(spark, rows=((1, 1, 0), (3, 0, 0), (6, 1, 0), (8, 0, 0), (None, 1, 0), (7, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")

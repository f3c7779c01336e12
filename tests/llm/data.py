"""Small documents with every odd case, and helpers to make more."""

import random

from pyspark.sql import functions as F

CLASH = ["row_id", "cid", "w", "words", "text_hash", "block", "doc", "score", "n", "label", "spans", "found", "link", "order", "bands",
         "f_key", "f_hash", "f_spans", "bad_key", "bad_hash", "k_key", "k_text", "text_id", "text_id_", "row"]
SCHEMA = "doc_id long, text string"


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


LONG = prose(30_000, 99)
BASE = prose(300, 1)


def edited(text, every, seed):
    """``text`` with one word in ``every`` replaced."""
    r = random.Random(seed)
    w = text.split()
    for i in range(r.randrange(every), len(w), every):
        w[i] = f"new{seed}y{i}"
    return " ".join(w)


def odd_rows():
    return [
        (1, None), (2, ""), (3, "one"), (4, LONG), (5, BASE), (5, BASE), (6, BASE), (7, edited(BASE, 60, 3)),
        (None, prose(120, 5)), (8, "!!! ... ???"), (9, "été 中文 \U0001f600 ß"), (10, None), (11, prose(200, 6)), (12, edited(BASE, 100, 4)),
    ]


def documents(spark, rows, clash=True):
    """A table of ``rows`` with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if clash else df


def empty(spark):
    return documents(spark, [])

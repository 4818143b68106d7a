"""Small tables with the odd cases that every operator must take."""

import random

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
COLUMNS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "block", "place", "length", "row", "id")]
    + [T.StructField(n, T.StringType()) for n in ("text", "lang", "source", "word", "key")]
)


def prose(seed, n, words=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def odd_texts():
    """(doc_id, text): null, empty, blank, short, very long, repeated rows, a row without id."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "one two three four"),
        (6, prose(1, 60)),
        (6, prose(1, 60)),
        (None, prose(2, 60)),
        (7, prose(1, 60)),
        (8, prose(3, 60_000, 5000)),
        (9, "Été — 日本語 \U0001f600 straße A.\n" * 30),
        (10, "x" * 50_000),
        (-11, "No.\n" * 40),
    ]


def docs_of(spark, rows, parts=3):
    """Rows (doc_id, text[, lang]) with further columns whose names clash with inner ones."""
    full = [
        (r[0], 5, 5, 5, 5, 5, r[1], r[2] if len(r) > 2 else None, "s", "w", "k") for r in rows
    ]
    return spark.createDataFrame(full, COLUMNS).repartition(parts)

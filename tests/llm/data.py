"""Small tables with everything that can go wrong, shared by the tests of this folder."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        *[
            T.StructField(n, T.StringType())
            for n in ("row", "shard", "uid", "key", "t", "sid", "k1", "kept", "words", "n_words")
        ],
    ]
)


def words(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def edited(text, every, seed=0):
    out = text.split(" ")
    for i in range(seed % every, len(out), every):
        out[i] = f"x{i}y{seed}"
    return " ".join(out)


PASSAGE = " ".join(words("passage", 90))


def texts():
    base = " ".join(words(1, 260))
    long = " ".join(words(2, 30_000))
    return [
        (0, None),
        (1, ""),
        (2, " \t\n\x0b\f\r "),
        (3, base),
        (4, base),
        (5, edited(base, 60, 1)),
        (6, edited(base, 60, 2)),
        (7, edited(base, 9, 3)),
        (8, base.upper()),
        (9, "one two three"),
        (10, "one  two\nthree"),
        (11, "one two three four"),
        (12, " ".join(words(3, 50)) + " " + PASSAGE + " " + " ".join(words(4, 70))),
        (13, " ".join(words(5, 80)) + " " + PASSAGE),
        (14, PASSAGE + " " + " ".join(words(6, 300))),
        (15, "again and again " * 300),
        (16, "a" * 3000),
        (17, long),
        (18, long + " end"),
        (19, "Grüße, Ärger 中文 naïve — “quoted” 🙂 " * 30),
        (20, "line\nline\n\nline\nother"),
        (None, base),
        (None, None),
        (3, base),
        (21, "".join(chr(0x4E00 + i % 500) for i in range(2500))),
        (22, "".join(chr(0x4E00 + i % 500) for i in range(100, 2300))),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [
        (i, t, None if k % 7 == 3 else "en", None if k % 5 == 4 else "s", len(t or ""), *["clash"] * 10)
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

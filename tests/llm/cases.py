"""Awkward rows that every operator must take."""

from pyspark.sql import functions as F

LONG = "long words go on and on " * 3000


def rows():
    """(doc_id, text, lang, source, n_chars)"""
    base = "the quick brown fox jumps over the lazy dog while the small cat sleeps near the warm stove in the old kitchen of the house"
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 2),
        (2, base, "en", "a", 2),  # a repeated row
        (3, base.upper(), None, None, 3),
        (4, base.replace("dog", "hen"), "en", "b", None),
        (5, None, "en", "a", 5),
        (6, "", "de", "", 6),
        (7, "   \t\n ", "de", "b", 7),
        (8, "1234 5678", None, "b", 8),
        (9, "one two", "en", "c", 9),
        (10, "one two", "en", "c", 10),
        (11, LONG, "en", "c", 11),
        (12, LONG + "end", "en", "c", 12),
        (13, "ÀÉ İı ß 漢字 😀 token = abcdef123456", "de", "ü", 13),
        (14, "x" * 5000, "de", "b", 14),
        (None, base, "en", "a", 15),
        (None, "a text without a number of its own", None, "a", 16),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def clashing(df):
    """The same rows with columns that carry operators' own names."""
    for name in ("score", "kept", "keep_id", "entry", "key", "task", "length", "size", "target", "component_id", "held_out", "spans", "bucket", "id"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("toxic", F.lit(7))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 10 == 4)) for i in range(40)] + [(None, 1, 1), (3, None, None), (4, 1, 9)], "doc_id long, quality int, toxic int")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(spark):
    """(vec_id, embedding): 64 components and not, null, non-finite, repeated and tied ones."""
    x = [i / 64 - 0.5 for i in range(64)]
    rows = [(1, x), (2, x), (2, x), (2, [-c for c in x]), (3, None), (4, x[:63]), (5, [*x, 0.0]), (6, [*x[1:], None]), (7, [*x[1:], float("nan")]), (8, [*x[1:], float("-inf")]), (9, []), (None, [0.25] * 64), (10, [1e300] * 64), (11, [0.0] * 64)]
    return spark.createDataFrame(rows + [(100 + i, [((i * k) % 17 - 8) / 9 for k in range(64)]) for i in range(40)], "vec_id long, embedding array<double>")

"""Frames of awkward rows that every operator must take."""

from pyspark.sql import functions as F

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank".split()
LONG = " ".join(f"{w}{i % 997}" for i in range(6000) for w in WORDS[:4])


def passage(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * 31 + i * i * seed) % 100003}" for i in range(n))


def awkward(spark):
    """Nulls in every column, empty, blank, one-word and very long texts, repeated rows and ids."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, "b", 0), (3, " \n\t ", "en", None, 4), (4, "word", "en", "a", 4),
        (5, LONG, "en", "a", len(LONG)), (6, passage(1, 80), "fr", "b", 1), (6, passage(1, 80), "fr", "b", 1), (7, passage(1, 80) + " tail", None, None, None),
        (None, passage(2, 60), "en", "a", 9), (None, None, None, None, None), (8, passage(3, 60), "en", "c", 5), (8, passage(4, 60), "en", "c", 5),
    ]
    return spark.createDataFrame(rows, KINDS)


def cluttered(df):
    """Extra columns whose names the operators use inside, or that differ from theirs in case only."""
    for name in ("size", "src", "h", "cls", "_cls", "_id", "task", "n", "bucket", "held", "score", "part", "run", "band", "key"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], KINDS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

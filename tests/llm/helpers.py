"""Small document tables with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(7)
LEXICON = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 9))) for _ in range(800)]


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(LEXICON) for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty, blank, symbol-only and very long texts, copies, repeated rows and ids."""
    base = prose(120, 1)
    return [
        (1, None, "en", "s", 0),
        (2, "", None, None, None),
        (3, " \t\n ", "en", "s", 3),
        (4, "###", "en", "s", 3),
        (5, base, "en", "s", 1),
        (6, base, "en", "t", 1),
        (6, base, "en", "t", 1),
        (7, base.upper(), "fr", "s", 1),
        (8, " ".join(base.split()[:-1]), "en", "s", 1),
        (None, prose(60, 2), "en", "s", 1),
        (9, prose(30_000, 3), "en", "s", 1),
        (10, "x" * 50_000, "en", "s", 1),
        (11, "one two", "en", "s", 1),
        (12, "ONE  two", "en", "s", 1),
        (13, "é ü 漢字 😀 no", "de", "s", 1),
        (14, prose(40, 5) + "\n" + prose(40, 5) + "\n\n" + prose(40, 5), "en", "s", 1),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def with_clashes(df):
    """The same rows with columns whose names the operators use."""
    from pyspark.sql import functions as F

    for name in ("size", "shard", "ids", "words", "score", "lang_pred", "lang_spans", "leaks", "sid", "tokens", "part", "maybe", "bits", "word", "stays"):
        df = df.withColumn(name, F.lit("clash"))
    return df

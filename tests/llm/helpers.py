"""Documents with everything that texts can be, and plain Python versions of words."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def odd_documents():
    """``(doc_id, text, lang, source)``: null, empty, blank, short, long, copies, near copies, repeated rows."""
    long = " ".join(f"{BASE[i % 20]}{i % 97}" for i in range(6000))
    near = " ".join(BASE * 6)
    rows = [
        (1, None, "en", "b"),
        (2, "", "en", "a"),
        (3, " \t\n", "fr", None),
        (4, "one two three", "en", "a"),
        (5, "One  TWO\nthree", "fr", "a"),
        (6, near, "en", "b"),
        (7, near + " extra", "en", "b"),
        (8, near.upper(), "fr", "c"),
        (9, long, "en", "c"),
        (10, long + " tail end", "fr", None),
        (11, "123 456 !!", None, "d"),
        (12, "été à la plage avec des élèves français et naïfs", "fr", "d"),
        (13, "the quick brown fox jumps over the lazy dog", "en", "d"),
        (13, "the quick brown fox jumps over the lazy dog", "en", "d"),
        (14, "a b \x1c c\x1cd <|endoftext|> ok!", "en", "\U0001f600"),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=None):
    """The documents with further columns whose names clash with what operators add."""
    df = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
    from pyspark.sql import functions as F

    for c in ("size", "n", "id", "rank", "length", "score", "k", "words", "taken", "target", "n_words"):
        df = df.withColumn(c, F.lit(7))
    return df

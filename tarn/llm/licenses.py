"""License scans by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined to the k-grams of known texts: pairs to those
of the base phrases, five words to those of whole license texts and notices. The words themselves verify
a match. A match of text position ``p`` with template position ``o`` votes for the diagonal ``p - o``. A
diagonal on which all pairs of a phrase vote is that phrase, word for word. For license texts,
neighbouring diagonals (words put in or left out) are merged, and the span counts if the k-grams that
voted cover enough of the template's words.

Defined results for odd input: a null text is empty; an empty text has no words, no labels and score 0;
repeated rows get the same result each, and rows may share a doc_id or have none; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .license_texts import TEXTS

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words. Java finds them by the classes that are in at a fraction of the time that the negated class takes.
_WORD, _REST = r"[0-9a-z\x80-\x{10FFFF}]++", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*+"

# The phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Words of a part that a text is cut into, so that no array holds all words of a long text.
PART = 256
#: Words of a k-gram: of phrases, and of license texts.
SHORT, LONG = 2, 5
#: Diagonals this near are one alignment; this part of a template's words must be covered by its votes.
SLACK, COVERAGE = 3, 0.7


def grams_of(texts: dict[str, str], k: int) -> list[tuple[list[str], str, int, int]]:
    """``gram, label, offset, words`` of every k-gram of every text."""
    out = []
    for label, text in texts.items():
        words = re.findall(WORDS, text.lower())
        out += [(words[i : i + k], label, i, len(words)) for i in range(len(words) - k + 1)]
    return out


def templates(spark: SparkSession, texts: dict[str, str], k: int, base: bool) -> DataFrame:
    """``h, at``: a row per distinct hash of the k-grams of the fixed texts, with the places where they stand."""
    rows = spark.createDataFrame(grams_of(texts, k), "gram array<string>, label string, offset int, words int")
    place = F.struct("label", F.lit(base).alias("base"), "offset", "words", "gram")
    return rows.groupBy(F.xxhash64(*(F.get("gram", F.lit(i)) for i in range(k))).alias("h")).agg(F.collect_list(place).alias("at"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def lowered(text: Column) -> Column:
    """A-Z lower-cased, and no other letter; ``lower`` does just that where all is ASCII, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def parts_of(text: Column) -> Column:
    """The text, A-Z lower-cased, in parts of PART words each."""
    return F.regexp_extract_all(lowered(F.coalesce(text.cast("string"), F.lit(""))), F.lit(f"(?:{_WORD}{_REST}){{1,{PART}}}+"), F.lit(0))


def rolled_words(docs: DataFrame) -> DataFrame:
    """``doc_id, row, part, words, at``: a row per word, its place in its part and the part's words, which end with the first ones of the next part; one row without a place for a text without words."""
    parts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), parts_of(F.col("text")).alias("parts"))
    # The last k-grams of a part reach into the next one. All that is taken from the array of parts is in the explode
    # itself, or each part's row would carry the array.
    ahead = f"^(?:{_WORD}{_REST}){{1,{LONG - 1}}}+"
    next_words = lambda i: F.regexp_extract(F.coalesce(F.get("parts", i + 1), F.lit("")), ahead, 0)
    ends = F.transform("parts", lambda p, i: F.concat(p, next_words(i)))
    one = parts.select("doc_id", "row", F.posexplode_outer(ends).alias("part", "p"))
    one = one.select("doc_id", "row", "part", words_of(F.coalesce("p", F.lit(""))).alias("words"))
    # Within generated code the rows of a part share its array of words; a function with a lambda here would copy it to each.
    out = one.select("doc_id", "row", "part", "words", F.posexplode_outer("words").alias("at", "word"))
    return out.filter(F.coalesce("at", F.lit(0)) < PART).drop("word")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every document."""
    spark = docs.sparkSession
    # What is joined is of a fixed size: the k-grams of the texts above.
    short = templates(spark, {v: k for k, v in PHRASES.items()}, SHORT, True).select(F.col("h").alias("h2"), F.col("at").alias("at2"))
    long = templates(spark, TEXTS, LONG, False).select(F.col("h").alias("h5"), F.col("at").alias("at5"))
    # Of single elements: a slice would copy words. Beyond the text's end there are nulls, which equal no word.
    gram = [F.get("words", F.col("at") + k) for k in range(LONG)]
    rolled = rolled_words(docs)
    rolled = rolled.select("*", F.xxhash64(*gram[:SHORT]).alias("h2"), F.xxhash64(*gram).alias("h5"))
    # On the hashes alone, so that the keys are single numbers; the words of what they find are compared below.
    met = rolled.join(F.broadcast(short), "h2", "left").join(F.broadcast(long), "h5", "left")
    none = F.array().cast(short.schema["at2"].dataType)
    votes = F.concat(F.coalesce("at2", none), F.coalesce("at5", none))
    # Each part keeps its first row, with its number of words; other rows stay if they matched.
    first, hit = F.coalesce("at", F.lit(0)) == 0, F.col("at2").isNotNull() | F.col("at5").isNotNull()
    met = met.filter(first | hit)
    n_words = F.when(first, F.least(F.size("words"), F.lit(PART))).cast("long").alias("n_words")
    pos = (F.col("part") * PART + F.col("at")).alias("pos")
    seen = stage(met.select("doc_id", "row", n_words, pos, F.when(hit, F.array(*gram)).alias("own"), votes.alias("votes")), "license_hits")
    votes = seen.select("row", "pos", "own", F.inline("votes")).filter(F.slice("own", 1, F.size("gram")) == F.col("gram")).withColumn("diagonal", F.col("pos") - F.col("offset"))

    # Phrases: all pairs of one diagonal.
    exact = votes.filter("base").groupBy("row", "label", "words", "diagonal").agg(F.count("*").alias("votes")).filter(F.col("votes") == F.col("words") - SHORT + 1)
    exact = exact.select("row", "label", F.lit(True).alias("base"), F.col("diagonal").cast("long").alias("start"), F.lit(1.0).alias("coverage"))
    # License texts: neighbouring diagonals together.
    diagonals = votes.filter("not base").groupBy("row", "label", "words", "diagonal").agg(F.collect_set("offset").alias("offsets"))
    along = Window.partitionBy("row", "label").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > SLACK).cast("int"), F.lit(0))
    runs = diagonals.withColumn("run", apart).withColumn("run", F.sum("run").over(along)).groupBy("row", "label", "words", "run")
    # A set of offsets is no larger than the template.
    runs = runs.agg(F.array_distinct(F.flatten(F.collect_set("offsets"))).alias("offsets"), F.min("diagonal").alias("diagonal"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("offsets", lambda o: F.sequence(o, o + LONG - 1)))))
    near = runs.withColumn("coverage", covered / F.col("words")).filter(F.col("coverage") >= COVERAGE)
    near = near.select("row", "label", F.lit(False).alias("base"), F.col("diagonal").cast("long").alias("start"), "coverage")

    base = F.col("base")
    labels = (
        exact.unionByName(near)
        .groupBy("row")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.max("coverage").alias("score"),
        )
    )
    rows = seen.filter("n_words is not null").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"))
    return rows.join(labels, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

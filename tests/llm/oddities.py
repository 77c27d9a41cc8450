"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over a lazy dog while rain falls on old stone walls\n" * 3000
TEXTS = [
    (1, "A plain text with more than ten words that stands for an ordinary document here.", "en", "a"),
    (2, "Ein kurzer Text, der auf Deutsch steht und mehr als zehn Worte in sich trägt.", "de", "a"),
    (3, None, "en", "a"), (4, "", "de", None), (5, " \n\t ", None, "b"), (6, LONG, "en", "b"), (7, "12345 !!! ...", "en", "b"),
    (8, "Repeated row with a few words", "en", "c"), (8, "Repeated row with a few words", "en", "c"), (None, "No id but a text", "en", None),
    (9, "Repeated row with a few words", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("n_chars", "key", "window", "shard", "slot", "fp", "block", "pos", "u1", "size", "tokens", "copies", "component_id", "score", "part")


def odd(spark):
    rows = spark.createDataFrame(TEXTS, SCHEMA)
    return rows.select("*", *(F.lit(i).cast("long").alias(n) for i, n in enumerate(CLASHES)))


def empty(spark):
    return odd(spark).limit(0)

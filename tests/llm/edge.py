"""Documents that every operator must take: nulls, empty and long texts, repeats, clashing column names."""

import re

from pyspark.sql import types as T

LONG = "alpha beta gamma delta épsilon " * 9_000
ROWS = [
    (1, None, None, None, None, 1, "x"),
    (2, "", "en", "s1", 0, 2, "x"),
    (3, " \n\t ", "en", "s1", 4, 3, "x"),
    (4, "one two three", "en", "s2", 13, 4, None),
    (4, "one two three", "en", "s2", 13, 4, None),
    (None, "no id here at all, but words enough", "en", "s3", 35, 5, "x"),
    (5, LONG, "en", "s4", len(LONG), 6, "x"),
    (6, "日本語 текст 😀 ñandú", "es", "s5", 15, 7, "x"),
]
# extra columns with the names of working columns
EXTRA = ["n_words", "_spans", "line", "k1", "class", "score", "_row", "n"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in EXTRA]])


def edge_docs(spark):
    return spark.createDataFrame([r[:5] + (r[5],) * len(EXTRA) for r in ROWS], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))

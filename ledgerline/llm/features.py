"""Hashed sparse text features and the labelled sample that models are fitted on.

``gram_features``: indicators of n-grams of bytes, which see words, case and punctuation alike, and of n-grams
that repeat one word. ``word_features``: words and frequent stems. Both hash to ``1 << BITS`` buckets.
"""

from __future__ import annotations

from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD_BYTES

BITS = 18
GRAM = 4
REPEATS = 16        # buckets for repeated words, behind the hashed ones
BUCKETS = (1 << BITS) + REPEATS
STEM = 6
STEM_SHARE = 120
FOLDS = 5           # rows whose crc32(doc_id) is 0 modulo this are held out
SAMPLE_ROWS = 12_000  # bounds of the labelled sample that a model is fitted on: documents,
SAMPLE_CHARS = 1 << 26  # and characters in all

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)  # odd, of mixed bits


def gram_features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of the text's byte n-grams. ``seen``: a false mask of 1 << BITS, left false."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    repeats = repeat_features(text)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h += raw[k:k + n] * _MULTIPLIERS[k]
    h ^= h >> np.uint32(15)
    h *= _MULTIPLIERS[0]
    h >>= np.uint32(32 - BITS)
    if n < 20_000:
        h.sort()
        return np.concatenate([h[np.concatenate([[True], h[1:] != h[:-1]])].astype(np.int64), repeats])
    seen[h] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return np.concatenate([out, repeats])


def word_features(text: bytes) -> np.ndarray:
    """Buckets of the text's words (repeats kept), then of stems that make up a share of its words.

    A stem is a word's first STEM bytes; it counts if at least one word in STEM_SHARE has it, so that it is
    as telling in long texts as in short ones.
    """
    words = text.translate(WORD_BYTES).split()
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    stem, n = np.unique(np.fromiter(map(crc32, [w[:STEM] for w in words]), np.uint32, len(words)), return_counts=True)
    stem = stem[n * STEM_SHARE >= len(words)]
    return (np.concatenate([h * _MULTIPLIERS[2], (stem ^ _MULTIPLIERS[0]) * _MULTIPLIERS[1]])
            >> np.uint32(32 - BITS)).astype(np.int64)


def repeat_features(text: bytes) -> np.ndarray:
    """Buckets behind the hashed ones: n-grams of one word over and over, for n from 2 up to the longest run."""
    words = text.split()
    same = np.fromiter(map(eq, words, words[1:]), np.int8, max(len(words) - 1, 0))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
    longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    return (1 << BITS) + np.arange(min(longest, REPEATS))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS,
                    chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents outside the held-out fold, with at most ``chars`` characters in all.

    Ids are taken in the order of their hash; an id with several labels takes the smallest, one with several texts the
    one with the smallest hash. Everything broadcast or ordered here has at most ``rows`` rows.
    """
    at = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.min("y").alias("y"))
             .orderBy(*at).limit(rows))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("key", F.xxhash64("text"))
    sizes = (text.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y")
             .agg(F.min(F.struct("key", F.length("text").alias("n"))).alias("t")).select("doc_id", "y", "t.*"))
    upto = F.sum("n").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))
    taken = sizes.withColumn("upto", upto).filter(F.col("upto") <= chars).select("doc_id", "y", "key")
    return (text.join(F.broadcast(taken), ["doc_id", "key"]).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
            .select("text", "y"))

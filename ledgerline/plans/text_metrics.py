"""Numbers in free text and numeric answer accuracy (H1, H2).

Whole texts are scanned with the JVM regex engine (``regexp_extract_all``);
the per-expected-number check is a higher-order ``exists`` over the response's
number set inside the row, so there is no Python, no shuffle and no pairing of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import dround
from ledgerline.functions.text import NUMBER_IN_TEXT, extract_numbers

# Fixed values of the accuracy score.
LARGE = 100.0
TOL_LARGE, TOL_SMALL = 0.02, 0.005
EPS = 1e-9


def numbers_in_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """H1: one row per (document, distinct number found in its text)."""
    return docs.select(key, F.explode(extract_numbers(F.col(text))).alias("number"))


def expected_numbers(text_col) -> "F.Column":
    """Nonzero numbers of a text as a list (repeats kept: each one must be found)."""
    raw = F.regexp_extract_all(text_col, F.lit(NUMBER_IN_TEXT), 1)
    nums = F.transform(raw, lambda m: F.regexp_replace(m, ",", "").try_cast("double"))
    return F.filter(nums, lambda x: x.isNotNull() & (x != 0))


def numeric_accuracy(cases: DataFrame, keys: list[str], expected_text: str, response_text: str) -> DataFrame:
    """H2: share of expected numbers found in the response within 2 % (|x| >= 100) or 0.5 %.

    Null when nothing is expected; rounded to 2 places.
    """
    resp = extract_numbers(F.col(response_text))
    exp = expected_numbers(F.col(expected_text))

    def hit(e):
        tol = F.when(F.abs(e) >= LARGE, F.lit(TOL_LARGE)).otherwise(F.lit(TOL_SMALL))
        return F.exists(resp, lambda r: F.abs(r - e) / F.greatest(F.abs(e), F.lit(EPS)) <= tol)
    n = F.size(exp)
    found = F.size(F.filter(exp, hit))
    # row-local array expressions: no explode, no shuffle
    return cases.select(*keys, n.cast("bigint").alias("expected"), found.cast("bigint").alias("found"),
                        dround(F.when(n > 0, found / n), 2).alias("accuracy"))


def answer_pairs(conv: DataFrame) -> DataFrame:
    """Each assistant turn with the turn right before it (the question it answers).

    An equi-join on (conversation, turn) rather than a window per
    conversation, so one very long conversation still spreads over tasks.
    """
    a = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    q = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return a.join(q, ["conv_id", "turn"]).select("conv_id", "turn", "question", "answer")

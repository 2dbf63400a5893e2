"""Column expressions for broker text: numbers, transaction classes, fund names,
slugs and numbers inside free text (A5-A8, A12, H1).

All are built-in Spark expressions (regex, ``when`` chains, higher-order
array functions), so they run inside whole-stage codegen with no Python
round-trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the broker reference conventions, in rule order (first match wins).
# (rule, pattern or literal, type, subtype)
REFERENCE_RULES = [
    ("regex", r"^BX\d", "SWITCH_IN", "Fund class switch"),
    ("regex", r"^X\d", "SWITCH_OUT", "Fund class switch"),
    ("regex", r"^B\d", "BUY", None),
    ("regex", r"^S\d", "SELL", None),
    ("regular_saver", "REG. SAVER", None, None),   # CONTRIBUTION/Regular if value >= 0 else REJECTED
    ("in", ("Card Web", "FPC"), "CONTRIBUTION", "One-off"),
    ("in", ("MANAGE FEE",), "FEE", "Management fee"),
    ("in", ("INTEREST",), "INTEREST", None),
    ("in", ("Transfer", "BACS"), "TRANSFER", "Transfer in"),
    ("upper_prefix", "URIB", "REBATE", "Unit rebate"),
]
REGULAR_SAVER = ("CONTRIBUTION", "Regular", "REJECTED", "Regular saver rejected")
OTHER_TYPE = "OTHER"
NOT_AVAILABLE = "n/a"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
FUND_NAME_PATTERN = r"^(.+?)\s*\(GBP\)"
SLUG_MAX = 40
NUMBER_IN_TEXT = r"£?([\d,]+(?:\.\d+)?)\s*%?"


def parse_number(c: Column) -> Column:
    """Strip spaces, quotes and thousands separators; decimal numbers to double, all else (blank, 'n/a', bad) to null."""
    # quote stripping and comma removal are character operations, not regexes
    s = F.translate(F.btrim(F.trim(c), F.lit('"')), ",", "")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def classify_transaction(reference: Column, value: Column) -> Column:
    """(reference, value) -> struct(transaction_type, transaction_subtype) by ordered rules."""
    ref = F.trim(reference)
    ttype = subtype = None

    def add(cond, t, st):
        nonlocal ttype, subtype
        tcol, scol = F.lit(t) if not isinstance(t, Column) else t, F.lit(st).cast("string") \
            if not isinstance(st, Column) else st
        ttype = F.when(cond, tcol) if ttype is None else ttype.when(cond, tcol)
        subtype = F.when(cond, scol) if subtype is None else subtype.when(cond, scol)

    for kind, pat, t, st in REFERENCE_RULES:
        if kind == "regex":
            add(ref.rlike(pat), t, st)
        elif kind == "in":
            add(ref.isin(*pat), t, st)
        elif kind == "upper_prefix":
            add(F.upper(ref).startswith(pat), t, st)
        else:
            ok = value >= 0
            add(ref == pat, F.when(ok, REGULAR_SAVER[0]).otherwise(REGULAR_SAVER[2]),
                F.when(ok, REGULAR_SAVER[1]).otherwise(REGULAR_SAVER[3]))
    return F.struct(ttype.otherwise(OTHER_TYPE).alias("transaction_type"),
                    subtype.otherwise(F.lit(None).cast("string")).alias("transaction_subtype"))


def extract_fund_name(description: Column) -> Column:
    """Text before '(GBP)' in a trade description, trimmed; null if absent."""
    return F.nullif(F.trim(F.regexp_extract(description, FUND_NAME_PATTERN, 1)), F.lit(""))


def normalise_name(name: Column) -> Column:
    """Lower case, whitespace runs collapsed to one space, trimmed: the fund lookup key."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def slug(name: Column, max_len: int = SLUG_MAX) -> Column:
    """Runs of non [a-z0-9] -> '_', outer underscores stripped, then cut to ``max_len``."""
    s = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(s, r"^_+|_+$", ""), 1, max_len)


def extract_numbers(text: Column) -> Column:
    """H1: distinct numbers in free text (optional £ prefix, % suffix, thousands commas)."""
    raw = F.regexp_extract_all(text, F.lit(NUMBER_IN_TEXT), 1)
    nums = F.transform(raw, lambda m: F.regexp_replace(m, ",", "").try_cast("double"))
    return F.array_distinct(F.filter(nums, lambda x: x.isNotNull()))

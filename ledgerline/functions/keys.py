"""Surrogate and content-hash keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the surrogate-key recipe: md5 over the stringified columns,
# nulls replaced by this placeholder, joined with '-'.
NULL_PLACEHOLDER = "_dbt_utils_surrogate_key_null_"
KEY_SEPARATOR = "-"
ID_SEPARATOR = "|"


def surrogate_key(*cols: Column | str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                        F.lit(NULL_PLACEHOLDER)) for c in cols]
    return F.md5(F.concat_ws(KEY_SEPARATOR, *parts))


def plain_number(c: Column) -> Column:
    """A double as text with the fewest digits that give it back, at least one after the point.

    Whole pence are the common case. Any other value is rendered from the shortest scientific form that
    reads back as the same double: positional from 1e-4 up to 1e16, else with an exponent of two digits or more.
    """
    pence = c.cast("decimal(18,2)")
    short = F.regexp_replace(pence.cast("string"), r"(\.\d)0$", "$1")

    def rendered(sci: Column) -> Column:
        sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
        digits = F.regexp_replace(F.regexp_extract(sci, r"^-?([0-9.]+)e", 1), r"\.", "")
        power = F.regexp_extract(sci, r"e([+-][0-9]+)$", 1).cast("int")
        whole = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
        rest = F.substr(whole, power + 2)
        large = F.concat(sign, F.substr(whole, F.lit(1), power + 1), F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        return F.when((power >= 16) | (power < -4), sci).when(power >= 0, large).otherwise(small)

    # array functions keep the rendering out of generated code, where its many branches would not fit
    forms = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda n: F.call_function(
        "format_string", F.concat(F.lit("%."), n.cast("string"), F.lit("e")), c))
    shortest = F.slice(F.filter(forms, lambda f: f.cast("double") == c), 1, 1)
    other = F.element_at(F.transform(shortest, rendered), 1)
    return F.when((F.abs(c) < 1e15) & (pence.cast("double") == c), short).otherwise(other)


def transaction_id(account: Column, trade_date: Column, reference: Column, value: Column) -> Column:
    """md5 of ``account|yyyy-mm-dd|reference|value`` (a missing reference is empty): re-ingesting a row gives the same id."""
    return F.md5(F.concat_ws(ID_SEPARATOR, account, F.date_format(trade_date, "yyyy-MM-dd"),
                             F.coalesce(reference, F.lit("")), plain_number(value)))

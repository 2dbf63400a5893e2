"""Broker text parsing, classification, ids and numbers in text."""

import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from ledgerline.functions.dates import financial_year, parse_uk_date
from ledgerline.functions.keys import transaction_id
from ledgerline.functions.text import classify_transaction, extract_fund_name, extract_numbers, parse_number, slug
from ledgerline.plans.text_metrics import numeric_accuracy


def _one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_parse_number(spark):
    got = _one(spark, parse_number(F.col("s")), "s string",
               [("n/a",), ("",), ('"-1,050.00"',), ("  12.5 ",), (None,), ("N/A",), ("abc",)])
    assert got == [None, None, -1050.0, 12.5, None, None, None]


def test_parse_uk_date(spark):
    got = _one(spark, parse_uk_date(F.col("s")), "s string", [("31/03/2024",), ("",), ("2024-03-31",)])
    assert got == [dt.date(2024, 3, 31), None, None]


def test_classification_rules(spark):
    cases = [("BX123", -1.0, "SWITCH_IN", "Fund class switch"), ("X9", 1.0, "SWITCH_OUT", "Fund class switch"),
             ("B12", -1.0, "BUY", None), ("S7", 1.0, "SELL", None), ("REG. SAVER", 100.0, "CONTRIBUTION", "Regular"),
             ("REG. SAVER", -100.0, "REJECTED", "Regular saver rejected"), ("Card Web", 5.0, "CONTRIBUTION", "One-off"),
             ("FPC", 5.0, "CONTRIBUTION", "One-off"), ("MANAGE FEE", -3.0, "FEE", "Management fee"),
             ("INTEREST", 1.0, "INTEREST", None), ("BACS", 10.0, "TRANSFER", "Transfer in"),
             ("urib77", 1.0, "REBATE", "Unit rebate"), ("BXA", 1.0, "OTHER", None), (" B1 ", -1.0, "BUY", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "ref string, v double")
    got = df.select(classify_transaction(F.col("ref"), F.col("v")).alias("c")).select("c.*").collect()
    assert [(r.transaction_type, r.transaction_subtype) for r in got] == [(c[2], c[3]) for c in cases]


def test_fund_name_and_slug(spark):
    got = _one(spark, extract_fund_name(F.col("s")), "s string",
               [("Fund Alpha (GBP) 22.481 @  222.410000",), ("Cash movement",), ("  Beta Acc  (GBP)",)])
    assert got == ["Fund Alpha", None, "Beta Acc"]
    long = "  The  Very Long Name & Co. Global Equity Income Fund Accumulation (Acc)  "
    got = _one(spark, slug(F.col("s")), "s string", [(long,)])
    assert got == [re.sub(r"[^a-z0-9]+", "_", long.lower()).strip("_")[:40]]


def test_transaction_id_matches_python_rendering(spark):
    rows = [("ISA", dt.date(2024, 1, 2), "B123", -100.0), ("SIPP", dt.date(2024, 3, 31), "FPC", 12345678.9),
            ("ISA", dt.date(2024, 1, 2), "INTEREST", 0.07), ("ISA", dt.date(2024, 1, 2), "X1", 1050.5)]
    df = spark.createDataFrame(rows, "a string, d date, r string, v double")
    got = [x[0] for x in df.select(transaction_id(F.col("a"), F.col("d"), F.col("r"), F.col("v"))).collect()]
    want = [hashlib.md5(f"{a}|{d}|{r}|{v}".encode()).hexdigest() for a, d, r, v in rows]
    assert got == want


def test_financial_year_boundary(spark):
    got = _one(spark, financial_year(F.col("d")), "d date", [(dt.date(2024, 3, 31),), (dt.date(2024, 4, 1),)])
    assert got == ["FY24", "FY25"]


PY_PATTERN = r"£?([\d,]+(?:\.\d+)?)\s*%?"


def _py_numbers(text):
    out = set()
    for m in re.findall(PY_PATTERN, text):
        try:
            out.add(float(m.replace(",", "")))
        except ValueError:
            pass
    return out


def test_extract_numbers_against_python(spark):
    texts = ["Total £1,234.56 and 12% growth, 7 items, 7 again, ,,, 3.", "none here", "1,000,000 vs 0.5%"]
    got = _one(spark, extract_numbers(F.col("t")), "t string", [(t,) for t in texts])
    assert [set(g) for g in got] == [_py_numbers(t) for t in texts]


def test_numeric_accuracy_tolerances(spark):
    cases = spark.createDataFrame(
        [(1, "expected 1000 and 5.0 and 0", "we saw 1015 and 5.02"),       # 1000 within 2 %, 5.0 within 0.5 %
         (2, "expected 200 and 10", "got 205 and 10.1"),                    # 205 > 2 %, 10.1 > 0.5 %
         (3, "nothing", "whatever 1")],
        "id int, q string, a string")
    got = {r.id: r.accuracy for r in numeric_accuracy(cases, ["id"], "q", "a").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None}

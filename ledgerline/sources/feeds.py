"""Fund reference CSV, landed price payloads, fetch planning and eval result files
(A12, A17, A18, A19, A22).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import slug
from ledgerline.sources.writers import scratch_path

# Fixed values of the fund reference file and the price feed.
FUND_REF_COLUMNS = ["fund_ISIN", "fund_code", "fund_name", "short_name"]
PLACEHOLDER_ISIN = "??"
NOT_A_FUND = "Not a fund"
NO_ISIN = "No_ISIN"
DEFAULT_FETCH_START = "2017-01-01"
PRICE_DIGITS = 6
MILLIS_A_DAY = 86_400_000
EVAL_FIELDS = ["test_case_id", "difficulty", "latency_s", "tool_call_count", "input_tokens", "output_tokens",
               "quality_score", "accuracy_judge_score"]


# ------------------------------------------------------------------- A12
def read_fund_reference(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FUND_REF_COLUMNS])
    # UTF-8 with an optional byte-order mark on the header line
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def clean_fund_reference(ref: DataFrame) -> DataFrame:
    """Drop placeholders; ISIN blank/'No_ISIN' -> null; id = ISIN else slug(name)[:40]."""
    isin = F.trim("fund_ISIN")
    name = F.trim("fund_name")
    keep = (name.isNotNull() & (name != "") & (F.coalesce(isin, F.lit("")) != PLACEHOLDER_ISIN)
            & (name != NOT_A_FUND))
    isin_value = F.when(F.coalesce(isin, F.lit("")).isin("", NO_ISIN), F.lit(None).cast("string")).otherwise(isin)
    return ref.filter(keep).select(
        F.coalesce(isin_value, slug(name)).alias("id"), name.alias("name"), isin_value.alias("isin"),
        F.nullif(F.trim("fund_code"), F.lit("")).alias("morningstar_code"),
        F.nullif(F.trim("short_name"), F.lit("")).alias("short_name"))


# ------------------------------------------------------------------- A17
def normalise_price_payload(payloads: DataFrame, key: str = "fund_id", text: str = "payload") -> DataFrame:
    """JSON ``[[epoch_ms, price_gbp], ...]`` -> (key, date UTC, price_pence = round(gbp*100, 6)).

    Entries that are not a 2-number pair are dropped one by one; a payload
    that is not a list yields nothing.
    """
    entries = F.from_json(F.col(text), "array<string>")
    rows = payloads.select(key, F.explode(entries).alias("_e"))
    pair = F.from_json(F.col("_e"), "array<double>")
    rows = rows.select(key, pair.alias("_p")).filter(
        F.col("_p").isNotNull() & (F.size("_p") >= 2)
        & F.element_at("_p", 1).isNotNull() & F.element_at("_p", 2).isNotNull())
    # the UTC day, whatever the session's time zone
    day = F.floor(F.element_at("_p", 1) / MILLIS_A_DAY).cast("int")
    return rows.select(key, F.date_add(F.lit("1970-01-01").cast("date"), day).alias("date"),
                       F.round(F.element_at("_p", 2) * 100, PRICE_DIGITS).alias("price_pence"))


def price_payloads_from(prices: DataFrame) -> DataFrame:
    """Landed feed stand-in: one JSON payload per (fund, year) from source-shaped prices.

    Each payload holds at most one year of daily points, so no group grows
    with the data beyond the calendar.
    """
    ms = (F.datediff("date", F.lit("1970-01-01").cast("date")) * F.lit(float(MILLIS_A_DAY)))
    return (prices.groupBy("fund_id", F.year("date").alias("year"))
            .agg(F.to_json(F.collect_list(F.array(ms, F.col("price_pence") / F.lit(100.0)))).alias("payload")))


# ------------------------------------------------------------------- A18 / A19
def fetch_universe(dim_fund: DataFrame, holding_only: bool = False) -> DataFrame:
    u = dim_fund.filter(F.col("morningstar_code").isNotNull())
    if holding_only:
        u = u.filter(F.col("investment_status_indicator") == "Holding")
    return u.select("fund_id", "morningstar_code")


def missing_code_report(dim_fund: DataFrame, holding_only: bool = False) -> DataFrame:
    """Funds whose prices cannot be fetched, in the same scope as :func:`fetch_universe`."""
    missing = dim_fund.filter(F.col("morningstar_code").isNull())
    if holding_only:
        missing = missing.filter(F.col("investment_status_indicator") == "Holding")
    return missing.select("fund_id", "fund_name", "investment_status_indicator")


def index_high_water_mark(indices: DataFrame, levels: DataFrame, as_of: str, backfill_from: str | None = None) -> DataFrame:
    """Per index: start = backfill, else last level + 1 day, else the default; skip if >= as_of."""
    last = levels.groupBy("index_id").agg(F.max("date").alias("_last"))
    start = F.coalesce(F.lit(backfill_from).cast("date"), F.date_add("_last", 1), F.lit(DEFAULT_FETCH_START).cast("date"))
    return (indices.join(last, "index_id", "left").select("index_id", "ticker", start.alias("fetch_start"))
            .filter(F.col("fetch_start") < F.lit(as_of).cast("date")))


def land_by_fund(prices: DataFrame, root: str) -> str:
    """Prices in a folder per fund, so that a fund's last day stands in its files' footers."""
    prices.repartition("fund_id").sortWithinPartitions("fund_id", "date").write.mode("overwrite").partitionBy("fund_id").parquet(root)
    return root


def last_days(spark: SparkSession, root: str) -> DataFrame:
    """(fund_id, _last) of prices landed by fund, from the files' footers: the maximum is pushed into the scan, which reads no
    rows. The two settings hold while the small result is written; it is read back."""
    conf = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    old = {k: spark.conf.get(k) for k in conf}
    path = scratch_path(spark, "last-days")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        last_day_query(spark, root).write.parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return spark.read.parquet(path)


def last_day_query(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).groupBy("fund_id").agg(F.max("date").alias("_last"))


def fetch_high_water_mark(universe: DataFrame, prices: DataFrame, transactions: DataFrame, as_of: str,
                          backfill_from: str | None = None, last: DataFrame | None = None) -> DataFrame:
    """Per fund: start = backfill, else last price + 1 day, else first trade, else the default; skip if >= as_of.

    ``last``: the funds' last price days if they are known already (:func:`last_days`); else ``prices`` is read.
    """
    if last is None:
        last = prices.groupBy("fund_id").agg(F.max("date").alias("_last"))
    first = (transactions.filter(F.col("fund_id").isNotNull())
             .groupBy("fund_id").agg(F.min("trade_date").alias("_first")))
    start: Column = F.coalesce(F.lit(backfill_from).cast("date"), F.date_add("_last", 1), F.col("_first"),
                               F.lit(DEFAULT_FETCH_START).cast("date"))
    return (universe.join(last, "fund_id", "left").join(first, "fund_id", "left")
            .select("fund_id", "morningstar_code", start.alias("fetch_start"))
            .filter(F.col("fetch_start") < F.lit(as_of).cast("date")))


# ------------------------------------------------------------------- A22
def flatten_eval_results(spark: SparkSession, path: str, name: str = "file") -> DataFrame:
    """JSON files each holding an array of result objects -> one row per case with its file name.

    ``name='folder'`` reports the file's folder instead (for writers that pick file names themselves).
    """
    fields = [T.StructField("test_case_id", T.StringType()), T.StructField("difficulty", T.StringType()),
              T.StructField("latency_s", T.DoubleType()), T.StructField("tool_call_count", T.LongType()),
              T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
              T.StructField("quality_score", T.DoubleType()), T.StructField("accuracy_judge_score", T.DoubleType())]
    df = (spark.read.schema(T.StructType(fields)).option("multiLine", True).json(path)
          .withColumn("filename", F.col("_metadata.file_name") if name == "file"
                      else F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)))
    return df.select("filename", *EVAL_FIELDS)


def write_eval_summary(flat: DataFrame, path: str) -> None:
    """The flattened cases as CSV with a header, ordered by file and case."""
    flat.orderBy("filename", "test_case_id").write.mode("overwrite").option("header", True).csv(path)


def read_eval_summary(spark: SparkSession, path: str) -> DataFrame:
    numbers = {"latency_s": "double", "tool_call_count": "bigint", "input_tokens": "bigint", "output_tokens": "bigint",
               "quality_score": "double", "accuracy_judge_score": "double"}
    schema = ", ".join(f"{c} {numbers.get(c, 'string')}" for c in ["filename", *EVAL_FIELDS])
    return spark.read.schema(schema).option("header", True).csv(path)

"""Raw portfolio source tables derived from the TPC-H-style test tables.

The engine itself is parameterised over any number of accounts, funds and
indices; this adapter only decides which test columns play which role:

* account  = nation name of the ordering customer
* fund     = part brand
* trades   = one per lineitem; (returnflag, linestatus) picks the side
* cash     = one per order; the order priority picks the cash movement type
* prices   = volume-weighted price per (brand, ship day), whole pence
* indices  = mean order total per (priority, order day)
* ingest log = the ``events`` table

Every money amount is a whole number of pence, so sums, products with whole
units, and 2-decimal rounding agree exactly between engines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping.
SIDE_BY_FLAGS = [  # (l_returnflag, l_linestatus) -> transaction type; anything else is BUY
    ("R", "F", "SELL"),
    ("R", "O", "SWITCH_OUT"),
    ("A", "F", "SWITCH_IN"),
]
REFERENCE_PREFIX = {"BUY": "B", "SELL": "S", "SWITCH_IN": "BX", "SWITCH_OUT": "X"}
SWITCH_SUBTYPE = "Fund class switch"
CASH_BY_PRIORITY = [  # order priority -> (type, subtype, broker reference; REBATE gets the order key appended)
    ("1-URGENT", "CONTRIBUTION", "One-off", "FPC"),
    ("2-HIGH", "TRANSFER", "Transfer in", "BACS"),
    ("3-MEDIUM", "INTEREST", None, "INTEREST"),
    ("4-NOT SPECIFIED", "REBATE", "Unit rebate", "URIB"),
    ("5-LOW", "FEE", "Management fee", "MANAGE FEE"),
]
FEE_DIVISOR = 100       # fee = order total / 100, whole pence
REBATE_DIVISOR = 1000   # rebate = order total / 1000, whole pence
FIXTURE_AS_OF = "2001-08-31"
CALENDAR_START, CALENDAR_END = "1995-01-01", "2001-12-31"
PRICE_SOURCE = "fixture"
CUSTOMER_PREFIX = "C"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def _trade_type(rf: Column, ls: Column) -> Column:
    expr = None
    for flag, status, ttype in SIDE_BY_FLAGS:
        cond = (rf == flag) & (ls == status)
        expr = F.when(cond, ttype) if expr is None else expr.when(cond, ttype)
    return expr.otherwise("BUY")


@dataclass
class RawSources:
    accounts: DataFrame
    funds: DataFrame
    transactions: DataFrame
    prices: DataFrame
    benchmarks: DataFrame
    ingest_log: DataFrame


def order_accounts(spark: SparkSession, sf_dir: str, account_by: str = "nation") -> DataFrame:
    """orders -> (o_*, account_id): the customer's nation, or the customer itself (``account_by='customer'``)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))   # 25 rows by definition
            .select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("trade_date"),
                    "o_orderpriority", account_id(account_by).alias("account_id")))


def account_id(account_by: str):
    if account_by == "nation":
        return F.col("n_name")
    if account_by == "customer":
        return F.concat(F.lit(CUSTOMER_PREFIX), F.col("c_custkey").cast("string"))
    raise ValueError(f"unknown account grain {account_by!r}")


def load_raw(spark: SparkSession, sf_dir: str, account_by: str = "nation") -> RawSources:
    """Raw sources; ``account_by='customer'`` makes every customer an account (the dense
    series then grow with the data: customers x brands x days)."""
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate")
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")

    if account_by == "customer":
        cust = table(spark, sf_dir, "customer").select("c_custkey")
        accounts = cust.select(account_id("customer").alias("id"), account_id("customer").alias("name"))
    else:
        accounts = nation.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"))

    brands = part.select("p_brand").distinct()
    brand_no = F.regexp_extract("p_brand", r"(\d+)$", 1)
    funds = brands.select(
        F.col("p_brand").alias("id"),
        F.concat(F.lit("Fund "), "p_brand").alias("name"),
        F.lit(None).cast("string").alias("isin"),
        F.when(brand_no.endswith("0"), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("0P"), F.lpad(brand_no, 8, "0"))).alias("morningstar_code"),
        F.lit("GBP").alias("currency"),
        F.concat(F.lit("B"), brand_no).alias("short_name"),
        F.lit(True).alias("is_active"),
    )

    oa = order_accounts(spark, sf_dir, account_by)
    li = lineitem.join(part, lineitem.l_partkey == part.p_partkey)
    trades = li.join(oa, li.l_orderkey == oa.o_orderkey)
    ttype = _trade_type(F.col("l_returnflag"), F.col("l_linestatus"))
    prefix = F.create_map(*[x for kv in REFERENCE_PREFIX.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    trades = trades.withColumn("transaction_type", ttype).select(
        # (order, line, part, supplier, ship day) is the lineitem's unique key in the test tables
        F.concat_ws("-", F.concat(F.lit("L"), F.col("l_orderkey").cast("string")),
                    F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("id"),
        "account_id",
        F.col("p_brand").alias("fund_id"),
        "trade_date",
        F.col("l_shipdate").cast("date").alias("settle_date"),
        F.concat(F.element_at(prefix, F.col("transaction_type")), F.col("l_orderkey").cast("string")).alias("reference"),
        F.concat(F.lit("Fund "), "p_brand", F.lit(" (GBP) "), "p_name").alias("raw_description"),
        "transaction_type",
        F.when(F.col("transaction_type").startswith("SWITCH"), F.lit(SWITCH_SUBTYPE)).alias("transaction_subtype"),
        F.lit(None).cast("double").alias("unit_cost_pence"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("transaction_type").isin("BUY", "SWITCH_IN"), -F.col("l_extendedprice"))
         .otherwise(F.col("l_extendedprice")).alias("value_gbp"),
    )

    tp_cents = _cents(F.col("o_totalprice"))
    ctype = csub = cref = None
    for prio, t, sub, ref in CASH_BY_PRIORITY:
        cond = F.col("o_orderpriority") == prio
        ctype = F.when(cond, t) if ctype is None else ctype.when(cond, t)
        csub = F.when(cond, F.lit(sub)) if csub is None else csub.when(cond, F.lit(sub))
        cref = F.when(cond, F.lit(ref)) if cref is None else cref.when(cond, F.lit(ref))
    cash = oa.withColumn("transaction_type", ctype).select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"),
        "account_id",
        F.lit(None).cast("string").alias("fund_id"),
        "trade_date",
        F.lit(None).cast("date").alias("settle_date"),
        F.when(F.col("transaction_type") == "REBATE", F.concat(cref, F.col("o_orderkey").cast("string")))
         .otherwise(cref).alias("reference"),
        F.concat(F.lit("Cash "), F.col("o_orderpriority")).alias("raw_description"),
        "transaction_type",
        csub.alias("transaction_subtype"),
        F.lit(None).cast("double").alias("unit_cost_pence"),
        F.lit(None).cast("double").alias("quantity"),
        F.when(F.col("transaction_type") == "FEE",
               -(F.round(tp_cents.cast("double") / F.lit(float(FEE_DIVISOR))) / F.lit(100.0)))
         .when(F.col("transaction_type") == "REBATE",
               F.round(tp_cents.cast("double") / F.lit(float(REBATE_DIVISOR))) / F.lit(100.0))
         .otherwise(F.col("o_totalprice")).alias("value_gbp"),
    )
    transactions = trades.unionByName(cash)

    # Volume-weighted price per (brand, ship day) in whole pence. Both sums are
    # exact (integer cents, integer quantities) and the single division and the
    # round to 0 decimals are correctly rounded in every engine.
    prices = (li.groupBy("p_brand", F.col("l_shipdate").cast("date").alias("date"))
              .agg(F.sum(_cents(F.col("l_extendedprice"))).alias("cents"),
                   F.sum("l_quantity").alias("qty"))
              .select(F.col("p_brand").alias("fund_id"), "date",
                      F.round(F.col("cents").cast("double") / F.col("qty")).alias("price_pence"),
                      F.lit(PRICE_SOURCE).alias("source")))

    benchmarks = (oa.groupBy("o_orderpriority", "trade_date")
                  .agg(F.sum(tp_cents).alias("cents"), F.count(F.lit(1)).alias("n"))
                  .select(F.col("o_orderpriority").alias("index_id"),
                          F.col("trade_date").alias("date"),
                          (F.col("cents").cast("double") / (F.col("n") * 100).cast("double")).alias("level"),
                          F.concat(F.lit("^P"), F.substring("o_orderpriority", 1, 1)).alias("ticker")))

    ingest_log = events.select(
        F.col("ts").alias("run_at"),
        F.when(F.col("user_id") % 2 == 0, "transactions").otherwise("prices").alias("source"),
        F.round("value").cast("int").alias("rows_inserted"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
        F.col("event_type").alias("detail"),
    )
    return RawSources(accounts, funds, transactions, prices, benchmarks, ingest_log)

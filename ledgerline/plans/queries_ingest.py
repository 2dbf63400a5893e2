"""Registered ingestion and feed queries.

Each query first lands files that Spark derives from the test tables (broker
CSVs from the fixture transactions, a fund reference CSV from part brands,
JSON price payloads from fixture prices, eval result files from
conversations) in a fresh folder under the session's checkpoint dir, then
runs the ingestion job on them. The oracles state what the round trip must
give back, computed in DuckDB straight from the test tables.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ledgerline.plans.catalog import register
from ledgerline.sources import broker_csv as B
from ledgerline.sources import feeds as FD
from ledgerline.sources import writers as W
from ledgerline.sources.bucketed import BucketedTable
from ledgerline.sources.fixture import FIXTURE_AS_OF

TARGET_BUCKETS = 16
FIRST_BATCH_BEFORE = "1999-01-01"        # first ingest run: trades before this date
AUDIT_RUN_AT = _dt.datetime(2001, 9, 1, 1, 0, 0)
BACKFILL_FUND = "Brand#3"
RAW_COLS = ("account_id, trade_date, settle_date, reference, raw_description, unit_cost_pence, quantity, value_gbp")
TX_COLS = ("id, account_id, fund_id, trade_date, settle_date, reference, raw_description, transaction_type, "
           "transaction_subtype, unit_cost_pence, quantity, value_gbp")
SQL_ID = ("md5(account_id || '|' || strftime(trade_date, '%Y-%m-%d') || '|' || reference || '|' || "
          "regexp_replace(CAST(CAST(value_gbp AS DECIMAL(18,2)) AS VARCHAR), '(\\.\\d)0$', '\\1'))")


def _landed_csv(p):
    """The fixture's export, written once per model set."""
    if not hasattr(p, "_broker_csv"):
        p._broker_csv = B.write_broker_csv(p.raw.transactions, B.scratch_path(p.spark, "broker-csv"))
    return p._broker_csv


def _scan(p):
    return B.scan_broker_csv(p.spark, _landed_csv(p))


@register("scan_broker_csv", oracle=f"SELECT {RAW_COLS} FROM raw_transactions")
def scan_broker_csv(p):
    parsed = B.parse_broker_rows(_scan(p))
    return parsed.select(*[c.strip() for c in RAW_COLS.split(",")])


# Descriptions as people paste them: line breaks, quotes and commas inside the cell.
_PASTED = """
, pasted AS (
    SELECT * EXCLUDE (raw_description), CASE length(reference) % 3
        WHEN 0 THEN raw_description || chr(10) || 'second line, "quoted"' || chr(10) || chr(10) || 'last "line'
        WHEN 1 THEN '"' || raw_description || '",' || chr(10) || '"' ELSE raw_description END AS raw_description
    FROM raw_transactions)"""
SPLIT_BYTES = 32_768
SPLITS = 1_024           # larger exports are cut into about this many splits, each larger than SPLIT_BYTES
WHOLE_SPLIT_BYTES = 128 * 1024 * 1024


def _split_bytes(p, root):
    """Split size for a folder: a fixed one would make the tasks (and so the scheduling) grow with the input, each doing nothing."""
    return min(max(SPLIT_BYTES, W.folder_bytes(p.spark, root) // SPLITS), WHOLE_SPLIT_BYTES)


@register("scan_multiline_csv", oracle=_PASTED + f"""
SELECT {RAW_COLS} FROM pasted""")
def scan_multiline_csv(p):
    """Records over several lines, read in splits that begin anywhere, inside quoted cells too."""
    t, d, kind = p.raw.transactions, F.col("raw_description"), F.length("reference") % 3
    pasted = t.withColumn("raw_description", F.when(kind == 0, F.concat(d, F.lit('\nsecond line, "quoted"\n\nlast "line')))
                          .when(kind == 1, F.concat(F.lit('"'), d, F.lit('",\n"'))).otherwise(d))
    root = B.write_broker_csv(pasted, B.scratch_path(p.spark, "multiline-csv"), packed=False)
    size = _split_bytes(p, root)
    conf = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": size}
    old = {k: p.spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            p.spark.conf.set(k, v)
        parsed = B.parse_broker_rows(B.scan_broker_csv(p.spark, root))
        return W.materialise(parsed.select(*[c.strip() for c in RAW_COLS.split(",")]), "multiline")
    finally:
        for k, v in old.items():
            p.spark.conf.set(k, v)


@register("route_by_account", oracle="SELECT account_id, count(*) AS n_rows FROM raw_transactions GROUP BY 1")
def route_by_account(p):
    return _scan(p).groupBy("account_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register("classify_transaction", oracle="""
SELECT reference, value_gbp, transaction_type, transaction_subtype FROM raw_transactions""")
def classify_transaction(p):
    from ledgerline.functions.text import classify_transaction as cls
    t = p.raw.transactions.select("reference", "value_gbp")
    return t.select("reference", "value_gbp", cls(F.col("reference"), F.col("value_gbp")).alias("c")) \
        .select("reference", "value_gbp", "c.*")


@register("extract_fund_name", oracle="""
SELECT raw_description, nullif(trim(regexp_extract(raw_description, '^(.+?)\\s*\\(GBP\\)', 1)), '') AS fund_name
FROM raw_transactions""")
def extract_fund_name(p):
    from ledgerline.functions.text import extract_fund_name as efn
    return p.raw.transactions.select("raw_description", efn(F.col("raw_description")).alias("fund_name"))


@register("ingest_transactions", oracle=f"""
SELECT {SQL_ID} AS id, account_id, fund_id, trade_date, settle_date, reference, raw_description, transaction_type,
       transaction_subtype, unit_cost_pence, quantity, value_gbp
FROM raw_transactions""")
def ingest_transactions(p):
    tx, _ = B.ingest_transactions(_scan(p), p.raw.funds, p.raw.accounts)
    return tx.drop("source_file")


@register("transaction_id", oracle=f"SELECT account_id, trade_date, reference, value_gbp, {SQL_ID} AS id FROM raw_transactions")
def transaction_id(p):
    from ledgerline.functions.keys import transaction_id as tid
    t = p.raw.transactions
    return t.select("account_id", "trade_date", "reference", "value_gbp",
                    tid(F.col("account_id"), F.col("trade_date"), F.col("reference"), F.col("value_gbp")).alias("id"))


@register("match_fund", oracle="""
SELECT t.raw_description, f.id AS fund_id
FROM raw_transactions t
LEFT JOIN (SELECT lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS k, max(id) AS id FROM raw_funds GROUP BY 1) f
  ON f.k = lower(trim(regexp_replace(trim(regexp_extract(t.raw_description, '^(.+?)\\s*\\(GBP\\)', 1)), '\\s+', ' ', 'g')))
WHERE t.transaction_type IN ('BUY', 'SELL', 'SWITCH_IN', 'SWITCH_OUT')""")
def match_fund(p):
    from ledgerline.functions.text import extract_fund_name as efn, normalise_name
    t = p.raw.transactions.filter(F.col("transaction_type").isin(*B.TRADE_TYPES))
    t = t.select("raw_description", normalise_name(efn(F.col("raw_description"))).alias("_name_key"))
    return t.join(B.fund_lookup(p.raw.funds), "_name_key", "left").select(
        "raw_description", F.col("_fund_id").alias("fund_id"))


def _ingested(spark, lines, funds, accounts=None):
    """(transactions, rejects and warnings) of scanned lines, which are parsed and matched once, into a scratch table."""
    matched, _ = W.write_observed(B.match_parsed(B.parse_broker_rows(lines), funds, accounts), B.scratch_path(spark, "parsed-run"),
                                  processed=F.count(F.lit(1)))
    return B.ingest_matched(matched)


def _two_runs(p):
    """Run 1 ingests trades dated before FIRST_BATCH_BEFORE; run 2 re-ingests everything. The files are parsed once."""
    tx = _ingested(p.spark, _scan(p), p.raw.funds)[0].drop("source_file")
    order = ["settle_date", "raw_description", "quantity"]      # ascending, nulls first
    run1 = tx.filter(F.col("trade_date") < F.lit(FIRST_BATCH_BEFORE).cast("date"))
    new1, _ = W.insert_or_ignore(None, run1, ["id"], order)
    # a written table, as a target is: run 2 reads its ids and dates only
    table1, _ = W.write_observed(new1, B.scratch_path(p.spark, "first-run"), inserted=F.count(F.lit(1)))
    new2, table2 = W.insert_or_ignore(table1, tx, ["id"], order, prune_by="trade_date")
    return tx, new2, table2


_DEDUPED = f"""
, ing AS (SELECT {SQL_ID} AS id, * FROM raw_transactions),
  ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY settle_date ASC NULLS FIRST,
                                   raw_description ASC NULLS FIRST, quantity ASC NULLS FIRST) AS rn FROM ing)
          WHERE rn = 1)"""


@register("insert_or_ignore", oracle=_DEDUPED + f"""
SELECT {TX_COLS} FROM ded""")
def insert_or_ignore(p):
    """Trades before 1999 first, then everything again, into a target bucketed by id."""
    tx = _ingested(p.spark, _scan(p), p.raw.funds)[0].drop("source_file")
    target = BucketedTable(p.spark, B.scratch_path(p.spark, "transactions"), tx.schema, ["id"], TARGET_BUCKETS)
    order = ["settle_date", "raw_description", "quantity"]      # ascending, nulls first
    target.insert_or_ignore(tx.filter(F.col("trade_date") < F.lit(FIRST_BATCH_BEFORE).cast("date")), order)
    target.insert_or_ignore(tx, order)
    return target.read()


@register("ingest_counts", oracle=_DEDUPED + f"""
, per AS (
    SELECT a.account_id, a.processed, CAST(coalesce(b.inserted, 0) AS BIGINT) AS inserted
    FROM (SELECT account_id, count(*) AS processed FROM ing GROUP BY 1) a
    LEFT JOIN (SELECT account_id, count(*) AS inserted FROM ded WHERE trade_date >= DATE '{FIRST_BATCH_BEFORE}'
               GROUP BY 1) b ON b.account_id = a.account_id)
SELECT account_id, processed, inserted, processed - inserted AS skipped, CAST(0 AS BIGINT) AS rejected FROM per
UNION ALL
SELECT 'TOTAL', sum(processed), sum(inserted), sum(processed - inserted), 0 FROM per""")
def ingest_counts(p):
    batch, new2, _ = _two_runs(p)
    appended, _ = W.write_observed(new2, B.scratch_path(p.spark, "appended"), inserted=F.count(F.lit(1)))
    return B.ingest_counts(batch, appended, "account_id")


@register("ingest_audit_log", oracle=_DEDUPED + f"""
SELECT run_at, source, rows_inserted, status, detail FROM raw_ingest_log
UNION ALL
SELECT TIMESTAMP '{AUDIT_RUN_AT:%Y-%m-%d %H:%M:%S}', 'transactions',
       CAST((SELECT count(*) FROM ded WHERE trade_date >= DATE '{FIRST_BATCH_BEFORE}') AS INTEGER),
       'success', 'broker csv'""")
def ingest_audit_log(p):
    _, new2, _ = _two_runs(p)
    _, seen = W.write_observed(new2, B.scratch_path(p.spark, "appended"), inserted=F.count(F.lit(1)))
    row = W.audit_row(p.spark, AUDIT_RUN_AT, "transactions", seen["inserted"], "success", "broker csv")
    return p.raw.ingest_log.select("run_at", "source", "rows_inserted", "status", "detail").unionByName(row)


_FAULTS = """
, faulted AS (
    SELECT *, CASE WHEN transaction_type IN ('BUY', 'SELL', 'SWITCH_IN', 'SWITCH_OUT') AND reference LIKE '%7' THEN 'value'
                   WHEN transaction_type IN ('BUY', 'SELL', 'SWITCH_IN', 'SWITCH_OUT') AND reference LIKE '%3' THEN 'fund'
              END AS fault
    FROM raw_transactions)"""


@register("quarantine_rejects", oracle=_FAULTS + """
SELECT account_id, trade_date, reference,
       CASE WHEN fault = 'fund' THEN 'Unknown ' || raw_description ELSE raw_description END AS raw_description,
       CASE WHEN fault = 'value' THEN 'unparseable value' ELSE 'unmatched fund' END AS reject_reason
FROM faulted WHERE fault IS NOT NULL""")
def quarantine_rejects(p):
    t = p.raw.transactions
    trade = F.col("transaction_type").isin(*B.TRADE_TYPES)
    faulted = t.select(
        *[c for c in t.columns if c not in ("value_gbp", "raw_description")],
        F.when(trade & F.col("reference").endswith("7"), F.lit(None).cast("double")).otherwise(F.col("value_gbp"))
         .alias("value_gbp"),
        F.when(trade & F.col("reference").endswith("3") & ~F.col("reference").endswith("7"),
               F.concat(F.lit("Unknown "), F.col("raw_description"))).otherwise(F.col("raw_description"))
         .alias("raw_description"))
    root = B.write_broker_csv(faulted, B.scratch_path(p.spark, "broker-csv-faults"))
    _, rejects = B.ingest_transactions(B.scan_broker_csv(p.spark, root), p.raw.funds)
    return rejects.drop("source_file", "severity", "raw_line")


# The export's rows in the shapes that real files have: an eighth column in front of the value, day and month
# without leading zeros, ISO dates, rows with only the mandatory cells, header words inside descriptions, an
# account that nobody opened.
_MESSY = """
, messy AS (
    SELECT *, CASE WHEN length(reference) % 5 = 1 THEN 'unparseable trade date'
                   WHEN account_id = (SELECT max(id) FROM raw_accounts) THEN 'unknown account' END AS reason
    FROM raw_transactions)"""


@register("ingest_messy_exports", oracle=_MESSY + f"""
SELECT 'inserted' AS outcome, account_id, count(DISTINCT {SQL_ID}) AS n_rows FROM messy WHERE reason IS NULL GROUP BY 2
UNION ALL
SELECT 'skipped', account_id, count(*) - count(DISTINCT {SQL_ID}) FROM messy WHERE reason IS NULL GROUP BY 2
UNION ALL
SELECT reason, account_id, count(*) FROM messy WHERE reason IS NOT NULL GROUP BY 1, 2""")
def ingest_messy_exports(p):
    """Every line of oddly shaped files ends up inserted, skipped or rejected with a reason."""
    t = p.raw.transactions
    iso = F.length("reference") % 5 == 1
    plain = F.concat_ws("/", F.dayofmonth("trade_date"), F.month("trade_date"), F.year("trade_date"))
    cash = F.col("quantity").isNull()
    na = F.when(cash, F.lit(None)).otherwise(F.lit("n/a"))
    out = t.select(
        "account_id", F.when(iso, F.date_format("trade_date", "yyyy-MM-dd")).otherwise(plain).alias("Trade date"),
        F.lit(None).cast("string").alias("Settle date"), F.col("reference").alias("Reference"),
        F.when(cash, F.lit(None)).otherwise(F.concat(F.lit("adjusted trade date, reference "), "raw_description")).alias("Description"),
        na.alias("Unit cost (p)"), F.format_string("%.0f", "quantity").alias("Quantity"), F.lit("GBP").alias("Currency"),
        F.format_number("value_gbp", 2).alias("Value (£)"))
    out = out.withColumn("Quantity", F.when(cash, F.lit(None)).otherwise(F.col("Quantity")))
    root = B.write_exports(out, B.scratch_path(p.spark, "messy-csv"), "account_id")
    last = F.lit(p.raw.accounts.agg(F.max("id")).first()[0])
    rows, rejects = _ingested(p.spark, B.scan_broker_csv(p.spark, root), p.raw.funds, p.raw.accounts.filter(F.col("id") != last))
    rejects = rejects.filter(F.col("severity") == B.REJECTED)
    order = ["settle_date", "raw_description", "quantity"]
    # rows are only counted: the columns that the counts and the choice among copies read
    new, _ = W.insert_or_ignore(None, rows.select("id", "account_id", *order), ["id"], order)
    per = B.ingest_counts(rows, new, "account_id").filter(F.col("account_id") != "TOTAL")
    ok = per.select(F.explode(F.array(F.struct(F.lit("inserted").alias("outcome"), F.col("inserted").alias("n_rows")),
                                      F.struct(F.lit("skipped").alias("outcome"), F.col("skipped").alias("n_rows")))).alias("o"), "account_id")
    return ok.select("o.outcome", "account_id", "o.n_rows").unionByName(
        rejects.groupBy(F.col("reject_reason").alias("outcome"), "account_id").agg(F.count(F.lit(1)).alias("n_rows")))


# ---------------------------------------------------------------- fund reference
def _fund_reference_rows(p):
    """ISIN by brand number n: n%4==0 '??' (placeholder row), 1 'No_ISIN', 2 blank, 3 'GB' + 10 digits."""
    part = p.raw.funds.select(F.col("id").alias("brand"))
    n = F.regexp_extract("brand", r"(\d+)$", 1).cast("int")
    isin = (F.when(n % 4 == 0, F.lit("??")).when(n % 4 == 1, F.lit("No_ISIN")).when(n % 4 == 2, F.lit(""))
            .otherwise(F.concat(F.lit("GB"), F.lpad(n.cast("string"), 10, "0"))))
    return part.select(isin.alias("fund_ISIN"),
                       F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("0P"), F.lpad(n.cast("string"), 8, "0")))
                       .alias("fund_code"),
                       F.concat(F.lit("  The  "), F.col("brand"), F.lit(" Growth & Income Fund (Acc) ")).alias("fund_name"),
                       F.concat(F.lit("B"), n.cast("string")).alias("short_name"))


def _landed_fund_ref(p):
    root = B.scratch_path(p.spark, "fund-ref")
    _fund_reference_rows(p).write.option("header", True).option("emptyValue", "").csv(root)
    return FD.read_fund_reference(p.spark, root)


_FUNDREF_SQL = """
, fr AS (
    SELECT CASE WHEN n % 4 = 0 THEN '??' WHEN n % 4 = 1 THEN 'No_ISIN' WHEN n % 4 = 2 THEN NULL
                ELSE 'GB' || lpad(CAST(n AS VARCHAR), 10, '0') END AS isin_raw,
           CASE WHEN n % 5 = 0 THEN NULL ELSE '0P' || lpad(CAST(n AS VARCHAR), 8, '0') END AS code,
           trim('  The  ' || id || ' Growth & Income Fund (Acc) ') AS name, 'B' || CAST(n AS VARCHAR) AS short_name
    FROM (SELECT id, CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) AS n FROM raw_funds)),
  clean AS (
    SELECT coalesce(CASE WHEN coalesce(isin_raw, '') IN ('', 'No_ISIN') THEN NULL ELSE isin_raw END,
                    substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40))
             AS id, name,
           CASE WHEN coalesce(isin_raw, '') IN ('', 'No_ISIN') THEN NULL ELSE isin_raw END AS isin,
           code AS morningstar_code, short_name
    FROM fr WHERE coalesce(isin_raw, '') <> '??')"""


@register("clean_fund_reference", oracle=_FUNDREF_SQL + "\nSELECT * FROM clean")
def clean_fund_reference(p):
    return FD.clean_fund_reference(_landed_fund_ref(p))


@register("upsert_replace", oracle=_FUNDREF_SQL + """
SELECT id, name, isin, morningstar_code, short_name FROM clean
UNION ALL
SELECT id, name, NULL, morningstar_code, short_name FROM raw_funds WHERE id NOT IN (SELECT id FROM clean)""")
def upsert_replace(p):
    funds = p.raw.funds.select("id", "name", "isin", "morningstar_code", "short_name")
    target = BucketedTable(p.spark, B.scratch_path(p.spark, "funds"), funds.schema, ["id"], TARGET_BUCKETS)
    target.insert_or_ignore(funds)
    target.upsert_replace(FD.clean_fund_reference(_landed_fund_ref(p)))
    return target.read()


# ---------------------------------------------------------------- price feed
@register("normalise_price_payload", oracle="SELECT fund_id, date, price_pence FROM raw_prices")
def normalise_price_payload(p):
    payloads = FD.price_payloads_from(p.raw.prices)
    # landed feed files also carry malformed entries and non-list bodies, which must vanish
    bad = F.concat(F.lit('[[null, 5.0], ["oops"], [1, "x"], '), F.expr("substring(payload, 2)"))
    landed = payloads.select("fund_id", bad.alias("payload")).unionByName(
        payloads.select("fund_id", F.lit('{"message": "no data"}').alias("payload")))
    root = B.scratch_path(p.spark, "price-payloads")
    landed.write.partitionBy("fund_id").text(root)
    read = (p.spark.read.text(root, wholetext=False)
            .withColumn("fund_id", B.account_from_path(F.col("_metadata.file_path"))))
    return FD.normalise_price_payload(read, "fund_id", "value")


@register("fetch_universe", oracle="SELECT fund_id, morningstar_code FROM dim_fund WHERE morningstar_code IS NOT NULL")
def fetch_universe(p):
    return FD.fetch_universe(p.dim_fund)


@register("missing_code_report", oracle="""
SELECT fund_id, fund_name, investment_status_indicator FROM dim_fund WHERE morningstar_code IS NULL""")
def missing_code_report(p):
    return FD.missing_code_report(p.dim_fund)


@register("missing_code_report_held", oracle="""
SELECT fund_id, fund_name, investment_status_indicator FROM dim_fund
WHERE morningstar_code IS NULL AND investment_status_indicator = 'Holding'""")
def missing_code_report_held(p):
    return FD.missing_code_report(p.dim_fund, holding_only=True)


NEW_INDEX = "5-LOW"     # an index of which no level has landed yet


@register("index_high_water_mark", oracle=f"""
, named AS (SELECT DISTINCT index_id, ticker FROM raw_benchmarks),
  landed AS (SELECT index_id, max(date) AS d FROM raw_benchmarks WHERE index_id <> '{NEW_INDEX}' GROUP BY 1)
SELECT index_id, ticker, coalesce(CAST(d + INTERVAL 1 DAY AS DATE), DATE '2017-01-01') AS fetch_start
FROM named LEFT JOIN landed USING (index_id)
WHERE coalesce(CAST(d + INTERVAL 1 DAY AS DATE), DATE '2017-01-01') < DATE '2018-01-01'""")
def index_high_water_mark(p):
    levels = p.raw.benchmarks
    indices = levels.select("index_id", "ticker").distinct()
    return FD.index_high_water_mark(indices, levels.filter(F.col("index_id") != NEW_INDEX), "2018-01-01")


@register("append_prices", oracle="""
SELECT fund_id, date, price_pence, 'old' AS origin FROM raw_prices WHERE date < DATE '2000-01-01'
UNION ALL
SELECT fund_id, date, price_pence, 'new' FROM raw_prices WHERE date >= DATE '2000-01-01'""")
def append_prices(p):
    """Landed prices up to 1999, then a feed that brings every day again: existing (fund, day) rows win."""
    feed = p.raw.prices.select("fund_id", "date", "price_pence")
    landed = feed.filter(F.col("date") < F.lit("2000-01-01").cast("date")).withColumn("origin", F.lit("old"))
    _, table = W.insert_or_ignore(landed, feed.withColumn("origin", F.lit("new")), ["fund_id", "date"], prune_by="date")
    return table


@register("append_index_levels", oracle="""
SELECT index_id, date, level, if(date < DATE '2000-01-01', 'old', 'new') AS origin FROM raw_benchmarks""")
def append_index_levels(p):
    feed = p.raw.benchmarks.select("index_id", "date", "level")
    landed = feed.filter(F.col("date") < F.lit("2000-01-01").cast("date")).withColumn("origin", F.lit("old"))
    _, table = W.insert_or_ignore(landed, feed.withColumn("origin", F.lit("new")), ["index_id", "date"], prune_by="date")
    return table


@register("fetch_high_water_mark", oracle=f"""
, pr AS (SELECT * FROM raw_prices WHERE fund_id <> '{BACKFILL_FUND}' AND date < DATE '2000-01-01')
SELECT u.fund_id, u.morningstar_code,
       coalesce(CASE WHEN u.fund_id = '{BACKFILL_FUND}' THEN DATE '1999-06-01' END,
                CAST(l.d + INTERVAL 1 DAY AS DATE), f.d, DATE '2017-01-01') AS fetch_start
FROM (SELECT fund_id, morningstar_code FROM dim_fund WHERE morningstar_code IS NOT NULL) u
LEFT JOIN (SELECT fund_id, max(date) AS d FROM pr GROUP BY 1) l ON l.fund_id = u.fund_id
LEFT JOIN (SELECT fund_id, min(trade_date) AS d FROM raw_transactions WHERE fund_id IS NOT NULL GROUP BY 1) f
  ON f.fund_id = u.fund_id
WHERE coalesce(CASE WHEN u.fund_id = '{BACKFILL_FUND}' THEN DATE '1999-06-01' END,
               CAST(l.d + INTERVAL 1 DAY AS DATE), f.d, DATE '2017-01-01') < DATE '{FIXTURE_AS_OF}'""")
def fetch_high_water_mark(p):
    """Prices landed up to 1999 for every fund but one (which has none); that one is backfilled."""
    prices = p.raw.prices.filter((F.col("fund_id") != BACKFILL_FUND) & (F.col("date") < F.lit("2000-01-01").cast("date")))
    universe = FD.fetch_universe(p.dim_fund)
    root = FD.land_by_fund(prices, B.scratch_path(p.spark, "prices-by-fund"))
    plain = FD.fetch_high_water_mark(universe.filter(F.col("fund_id") != BACKFILL_FUND), prices,
                                     p.raw.transactions, FIXTURE_AS_OF, last=FD.last_days(p.spark, root))
    back = FD.fetch_high_water_mark(universe.filter(F.col("fund_id") == BACKFILL_FUND), prices,
                                    p.raw.transactions, FIXTURE_AS_OF, backfill_from="1999-06-01")
    return plain.unionByName(back)


@register("materialise", oracle="SELECT * FROM portfolio_value_daily")
def materialise(p):
    return W.materialise(p.portfolio_value_daily.withColumn("year_month", F.date_format("valuation_date", "yyyy-MM")),
                         "portfolio_value_daily", partition_by=["year_month"],
                         sort_within=["account_name", "valuation_date"]).drop("year_month")


# ---------------------------------------------------------------- eval results
CASES_PER_FILE = 100


def _eval_cases(p):
    conv = p.table("conversations").select("conv_id", "turn", "role", "text")
    return (conv.groupBy("conv_id").agg(
        F.max("turn").alias("_turns"),
        F.sum(F.length("text")).alias("_chars"),
        F.sum(F.when(F.col("role") == "user", F.length("text"))).alias("_in"),
        F.sum(F.when(F.col("role") == "assistant", F.length("text"))).alias("_out"),
        F.count(F.when(F.col("role") == "system", 1)).alias("_sys"))
        .select((F.col("conv_id") / CASES_PER_FILE).cast("bigint").alias("run"),
                F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("test_case_id"),
                F.when(F.col("_turns") < 2, "simple").when(F.col("_turns") < 4, "medium").otherwise("complex")
                .alias("difficulty"),
                (F.col("_chars") / F.lit(1000.0)).alias("latency_s"), F.col("_sys").alias("tool_call_count"),
                F.coalesce("_in", F.lit(0)).alias("input_tokens"), F.coalesce("_out", F.lit(0)).alias("output_tokens"),
                (F.col("_turns") % 5 + 1).cast("double").alias("quality_score"),
                F.lit(None).cast("double").alias("accuracy_judge_score")))


@register("flatten_eval_results", oracle=f"""
, cases AS (
    SELECT conv_id, max(turn) AS t, sum(length(text)) AS ch,
           sum(CASE WHEN role = 'user' THEN length(text) END) AS i,
           sum(CASE WHEN role = 'assistant' THEN length(text) END) AS o,
           count(CASE WHEN role = 'system' THEN 1 END) AS s
    FROM conversations GROUP BY 1)
SELECT 'run=' || CAST(CAST(floor(conv_id / {CASES_PER_FILE}) AS BIGINT) AS VARCHAR) AS filename,
       'C' || conv_id AS test_case_id,
       CASE WHEN t < 2 THEN 'simple' WHEN t < 4 THEN 'medium' ELSE 'complex' END AS difficulty,
       ch / 1000.0 AS latency_s, s AS tool_call_count, coalesce(i, 0) AS input_tokens, coalesce(o, 0) AS output_tokens,
       CAST(t % 5 + 1 AS DOUBLE) AS quality_score, CAST(NULL AS DOUBLE) AS accuracy_judge_score
FROM cases""")
def flatten_eval_results(p):
    """One JSON array file per run of 100 cases, flattened to the summary CSV (run folder as file name) and read back."""
    cases = _eval_cases(p)
    files = cases.groupBy("run").agg(F.to_json(F.collect_list(F.struct(*FD.EVAL_FIELDS))).alias("value"))
    root = B.scratch_path(p.spark, "eval-results")
    files.write.partitionBy("run").text(root)
    summary = B.scratch_path(p.spark, "eval-summary")
    FD.write_eval_summary(FD.flatten_eval_results(p.spark, root, name="folder"), summary)
    return FD.read_eval_summary(p.spark, summary)

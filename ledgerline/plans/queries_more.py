"""Registered data-quality (J), text (H), derived-series (E/F/G/C/I28-I34, B9-B11) and
streaming (L1) queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.numeric import sql_dround
from ledgerline.operators import quality as Q
from ledgerline.plans import derived as DV
from ledgerline.plans import text_metrics as TM
from ledgerline.plans.catalog import register
from ledgerline.plans.declared_checks import declared_sql, run_declared
from ledgerline.plans.queries_ingest import SQL_ID, TX_COLS
from ledgerline.plans.queries_serving import (_WEIGHTED, ACCOUNT_A, ACCOUNT_B, AS_OF, INDEX_A, INDICES, SERIES_FROM,
                                              _in)
from ledgerline.sources import broker_csv as B

REBASE_MONTH = "1999-01"
CUTOFF, HIST_FROM, HIST_TO = "2000-12-31", "2000-01-01", "2000-12-31"
FY_FROM, FY_TO = "FY96", "FY99"   # labels compare as strings, so keep the range inside one century
ADHOC_SQL = ("SELECT account_name, holding_type, count(*) AS n, round(sum(value_gbp), 2) AS value_gbp "
             "FROM mart_holdings_latest GROUP BY account_name, holding_type")

# ------------------------------------------------------------------ J1-J6


def _nn(table, src, cols):
    return "\nUNION ALL ".join(
        f"SELECT '{table}', 'not_null', '{c}', CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM {src}"
        for c in cols)


def _uq(table, src, cols):
    name = "unique" if len(cols) == 1 else "unique_combination"
    k = ", ".join(cols)
    return (f"SELECT '{table}', '{name}', '{','.join(cols)}', CAST(count(*) AS BIGINT) FROM "
            f"(SELECT {k} FROM {src} GROUP BY {k} HAVING count(*) > 1)")


@register("dq_report", oracle=declared_sql())
def dq_report(p):
    return run_declared(p)


@register("assert_not_null", oracle=f"""
, dq(table_name, check_name, column_name, failures) AS (
{_nn("fct_transactions", "fct", ["transaction_id", "account_key", "fund_key", "settle_date_key", "quantity"])})
SELECT * FROM dq""")
def assert_not_null(p):
    return Q.assert_not_null(p.fct_transactions, "fct_transactions",
                             ["transaction_id", "account_key", "fund_key", "settle_date_key", "quantity"])


@register("assert_unique_combination", oracle=f"""
, dq(table_name, check_name, column_name, failures) AS (
{_uq("fct_transactions", "fct", ["trade_date_key", "account_key", "transaction_reference"])})
SELECT * FROM dq""")
def assert_unique_combination(p):
    return Q.assert_unique(p.fct_transactions, "fct_transactions", ["trade_date_key", "account_key",
                                                                    "transaction_reference"])


# ------------------------------------------------------------------ H1 / H2
_NUM_PAT = r"'£?([\d,]+(?:\.\d+)?)\s*%?'"


@register("extract_numbers", oracle=f"""
SELECT DISTINCT doc_id, number FROM (
  SELECT doc_id, TRY_CAST(replace(m, ',', '') AS DOUBLE) AS number
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_NUM_PAT}, 1)) AS m FROM documents))
WHERE number IS NOT NULL""")
def extract_numbers(p):
    return TM.numbers_in_documents(p.table("documents").select("doc_id", "text"))


@register("numeric_accuracy", oracle=f"""
, pairs AS (
    SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer
    FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn
    WHERE a.role = 'assistant'),
  nums AS (
    SELECT conv_id, turn,
           list_filter(list_transform(regexp_extract_all(question, {_NUM_PAT}, 1),
                                      lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)),
                       lambda x: x IS NOT NULL AND x <> 0) AS exp,
           list_distinct(list_filter(list_transform(regexp_extract_all(answer, {_NUM_PAT}, 1),
                                                    lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)),
                                     lambda x: x IS NOT NULL)) AS resp
    FROM pairs),
  scored AS (
    SELECT conv_id, turn, len(exp) AS n,
           len(list_filter(exp, lambda e: len(list_filter(resp, lambda r: abs(r - e) / greatest(abs(e), 1e-9)
                 <= CASE WHEN abs(e) >= 100 THEN 0.02 ELSE 0.005 END)) > 0)) AS found
    FROM nums)
SELECT conv_id, turn, CAST(n AS BIGINT) AS expected, CAST(found AS BIGINT) AS found,
       CASE WHEN n > 0 THEN {sql_dround('found / n', 2)} END AS accuracy
FROM scored""")
def numeric_accuracy(p):
    pairs = TM.answer_pairs(p.table("conversations").select("conv_id", "turn", "role", "text"))
    return TM.numeric_accuracy(pairs, ["conv_id", "turn"], "question", "answer")


# ------------------------------------------------------------------ derived series
_PERF = "RECURSIVE" + _WEIGHTED + f"""
, st AS (SELECT coalesce(min(month_end_date), DATE '{SERIES_FROM}') AS s FROM wr),
  perf AS (
    SELECT 'portfolio' AS series, month_end_date AS date, v AS indexed FROM idx
    UNION ALL
    SELECT index_id, month_end_date,
           round(month_end_level / first_value(month_end_level) OVER (PARTITION BY index_id ORDER BY month_end_date)
                 * 100, 4)
    FROM benchmark_returns_monthly
    WHERE index_id IN ({_in(INDICES)}) AND month_end_date >= (SELECT s FROM st)
      AND month_end_date <= DATE '{AS_OF}')"""


def _perf(p):
    return p.performance_series(SERIES_FROM, AS_OF, None, INDICES)


@register("series_endpoints", oracle=_PERF + """
SELECT series, min(date) AS start_date, arg_min(indexed, date) AS start_value, max(date) AS end_date,
       arg_max(indexed, date) AS end_value, count(*) AS points
FROM perf GROUP BY 1""")
def series_endpoints(p):
    return DV.series_endpoints(_perf(p), "series", "date", "indexed")


@register("total_and_annualised_return", oracle=_PERF + """
, e AS (SELECT series, min(date) AS d0, max(date) AS d1, arg_max(indexed, date) AS v1 FROM perf GROUP BY 1)
SELECT series, round(v1 - 100, 6) AS total_return_pct,
       round(CASE WHEN datediff('day', d0, d1) / 365.25 >= 1
                  THEN (pow(v1 / 100, 1 / (datediff('day', d0, d1) / 365.25)) - 1) * 100 END, 6) AS annualised_return_pct
FROM e""")
def total_and_annualised_return(p):
    t = DV.total_and_annualised(_perf(p))
    return t.select("series", F.round("total_return_pct", 6).alias("total_return_pct"),
                    F.round("annualised_return_pct", 6).alias("annualised_return_pct"))


_YEAR_RATIOS = """
, ye AS (SELECT series, year(date) AS year, arg_max(indexed, date) AS year_end FROM perf GROUP BY 1, 2),
  ratios AS (
    SELECT a.series, a.year, CASE WHEN b.year_end IS NOT NULL THEN (a.year_end / b.year_end - 1) * 100 END AS r
    FROM ye a LEFT JOIN ye b ON b.series = a.series AND b.year = a.year - 1)"""


@register("prior_year_end_ratio", oracle=_PERF + _YEAR_RATIOS + """
SELECT series, CAST(year AS INTEGER) AS year, round(r, 6) AS return_pct FROM ratios""")
def prior_year_end_ratio(p):
    r = DV.prior_year_end_ratio(_perf(p))
    return r.select("series", "year", F.round("return_pct", 6).alias("return_pct"))


@register("calendar_year_returns", oracle=_PERF + _YEAR_RATIOS + f"""
, wide AS (
    SELECT year,
           max(CASE WHEN series = 'portfolio' THEN r END) AS r0,
           {', '.join(f"max(CASE WHEN series = '{s}' THEN r END) AS r{i + 1}" for i, s in enumerate(INDICES))}
    FROM ratios GROUP BY year)
SELECT CAST(year AS INTEGER) AS year, year = {int(AS_OF[:4])} AS is_ytd, round(r0, 6) AS r0,
       {', '.join(f'round(r{i + 1}, 6) AS r{i + 1}' for i in range(len(INDICES)))}
FROM wide WHERE coalesce(r0, {', '.join(f'r{i + 1}' for i in range(len(INDICES)))}) IS NOT NULL""")
def calendar_year_returns(p):
    return p.calendar_year_returns(SERIES_FROM, AS_OF, INDICES)


@register("align_series_by_date", oracle=_PERF + f"""
SELECT date, max(CASE WHEN series = 'portfolio' THEN indexed END) AS s0,
       {', '.join(f"max(CASE WHEN series = '{s}' THEN indexed END) AS s{i + 1}" for i, s in enumerate(INDICES))}
FROM perf GROUP BY date
HAVING max(CASE WHEN series = 'portfolio' THEN indexed END) IS NOT NULL
    OR max(CASE WHEN series = '{INDEX_A}' THEN indexed END) IS NOT NULL""")
def align_series_by_date(p):
    return DV.align_series(_perf(p), ["portfolio", *INDICES], require=["portfolio", INDEX_A])


@register("union_distinct_keys", oracle=_PERF + f"""
SELECT DISTINCT date FROM perf WHERE series IN ('portfolio', '{INDEX_A}')""")
def union_distinct_keys(p):
    s = _perf(p)
    a = s.filter(F.col("series") == "portfolio").select("date")
    b = s.filter(F.col("series") == INDEX_A).select("date")
    return a.union(b).distinct()


_IVG = f"""
, ivg AS (
    SELECT valuation_date AS date, round(sum(portfolio_value_gbp), 2) AS portfolio_value,
           round(sum(cumulative_inflows_gbp), 2) AS cumulative_inflows,
           round(round(sum(portfolio_value_gbp), 2) - round(sum(cumulative_inflows_gbp), 2), 2) AS growth
    FROM portfolio_inflows_daily WHERE valuation_date BETWEEN DATE '{SERIES_FROM}' AND DATE '{AS_OF}' GROUP BY 1),
  monthly AS (
    SELECT arg_max(date, date) AS date, arg_max(portfolio_value, date) AS portfolio_value,
           arg_max(cumulative_inflows, date) AS cumulative_inflows, arg_max(growth, date) AS growth
    FROM ivg GROUP BY strftime(date, '%Y-%m'))"""


@register("period_end_downsample", oracle=_IVG + "\nSELECT * FROM monthly")
def period_end_downsample(p):
    return p.inflows_monthly(SERIES_FROM, AS_OF)


@register("first_plus_last_n", oracle=_IVG + """
, ranked AS (SELECT *, row_number() OVER (ORDER BY date) AS a, row_number() OVER (ORDER BY date DESC) AS d,
                    count(*) OVER () AS n FROM monthly)
SELECT date, portfolio_value, cumulative_inflows, growth FROM ranked WHERE n <= 24 OR a = 1 OR d <= 23""")
def first_plus_last_n(p):
    return DV.first_plus_last_n(p.inflows_monthly(SERIES_FROM, AS_OF))


@register("period_growth", oracle=_IVG + """
SELECT round(arg_max(cumulative_inflows, date) - arg_min(cumulative_inflows, date), 2) AS period_inflows,
       round((arg_max(portfolio_value, date) - arg_min(portfolio_value, date))
             - (arg_max(cumulative_inflows, date) - arg_min(cumulative_inflows, date)), 2) AS period_growth
FROM ivg""")
def period_growth(p):
    return p.period_growth(SERIES_FROM, AS_OF)


REBASED = f"""
, pr AS (
    SELECT month_end_date AS date, monthly_return AS r,
           exp(sum(CASE WHEN 1 + monthly_return > 0 THEN ln(1 + monthly_return) END)
               OVER (ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * 100 AS v
    FROM portfolio_returns_monthly WHERE account_name = '{ACCOUNT_A}' AND year_month >= '{REBASE_MONTH}'),
  rebased AS (
    SELECT '{ACCOUNT_A}' AS series, date, round(CASE WHEN r IS NOT NULL THEN v END, 6) AS value FROM pr
    UNION ALL
    SELECT index_id, month_end_date,
           round(month_end_level / first_value(month_end_level) OVER (PARTITION BY index_id ORDER BY year_month)
                 * 100, 6)
    FROM benchmark_returns_monthly WHERE index_id IN ({_in(INDICES)}) AND year_month >= '{REBASE_MONTH}'
    UNION ALL
    SELECT s, CAST(DATE '{REBASE_MONTH}-01' - INTERVAL 1 DAY AS DATE), 100.0
    FROM (SELECT unnest([{_in([ACCOUNT_A, *INDICES])}]) AS s))"""
REBASE_DAY = f"CAST(DATE '{REBASE_MONTH}-01' - INTERVAL 1 DAY AS DATE)"


@register("isa_vs_index_rebased", oracle=REBASED + "\nSELECT * FROM rebased")
def isa_vs_index_rebased(p):
    return p.rebased_comparison(ACCOUNT_A, REBASE_MONTH, INDICES)


@register("monthly_summary", oracle="""
, chained AS (
    SELECT *, lag(month_end_value_gbp) OVER (PARTITION BY account_name ORDER BY year_month) AS opening
    FROM portfolio_snapshot_monthly),
  newest AS (
    SELECT account_name, month_end_date, month_end_value_gbp, opening AS prev_month_end_value_gbp, monthly_inflows_gbp,
           round((month_end_value_gbp - opening - monthly_inflows_gbp) / nullif(opening + 0.5 * monthly_inflows_gbp, 0), 6)
             AS monthly_return
    FROM chained QUALIFY month_end_date = max(month_end_date) OVER ()),
  pooled AS (
    SELECT max(month_end_date) AS day, sum(month_end_value_gbp) AS closing, nullif(sum(prev_month_end_value_gbp), 0) AS opening,
           sum(monthly_inflows_gbp) AS flow FROM newest)
SELECT * FROM newest
UNION ALL
SELECT 'TOTAL', day, round(closing, 2), round(opening, 2), round(flow, 2),
       round((closing - opening - flow) / nullif(opening + 0.5 * flow, 0), 6)
FROM pooled""")
def monthly_summary(p):
    return p.monthly_summary()


@register("snapshot_left_returns", oracle="""
, chained AS (
    SELECT *, lag(month_end_value_gbp) OVER (PARTITION BY account_name, fund_name ORDER BY year_month) AS opening
    FROM fund_snapshot_monthly)
SELECT account_name, fund_name, fund_short_name, month_end_value_gbp,
       round((month_end_value_gbp - opening - monthly_net_fund_flows_gbp)
             / nullif(opening + 0.5 * monthly_net_fund_flows_gbp, 0), 6) AS monthly_return
FROM chained QUALIFY month_end_date = max(month_end_date) OVER ()""")
def snapshot_left_returns(p):
    return p.fund_summary()


@register("fy_end_return_table", oracle=f"""
SELECT 'Mar-' || strftime(month_end_date, '%y') AS fy_end, month_end_date AS fy_end_date,
       {sql_dround(f"max(CASE WHEN account_name = '{ACCOUNT_A}' THEN trailing_12m_return END) * 100", 1)} AS a0_1yr,
       {sql_dround(f"max(CASE WHEN account_name = '{ACCOUNT_A}' THEN trailing_36m_return_annualised END) * 100", 1)} AS a0_3yr_pa,
       {sql_dround(f"max(CASE WHEN account_name = '{ACCOUNT_B}' THEN trailing_12m_return END) * 100", 1)} AS a1_1yr,
       {sql_dround(f"max(CASE WHEN account_name = '{ACCOUNT_B}' THEN trailing_36m_return_annualised END) * 100", 1)} AS a1_3yr_pa
FROM portfolio_returns_monthly
WHERE month(month_end_date) = 3 AND account_name IN ('{ACCOUNT_A}', '{ACCOUNT_B}')
GROUP BY 1, 2""")
def fy_end_return_table(p):
    return p.fy_end_return_table([ACCOUNT_A, ACCOUNT_B])


@register("fund_value_history", oracle=f"""
, cut AS (SELECT max(date) AS d FROM holdings_daily WHERE date <= DATE '{CUTOFF}'),
  held AS (SELECT DISTINCT fund_key FROM holdings_daily
           WHERE date = (SELECT d FROM cut) AND holding_type = 'Fund' AND value_gbp > 1)
SELECT h.date, df.fund_name, round(sum(h.value_gbp), 2) AS value_gbp
FROM holdings_daily h JOIN dim_fund df ON df.fund_key = h.fund_key
WHERE h.date BETWEEN DATE '{HIST_FROM}' AND DATE '{HIST_TO}' AND h.holding_type = 'Fund'
  AND h.fund_key IN (SELECT fund_key FROM held)
GROUP BY 1, 2""")
def fund_value_history(p):
    return p.fund_value_history(CUTOFF, HIST_FROM, HIST_TO)


@register("list_funds", oracle="""
SELECT fund_id, fund_name, fund_short_name, morningstar_code, first_investment_date, investment_status_indicator,
       investment_status_indicator = 'Holding' AS is_active
FROM dim_fund WHERE fund_id <> 'CASH'""")
def list_funds(p):
    return p.list_funds()


@register("fy_range_filter", oracle=f"""
SELECT financial_year,
       round(sum(CASE WHEN account_name = '{ACCOUNT_A}' THEN contributions_gbp ELSE 0 END), 2) AS {ACCOUNT_A.lower()}_gbp,
       round(sum(CASE WHEN account_name = '{ACCOUNT_B}' THEN contributions_gbp ELSE 0 END), 2) AS {ACCOUNT_B.lower()}_gbp,
       round(sum(contributions_gbp), 2) AS total_gbp
FROM contributions_by_fy WHERE financial_year BETWEEN '{FY_FROM}' AND '{FY_TO}' GROUP BY 1""")
def fy_range_filter(p):
    from ledgerline.functions.dates import fy_range_filter as fyr
    return fyr(p.contributions_fy_pivot([ACCOUNT_A, ACCOUNT_B]), FY_FROM, FY_TO)


@register("adhoc_select", oracle="""
SELECT account_name, holding_type, count(*) AS n, round(sum(value_gbp), 2) AS value_gbp
FROM holdings_latest GROUP BY account_name, holding_type""")
def adhoc_select(p):
    return p.adhoc_select(ADHOC_SQL, seconds=1_800)      # the marts behind the views are built within the statement here


@register("top_1", oracle="""
SELECT account_name, year_month, round(monthly_return, 6) AS monthly_return FROM portfolio_returns_monthly
WHERE monthly_return IS NOT NULL ORDER BY monthly_return DESC, account_name, year_month LIMIT 1""")
def top_1(p):
    r = p.portfolio_returns_monthly.filter(F.col("monthly_return").isNotNull())
    return (r.orderBy(F.col("monthly_return").desc(), "account_name", "year_month").limit(1)
            .select("account_name", "year_month", F.round("monthly_return", 6).alias("monthly_return")))


@register("sort_nulls_last_pinned", oracle="SELECT * FROM holdings_latest")
def sort_nulls_last_pinned(p):
    h = p.holdings_latest
    return h.orderBy((F.col("holding_type") == "Cash").asc(), F.col("unrealised_gain_pct").desc_nulls_last(),
                     F.col("fund_name").asc_nulls_last())


@register("mart_ordering", oracle="SELECT * FROM fund_snapshot_monthly")
def mart_ordering(p):
    return p.fund_snapshot_monthly.orderBy("account_name", "fund_name", "year_month")


@register("sort_conditional_key", oracle="""
SELECT account_name, holding_type, fund_name, value_gbp FROM holdings_latest""")
def sort_conditional_key(p):
    h = p.holdings_latest.select("account_name", "holding_type", "fund_name", "value_gbp")
    return h.orderBy(F.when(F.col("holding_type") == "Fund", 0).otherwise(1), F.col("value_gbp").desc(),
                     "account_name", "fund_name")


# ------------------------------------------------------------------ L1 streaming
@register("incremental_drop_folder", oracle=f"""
, faulted AS (SELECT *, transaction_type IN ('BUY', 'SELL', 'SWITCH_IN', 'SWITCH_OUT') AND reference LIKE '%7' AS bad
              FROM raw_transactions),
  ing AS (SELECT {SQL_ID} AS id, * FROM faulted WHERE NOT bad),
  ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY settle_date ASC NULLS FIRST,
                                   raw_description ASC NULLS FIRST, quantity ASC NULLS FIRST) AS rn FROM ing)
          WHERE rn = 1),
  lost AS (SELECT count(*) FILTER (WHERE bad AND trade_date < DATE '1999-01-01') + count(*) FILTER (WHERE bad) AS n_rejected
           FROM faulted)
SELECT {TX_COLS}, n_rejected FROM ded, lost""")
def incremental_drop_folder(p):
    """Two overlapping drops arriving one after the other (trades before 1999, then everything),
    each picked up by an availableNow run of the same stream (same checkpoint): the second run
    sees only the new files and appends only ids the target does not hold yet. Trades whose reference
    ends in 7 have no readable value: they are rejected, once in each drop."""
    from ledgerline.streaming.drop_folder import read_report, read_target, start_drop_folder_ingest
    spark = p.spark
    drop = B.scratch_path(spark, "drop")
    target = B.scratch_path(spark, "drop-target")
    ckpt = B.scratch_path(spark, "drop-ckpt")
    bad = F.col("transaction_type").isin(*B.TRADE_TYPES) & F.col("reference").endswith("7")
    t = p.raw.transactions.withColumn("value_gbp", F.when(~bad, F.col("value_gbp")))
    B.write_broker_csv(t.filter(F.col("trade_date") < F.lit("1999-01-01").cast("date")), drop + "/run1")
    start_drop_folder_ingest(spark, drop, target, ckpt, p.raw.funds, accounts=p.raw.accounts).awaitTermination()
    B.write_broker_csv(t, drop + "/run2")
    start_drop_folder_ingest(spark, drop, target, ckpt, p.raw.funds, accounts=p.raw.accounts).awaitTermination()
    lost = read_report(spark, target, "counts").filter(F.col("source_file") == "TOTAL").agg(F.sum("rejected")).scalar()
    return read_target(spark, target).select(*[c.strip() for c in TX_COLS.split(",")], lost.alias("n_rejected"))


# ------------------------------------------------------------------ daily model build (A20, entry 1)
_REFRESH_COUNTS = [("fct_holdings_daily", "holdings_daily"), ("mart_portfolio_value_daily", "portfolio_value_daily"),
                   ("mart_portfolio_inflows_daily", "portfolio_inflows_daily"),
                   ("mart_portfolio_snapshot_monthly", "portfolio_snapshot_monthly"),
                   ("mart_fund_snapshot_monthly", "fund_snapshot_monthly"),
                   ("mart_portfolio_returns_monthly", "portfolio_returns_monthly"),
                   ("mart_fund_returns_monthly", "fund_returns_monthly"),
                   ("mart_benchmarks_monthly", "benchmark_returns_monthly"),
                   ("mart_holdings_latest", "holdings_latest"),
                   ("mart_contributions_by_financial_year", "contributions_by_fy")]


@register("daily_refresh", oracle="\n".join(
    ["SELECT * FROM ("] +
    ["\nUNION ALL ".join(f"SELECT '{name}' AS model, count(*) AS row_count FROM {cte}" for name, cte in _REFRESH_COUNTS)] +
    [")"]))
def daily_refresh(p):
    from ledgerline.plans.refresh import daily_refresh as run
    return run(p)


@register("incremental_refresh", oracle="""
SELECT 'value' AS mart, account_name, CAST(valuation_date AS VARCHAR) AS period, portfolio_value_gbp AS value_gbp FROM portfolio_value_daily
UNION ALL
SELECT 'snapshot', account_name, year_month, month_end_value_gbp FROM portfolio_snapshot_monthly""")
def incremental_refresh(p):
    """Two refreshes: all but the late trades land first; a second batch brings those of the last year, and only the months
    from the first of them on are rebuilt."""
    from ledgerline.plans.incremental import SNAPSHOT, VALUES, Landing, MartStore
    root = B.scratch_path(p.spark, "refreshed")
    landing, store = Landing(p.spark, f"{root}/landed"), MartStore(p.spark, f"{root}/marts")
    t = p.raw.transactions
    late = (F.col("trade_date") >= F.add_months(p.as_of_col, -12)) & F.col("reference").endswith("3")
    landing.land("prices", p.raw.prices)
    landing.land("transactions", t.filter(~late))
    calendar = {"calendar_start": p.cal_start, "calendar_end": p.cal_end}
    store.refresh(landing, p.raw, p.as_of, **calendar)
    landing.land("transactions", t.filter(late))
    store.refresh(landing, p.raw, p.as_of, **calendar)
    return (store.read(VALUES).select(F.lit("value").alias("mart"), "account_name", F.col("valuation_date").cast("string").alias("period"),
                                      F.col("portfolio_value_gbp").alias("value_gbp"))
            .unionByName(store.read(SNAPSHOT).select(F.lit("snapshot").alias("mart"), "account_name", F.col("year_month").alias("period"),
                                                     F.col("month_end_value_gbp").alias("value_gbp"))))

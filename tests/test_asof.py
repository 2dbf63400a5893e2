"""As-of operators against brute force on small hand-built frames."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline.operators.asof import asof_join, explode_month_ends, forward_fill, step_intervals

D = dt.date


def brute_asof(left, right, how):
    out = []
    for k, t, lid in left:
        cands = [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
        if cands:
            out.append((k, t, lid, max(cands)[1]))
        elif how == "left":
            out.append((k, t, lid, None))
    return sorted(out, key=lambda r: (r[0], r[1], r[2]))


def _rand(seed, n_left=300, n_right=200, keys=("a", "b", "hot")):
    rnd = random.Random(seed)
    base = D(2020, 1, 1)
    # the hot key holds most rows (skew)
    pick = lambda: rnd.choices(keys, weights=[1, 1, 6])[0]
    left = [(pick(), base + dt.timedelta(days=rnd.randrange(400)), i) for i in range(n_left)]
    seen, right = set(), []
    while len(right) < n_right:
        k, t = pick(), base + dt.timedelta(days=rnd.randrange(400))
        if (k, t) not in seen:
            seen.add((k, t))
            right.append((k, t, float(rnd.randrange(1000))))
    return left, right


def test_asof_join_matches_brute_force_both_forms(spark):
    left, right = _rand(7)
    L = spark.createDataFrame(left, "k string, t date, lid int")
    R = spark.createDataFrame(right, "k string, rt date, v double")
    month = lambda c: F.year(c) * 12 + F.month(c)
    for how in ("left", "inner"):
        want = brute_asof(left, right, how)
        for bucket in (None, month):
            got = asof_join(L, R, ["k"], "t", "rt", ["v"], how=how, bucket=bucket).collect()
            got = sorted([(r.k, r.t, r.lid, r.v) for r in got], key=lambda r: (r[0], r[1], r[2]))
            assert got == want, (how, bucket)


def test_asof_payload_null_inside_match_is_carried(spark):
    L = spark.createDataFrame([("a", D(2020, 1, 5))], "k string, t date")
    R = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 3), None)], "k string, rt date, v double")
    got = asof_join(L, R, ["k"], "t", "rt", ["rt", "v"]).collect()[0]
    # the latest right row (1/3) wins even though its value is null
    assert got.rt == D(2020, 1, 3) and got.v is None


def test_step_intervals_and_forward_fill(spark):
    steps = spark.createDataFrame(
        [("a", D(2020, 1, 1), 10.0), ("a", D(2020, 1, 4), 0.00005), ("a", D(2020, 1, 6), 3.0),
         ("a", D(2020, 2, 1), 1.0)],
        "k string, at date, units double")
    iv = step_intervals(steps, ["k"], "at", "2020-01-08").orderBy("at").collect()
    assert [(r.at, r.valid_to) for r in iv] == [
        (D(2020, 1, 1), D(2020, 1, 3)), (D(2020, 1, 4), D(2020, 1, 5)), (D(2020, 1, 6), D(2020, 1, 8))]
    # closed (0.00005 <= threshold) interval never materialises; re-opened position does
    days = forward_fill(steps, ["k"], "at", "2020-01-08", "day", min_value=("units", 0.0001)).collect()
    assert sorted(r.date.day for r in days) == [1, 2, 3, 6, 7, 8]
    assert {r.date: r.units for r in days}[D(2020, 1, 7)] == 3.0


def test_month_end_explode(spark):
    df = spark.createDataFrame([(D(2020, 1, 15), D(2020, 4, 29)), (D(2020, 2, 1), D(2020, 2, 28)),
                                (D(2020, 3, 31), D(2020, 3, 31))], "s date, e date")
    got = {(r.s, r.date) for r in explode_month_ends(df, "s", "e").collect()}
    assert got == {(D(2020, 1, 15), D(2020, 1, 31)), (D(2020, 1, 15), D(2020, 2, 29)),
                   (D(2020, 1, 15), D(2020, 3, 31)), (D(2020, 3, 31), D(2020, 3, 31))}


def test_trade_before_first_price_is_dropped(spark):
    """Inner as-of: days before a fund's first price vanish (reference semantics)."""
    from tests.conftest import seeded_portfolio
    units = spark.createDataFrame(
        [("A1", "ISA", "F1", "FUND_A", D(2024, 1, 1), 10.0)],
        "account_key string, account_name string, fund_key string, fund_id string, trade_date date, units_held double")
    prices = spark.createDataFrame([("F1", D(2024, 1, 3), 2.0)], "fund_key string, price_date date, fund_price_gbp double")
    p = seeded_portfolio(spark, as_of="2024-01-05", unit_steps=units, price_steps=prices)
    rows = p.fund_values_daily.orderBy("date").collect()
    assert [r.date for r in rows] == [D(2024, 1, 3), D(2024, 1, 4), D(2024, 1, 5)]
    assert all(r.value_gbp == 20.0 for r in rows)


def test_price_join_carries_no_hint_and_one_fund_is_filtered_below_the_windows(spark):
    from tests.conftest import SMOKE_DIR
    from ledgerline.plans.catalog import build
    p = build(spark, SMOKE_DIR)
    whole = p._fund_values("month")
    assert "ResolvedHint" not in whole._jdf.queryExecution().analyzed().toString()
    fund = whole.select("fund_id").orderBy("fund_id").first().fund_id
    cols = ["date_key", "account_key", "fund_key", "units_held", "fund_price_gbp", "value_gbp"]
    one = p._fund_values("month", fund_id=fund)
    assert sorted(tuple(r) for r in one.select(*cols).collect()) == \
        sorted(tuple(r) for r in whole.filter(F.col("fund_id") == fund).select(*cols).collect())
    # in the optimized plan the fund's filter stands below the windows: none is left between them and the root
    tree = one._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, x in enumerate(tree) if "Window [" in x]
    filters = [i for i, x in enumerate(tree) if "Filter" in x and fund in x]
    assert at and filters and not any(i < min(at) for i in filters)


def test_point_in_time_positions_equal_dense_holdings(spark):
    """Reading the interval that contains a day gives exactly the dense table's rows for that day."""
    from tests.conftest import SMOKE_DIR
    from ledgerline.plans.portfolio import Portfolio
    p = Portfolio.from_testdata(spark, SMOKE_DIR)
    cols = ["account_key", "fund_key", "holding_type", "units_held", "fund_price_gbp"]
    for day in ("1997-06-30", "2000-02-29", "2001-08-31"):
        d = F.lit(day).cast("date")
        sparse = p.positions_at(d).select(*cols, F.round("value_gbp", 2).alias("v"))
        dense = p.holdings_daily.filter(F.col("date") == d).select(*cols, F.round("value_gbp", 2).alias("v"))
        key = lambda t: tuple("" if x is None else str(x) for x in t)  # noqa: E731 (cash rows hold nulls)
        a = sorted((tuple(r) for r in sparse.collect()), key=key)
        b = sorted((tuple(r) for r in dense.collect()), key=key)
        assert a == b and len(a) > 0, day

"""Data-quality checks (J1-J6), the drop-folder stream (L1) and the driver contract."""

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import quality as Q
from tests.compare import TABLES, compare
from tests.conftest import SMOKE_DIR
from tests.test_ingest import _funds, _landing


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a", "X"), (1, None, "Y"), (2, "b", "Z"), (None, None, "X")],
                               "k int, name string, kind string")
    parent = spark.createDataFrame([(1,)], "k int")
    rep = {(r.check_name, r.column_name): r.failures for r in Q.dq_report([
        Q.assert_not_null(df, "t", ["k", "name"]),
        Q.assert_unique(df, "t", ["k"]),
        Q.assert_unique(df, "t", ["k", "name"]),
        Q.assert_accepted_values(df, "t", "kind", ["X", "Y"]),
        Q.assert_relationship(df, "t", "k", parent, "k"),
        Q.assert_expression(df, "t", "k < 2", F.col("k") < 2, where=F.col("kind") == "X"),
    ]).collect()}
    assert rep == {("not_null", "k"): 1, ("not_null", "name"): 2, ("unique", "k"): 1,
                   ("unique_combination", "k,name"): 0, ("accepted_values", "kind"): 1,
                   ("relationships", "k"): 1, ("expression_is_true", "k < 2"): 1}


def test_drop_folder_stream_is_idempotent(spark):
    from ledgerline.streaming.drop_folder import read_report, read_target, start_drop_folder_ingest
    drop = _landing()
    target = tempfile.mkdtemp(prefix="target-") + "/tx"
    ckpt = tempfile.mkdtemp(prefix="ckpt-")
    start_drop_folder_ingest(spark, drop, target, ckpt, _funds(spark)).awaitTermination()
    assert read_target(spark, target).count() == 5
    # the same files again (a replayed drop) under a new name: nothing is appended twice
    os.makedirs(f"{drop}/ISA2", exist_ok=True)
    with open(f"{drop}/ISA/ISA_2024-03-01.csv", "rb") as src, open(f"{drop}/ISA2/ISA.csv", "wb") as dst:
        dst.write(src.read())
    start_drop_folder_ingest(spark, drop, target, ckpt, _funds(spark)).awaitTermination()
    ids = [r.id for r in read_target(spark, target).collect()]
    rejected = read_report(spark, target, "rejects").filter("severity = 'rejected'")
    assert sorted(r.reject_reason for r in rejected.collect()) == ["unparseable value"] * 2     # one in each drop
    counts = {(r.batch, r.source_file.split("/")[-2]): (r.processed, r.inserted, r.skipped, r.rejected)
              for r in read_report(spark, target, "counts").filter("source_file <> 'TOTAL'").collect()}
    assert counts == {(0, "ISA"): (5, 3, 1, 1), (0, "SIPP"): (2, 2, 0, 0), (1, "ISA2"): (5, 3, 1, 1)}
    audit = sorted((r.run, r.rows_inserted, r.status) for r in read_report(spark, target, "audit").collect())
    assert audit == [(0, 5, "success"), (1, 3, "success")]
    # ISA2 is a different account folder, so its rows hash to new ids; ISA's do not repeat
    assert len(ids) == len(set(ids)) == 5 + 3


def _facts(spark, target):
    from ledgerline.streaming.drop_folder import read_report, read_target
    rows = read_target(spark, target)
    return (sorted(map(str, rows.collect())) if rows is not None else None,
            sorted(str(r) for r in read_report(spark, target, "counts").withColumn("source_file", F.regexp_extract("source_file", "[^/]*$", 0)).collect()),
            sorted((r.run, r.rows_inserted, r.status) for r in read_report(spark, target, "audit").collect()))


@pytest.mark.parametrize("fails", ["before the rows", "half-way through the rows", "before the commit", "after the commit"])
def test_replayed_batches_come_out_the_same(spark, monkeypatch, fails):
    """A batch that dies anywhere around its append, and is replayed: same rows, same counts, same audit."""
    from ledgerline.sources import commits
    from ledgerline.streaming import drop_folder as D

    def run(drop, target, ckpt):
        D.start_drop_folder_ingest(spark, drop, target, ckpt, _funds(spark)).awaitTermination()

    drop = _landing()
    dirs = {k: (tempfile.mkdtemp(prefix="target-") + "/tx", tempfile.mkdtemp(prefix="ckpt-")) for k in ("plain", "torn")}
    for target, ckpt in dirs.values():
        run(drop, target, ckpt)
    os.makedirs(f"{drop}/ISA2", exist_ok=True)
    with open(f"{drop}/ISA/ISA_2024-03-01.csv", "rb") as src, open(f"{drop}/ISA/again.csv", "wb") as a, \
            open(f"{drop}/ISA2/ISA.csv", "wb") as b:
        text = src.read()
        a.write(text)
        b.write(text)
    run(drop, *dirs["plain"])
    before = _facts(spark, dirs["torn"][0])
    with monkeypatch.context() as m:
        def die(*args, **kw):
            raise OSError("the driver is gone")

        if fails == "before the rows":
            m.setattr(D, "write_observed", die)
        elif fails == "half-way through the rows":
            real = D.write_observed

            def torn(df, path, *args, **kw):
                out = real(df, path, *args, **kw)
                if "batch=" in path:
                    spark.read.parquet(path).limit(1).write.mode("append").partitionBy(D.PARTITION_COL).parquet(path)
                    die()
                return out
            m.setattr(D, "write_observed", torn)
        elif fails == "before the commit":
            m.setattr(commits.BatchTable, "commit", die)
        else:
            real_commit = commits.BatchTable.commit

            def late(self, *args, **kw):
                real_commit(self, *args, **kw)
                die()
            m.setattr(commits.BatchTable, "commit", late)
        with pytest.raises(Exception, match="the driver is gone"):
            run(drop, *dirs["torn"])
    if fails != "after the commit":
        assert _facts(spark, dirs["torn"][0])[:2] == before[:2]            # nothing of the dead batch shows
    run(drop, *dirs["torn"])
    assert _facts(spark, dirs["torn"][0]) == _facts(spark, dirs["plain"][0])


def test_batch_tables_compact(spark):
    from ledgerline.sources.commits import BatchTable
    table = BatchTable(spark, tempfile.mkdtemp(prefix="table-") + "/t")
    assert table.read() is None and table.compact() is None
    for k in range(4):
        spark.createDataFrame([(k, "a"), (10 + k, "b")], "x int, month string").write.partitionBy("month").parquet(table.folder(k))
        if k != 2:
            table.commit(k, rows=2)
    want = sorted([0, 1, 3, 10, 11, 13])
    assert sorted(r.x for r in table.read().collect()) == want and sorted(r.x for r in table.read(before=3).collect()) == [0, 1, 10, 11]
    assert table.compact("month") == 3
    spark.createDataFrame([(7, "c")], "x int, month string").write.partitionBy("month").parquet(table.folder(4))
    table.commit(4, rows=1)
    assert sorted(r.x for r in BatchTable(spark, table.root).read().collect()) == sorted([*want, 7])


def test_drop_folder_failure_is_audited(spark):
    from ledgerline.streaming.drop_folder import start_drop_folder_ingest
    target = tempfile.mkdtemp(prefix="target-") + "/tx"
    bad = spark.createDataFrame([("x",)], "unexpected string")
    query = start_drop_folder_ingest(spark, _landing(), target, tempfile.mkdtemp(prefix="ckpt-"), bad)
    with pytest.raises(Exception):
        query.awaitTermination()
    row = spark.read.parquet(f"{target}-report/audit").first()
    assert (row.status, row.rows_inserted) == ("failure", 0) and row.detail


def test_declared_checks_cover_every_model():
    from ledgerline.plans.declared_checks import DECLARED, n_checks
    assert n_checks() == 175 and len({c.table for c in DECLARED}) == len(DECLARED) == 28


def test_adhoc_select_reads_views_only(spark, tmp_path):
    import __spark_entry__ as E  # noqa: F401
    from ledgerline.plans.catalog import build
    p = build(spark, SMOKE_DIR)
    assert p.adhoc_select("SELECT account_name, max(value_gbp) m FROM mart_holdings_latest GROUP BY 1").count() > 0
    assert p.adhoc_select("WITH a AS (SELECT * FROM dim_fund) SELECT count(*) FROM a WHERE fund_id IN "
                          "(SELECT fund_id FROM dim_fund)").count() == 1
    for sql in (f"WITH a AS (SELECT 1 x) INSERT OVERWRITE DIRECTORY '{tmp_path}/o' USING parquet SELECT * FROM a",
                f"SELECT count(*) FROM parquet.`{SMOKE_DIR}/orders.parquet`", "DROP VIEW dim_fund", "",
                f"SELECT 1 WHERE EXISTS (SELECT 1 FROM parquet.`{SMOKE_DIR}/orders.parquet`)",
                "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT * FROM no_such_view", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            p.adhoc_select(sql)
    assert not (tmp_path / "o").exists()


def test_adhoc_statements_are_checked_by_their_parsed_plan(spark):
    from ledgerline.plans.adhoc import check_statement
    views = ["dim_fund", "dim_date"]
    spark.range(3).createOrReplaceTempView("hidden")
    many = ", ".join(f"{k} c{k}" for k in range(40))
    call = "reflect('java.lang.System', 'getProperty', 'user.home')"
    for sql in (f"SELECT {many}, {call} FROM dim_fund",                               # behind a list too long to print
                "SELECT 'CTE [hidden]' a, id FROM hidden",                            # a literal is no WITH name
                "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden, dim_fund",
                "WITH a AS (SELECT * FROM b), b AS (SELECT 1 x) SELECT * FROM a, dim_fund",
                "SELECT * FROM dim_fund WHERE fund_id IN (WITH x AS (SELECT 1 y) SELECT y FROM x) AND EXISTS (SELECT 1 FROM x)",
                f"SELECT sum(1) OVER w FROM dim_fund WINDOW w AS (PARTITION BY {call})",
                f"SELECT * FROM dim_fund ORDER BY {call}", f"SELECT count(*) FROM dim_fund GROUP BY GROUPING SETS (({call}))",
                f"SELECT transform(array(1), x -> {call}) FROM dim_fund", f"SELECT * FROM dim_fund, LATERAL (SELECT {call})",
                f"SELECT max(fund_id) FILTER (WHERE {call} = 'x') FROM dim_fund", "SELECT JAVA_METHOD('a', 'b') FROM dim_fund",
                "SELECT * FROM dim_fund PIVOT (max(reflect('a', 'b')) FOR fund_id IN ('x'))",
                "SELECT * FROM IDENTIFIER('hid' || 'den'), dim_fund", "SELECT IDENTIFIER('refl' || 'ect')('a', 'b') FROM dim_fund",
                "SELECT * FROM dim_fund, range(10)", "SELECT TRANSFORM(fund_id) USING 'cat' FROM dim_fund",
                "SELECT my_own(fund_id) FROM dim_fund", "SELECT spark_catalog.default.f(1) FROM dim_fund",
                "SELECT 1", "VALUES (1)", "CREATE VIEW v AS SELECT * FROM dim_fund", "EXPLAIN SELECT * FROM dim_fund",
                "SELECT * FROM csv.`/etc/passwd`, dim_fund", "SELECT * FROM default.dim_fund", "SET x = 1", "SHOW TABLES"):
        with pytest.raises(ValueError):
            check_statement(spark, sql, views)
    for sql, names in {
            "SELECT f.*, row_number() OVER (PARTITION BY fund_id ORDER BY 1) FROM dim_fund f": {"dim_fund"},
            "WITH a AS (SELECT * FROM dim_fund), b AS (SELECT * FROM a) SELECT 'reflect(x)' FROM b JOIN dim_date ON true": set(views),
            "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r, dim_fund": {"dim_fund"},
            "SELECT count(DISTINCT x) FROM (VALUES (1), (2)) AS t(x) WHERE x IN (SELECT 1 FROM dim_fund)": {"dim_fund"},
            f"SELECT {many} FROM dim_fund HAVING max(fund_id) > 'x' LIMIT 3": {"dim_fund"}}.items():
        assert check_statement(spark, sql, views) == names, sql


def test_adhoc_statements_are_stopped(spark):
    import time

    from ledgerline.plans.adhoc import answer
    spark.range(0, 400_000_000_000, 1, 40_000).createOrReplaceTempView("many_rows")
    slow = spark.sql("SELECT sum(sqrt(id)) FROM many_rows")
    began = time.time()
    with pytest.raises(TimeoutError):
        answer(slow, seconds=2)
    assert time.time() - began < 20
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []
    assert answer(spark.range(500), rows=200).count() == 200
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        answer(spark.sql("SELECT 1 / 0"))


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "total_value_gbp" in df.columns


def test_every_query_has_an_oracle_or_is_listed(spark):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 90


SUBSET = ["calendar_seed", "dim_fund_lifecycle", "fct_transactions", "asof_inner_join", "asof_left_join",
          "portfolio_snapshot_monthly", "portfolio_returns_monthly", "benchmark_returns_monthly",
          "holdings_latest", "portfolio_inflows_daily", "portfolio_performance_index", "q05_best_gain_pct",
          "q09_sharpe_vs_index", "ingest_transactions", "dq_report", "numeric_accuracy", "calendar_year_returns"]


def _names():
    if os.environ.get("LEDGERLINE_FULL"):       # every query with an oracle (slow: about 5 minutes)
        import __spark_entry__ as E
        return sorted(E.oracle_sql())
    return SUBSET


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle_on_smoke_data(spark, name):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    ok, msg = compare(E.queries()[name](spark, SMOKE_DIR).toPandas(), con.execute(E.oracle_sql()[name]).fetchdf())
    assert ok, msg


def test_grouped_checks_equal_standalone_checks(spark):
    df = spark.createDataFrame([(1, "X", 10, "a"), (1, "Q", 11, "a"), (2, "X", 99, None), (3, None, None, "b"), (None, "Y", 10, "c"),
                                (None, "Y", 98, "c"), (4, "X", 98, "c")], "k int, kind string, p int, _n string")
    parent, other = spark.createDataFrame([(10,), (11,), (None,)], "p int"), spark.createDataFrame([("a",), ("b",)], "name string")
    where = F.col("kind") != "Y"
    expr, cond = F.col("p") < 50, F.col("k").isNotNull()
    one_pass = sorted(tuple(r) for r in Q.grouped_checks(
        df, "t", ["k", "p"], {"kind": ["X", "Y"]}, [("small", expr, cond)], [["k"], ["k", "kind"], ["_n"]],
        [("relationships", "p", parent, "p", where), ("accepted_values", "_n", other, "name", None)]).collect())
    separate = sorted(tuple(r) for r in Q.dq_report([
        Q.assert_not_null(df, "t", ["k", "p"]), Q.assert_accepted_values(df, "t", "kind", ["X", "Y"]),
        Q.assert_expression(df, "t", "small", expr, cond),
        Q.assert_unique(df, "t", ["k"]), Q.assert_unique(df, "t", ["k", "kind"]), Q.assert_unique(df, "t", ["_n"]),
        Q.assert_relationship(df, "t", "p", parent, "p", where),
        Q.assert_relationship(df, "t", "_n", other, "name").withColumn("check_name", F.lit("accepted_values"))]).collect())
    assert one_pass == separate and len(one_pass) == 9
    none = df.filter("false")
    assert {r.failures for r in Q.grouped_checks(none, "t", ["k"], unique=[["k"]], related=[("relationships", "p", parent, "p", None)]).collect()} == {0}


def test_checks_scan_a_table_once(spark, tmp_path):
    """One scan and one exchange of the table, whatever the number of its keys and relations."""
    spark.createDataFrame([(1, 2, "a")], "k int, p int, name string").write.parquet(f"{tmp_path}/t")
    df, parent = spark.read.parquet(f"{tmp_path}/t"), spark.createDataFrame([(2,)], "p int")
    report = Q.grouped_checks(df, "t", ["k"], unique=[["k"], ["k", "p"], ["name"]],
                              related=[("relationships", "p", parent, "p", None), ("relationships", "k", parent, "p", None)])
    plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan parquet") == 1 and plan.count("Expand ") == 1


def test_a_kind_of_check_builds_no_marts(spark, monkeypatch):
    from ledgerline.plans import refresh
    from ledgerline.plans.catalog import build
    from ledgerline.plans.declared_checks import run_declared
    monkeypatch.setattr(refresh, "refresh_tables", lambda *_: pytest.fail("builds all marts"))
    p = build(spark, SMOKE_DIR)
    before = set(p.materialised)
    kinds = {r.check_name for r in run_declared(p, "expression_is_true").collect()}
    assert kinds == {"expression_is_true"} and p.materialised == before

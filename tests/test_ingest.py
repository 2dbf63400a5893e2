"""Broker CSV ingestion on hand-written files (A1, A2, A10, A14, A15, A17), fund reference."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from ledgerline.sources import broker_csv as B
from ledgerline.sources import feeds as FD
from ledgerline.sources import writers as W

META = "Portfolio summary\nClient name,Someone\nClient number,123\nValuation date,01/03/2024\n\n"
HEADER = "Trade date,Settle date,Reference,Description,Unit cost (p),Quantity,Value (£)\n"
# a second file with a different column order and header spelling
HEADER_B = "Reference,Trade Date,Value (GBP),Settle date,Description,Quantity,Unit cost (pence)\n"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="cp1252", newline="") as f:
        f.write(text)


def _landing():
    root = tempfile.mkdtemp(prefix="broker-")
    _write(f"{root}/ISA/ISA_2024-03-01.csv", META + HEADER +
           '02/01/2024,04/01/2024,B1001,Fund Alpha (GBP) 10 @ 100.00,"10,000.00",10,"-1,000.00"\n'
           '05/01/2024,,FPC,Card Web payment,n/a,n/a,"2,500.00"\n'
           '06/01/2024,08/01/2024,B1002,Unknown Fund (GBP) 1 @ 1,1.00,1,-1.00\n'
           '07/01/2024,,MANAGE FEE,Fee,n/a,n/a,n/a\n'
           '02/01/2024,04/01/2024,B1001,Fund Alpha (GBP) 10 @ 100.00,"10,000.00",10,"-1,000.00"\n')
    _write(f"{root}/SIPP/SIPP_2024-03-01.csv", META + HEADER_B +
           'S2001,15/02/2024,"1,050.50",19/02/2024,Fund  BETA (GBP) 5 @ 210.10,5,"21,010.00"\n'
           'URIB55,16/02/2024,0.42,,Rebate,n/a,n/a\n')
    return root


def _funds(spark):
    return spark.createDataFrame([("FUND_A", "Fund Alpha"), ("FUND_B", "fund beta")], "id string, name string")


def test_scan_parse_classify_match(spark):
    root = _landing()
    tx, rejects = B.ingest_transactions(B.scan_broker_csv(spark, root), _funds(spark))
    rows = {(r.account_id, r.reference): r for r in tx.collect()}
    assert len(rows) == 5 and tx.count() == 6            # the duplicated ISA line is kept until the append
    b = rows[("ISA", "B1001")]
    assert (b.trade_date, b.settle_date, b.value_gbp, b.quantity, b.fund_id, b.transaction_type) == \
        (dt.date(2024, 1, 2), dt.date(2024, 1, 4), -1000.0, 10.0, "FUND_A", "BUY")
    assert rows[("ISA", "FPC")].transaction_type == "CONTRIBUTION" and rows[("ISA", "FPC")].settle_date is None
    s = rows[("SIPP", "S2001")]     # reordered columns, '(GBP)' header, double space and case in the name
    assert (s.value_gbp, s.unit_cost_pence, s.fund_id, s.transaction_type) == (1050.5, 21010.0, "FUND_B", "SELL")
    assert rows[("SIPP", "URIB55")].transaction_type == "REBATE"
    reasons = sorted((r.reference, r.reject_reason) for r in rejects.collect())
    assert reasons == [("B1002", "unmatched fund"), ("MANAGE FEE", "unparseable value")]


def test_insert_or_ignore_is_idempotent_and_counts(spark):
    root = _landing()
    tx, _ = B.ingest_transactions(B.scan_broker_csv(spark, root), _funds(spark))
    tx = tx.drop("source_file")
    new1, t1 = W.insert_or_ignore(None, tx, ["id"])
    assert t1.count() == 5                               # two identical lines collapse to one
    new2, t2 = W.insert_or_ignore(t1, tx, ["id"])
    assert new2.count() == 0 and t2.count() == 5
    counts = {r.account_id: (r.processed, r.inserted, r.skipped)
              for r in B.ingest_counts(tx, new1, "account_id").collect()}
    assert counts == {"ISA": (4, 3, 1), "SIPP": (2, 2, 0), "TOTAL": (6, 5, 1)}


def test_counts_ride_on_the_write(spark):
    """One evaluation of the batch writes it and counts it."""
    seen = spark.sparkContext.accumulator(0)

    def passes(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    df = spark.range(1_000).mapInPandas(passes, "id long")
    out = tempfile.mkdtemp(prefix="observed-")
    back, got = W.write_observed(df, out, n=F.count(F.lit(1)), top=F.max("id"))
    assert got == {"n": 1000, "top": 999} and back.count() == 1000 and seen.value == 1000
    _, got = W.write_observed(df.filter("id < 0"), out, n=F.count(F.lit(1)))
    assert got == {"n": 0}


def test_every_line_is_counted(spark):
    """Odd shapes end up as transactions or rejects; processed = inserted + skipped + rejected for each file."""
    root = tempfile.mkdtemp(prefix="broker-")
    _write(f"{root}/ISA/odd.csv", META +
           "Trade date,Settle date,Reference,Description,Unit cost (p),Quantity,Currency,Value (£)\n"
           "02/02/2024,,FPC,,,,GBP,500.00\n"                                           # sparse
           "1/3/2024,,B1,\"Fund Alpha (GBP) \"\"A\"\" trade date, reference note\",1,1,GBP,-1.50\n"
           "2024-03-05,,FPC,x,,,GBP,1.00\n31/02/2024,,FPC,x,,,GBP,1.00\n,,FPC,x,,,GBP,1.00\n"
           "03/02/2024,zz,FPC,x,,,GBP,1.00\n03/02/2024,,FPC,x,,,GBP,oops\n03/02/2024,,FPC,x,abc,,GBP,1\n"
           "03/02/2024,,,no reference,,,GBP,2.00\n\n   \n,,,,,,,\n"
           "02/02/2024,,FPC,,,,GBP,500.00\n04/02/2024,,FPC,caf\u00e9 \u20ac5 \u2013 ok,,,GBP,1.004\n"
           "04/02/2024,,FPC,short row\n")
    _write(f"{root}/ISA/none.csv", "no header here\nat all\n")
    _write(f"{root}/Other/a.csv", META + HEADER + "02/02/2024,,FPC,x,,,1.00\n")
    accounts = spark.createDataFrame([("ISA",)], "id string")
    tx, rejects = B.ingest_transactions(B.scan_broker_csv(spark, root), _funds(spark), accounts)
    new, _ = W.insert_or_ignore(None, tx, ["id"])
    counts = {r.source_file.split("/")[-1]: (r.processed, r.inserted, r.skipped, r.rejected)
              for r in B.ingest_counts(tx, new, "source_file", rejects).collect()}
    assert counts == {"odd.csv": (13, 4, 1, 8), "none.csv": (2, 0, 0, 2), "a.csv": (1, 0, 0, 1), "TOTAL": (16, 4, 1, 11)}
    reasons = sorted(r.reject_reason for r in rejects.collect())
    assert reasons == sorted(["unparseable trade date"] * 3 + ["unparseable settle date", "unparseable unit cost"]
                             + ["unparseable value"] * 3 + ["no header line"] * 2 + ["unknown account"])
    got = {r.reference: r for r in new.collect() if r.reference != "FPC"}
    assert got["B1"].trade_date == dt.date(2024, 3, 1) and got["B1"].fund_id == "FUND_A"
    assert got["B1"].raw_description == 'Fund Alpha (GBP) "A" trade date, reference note'
    assert any(r.raw_description == "caf\u00e9 \u20ac5 \u2013 ok" and r.value_gbp == 1.004 for r in new.collect())
    assert all(r.raw_line for r in rejects.collect())


def test_salted_header_join_equals_broadcast(spark, monkeypatch):
    root = _landing()
    want = sorted(map(str, B.scan_broker_csv(spark, root).collect()))
    monkeypatch.setattr(B, "broadcast_if_small", lambda df: (df, False))
    assert sorted(map(str, B.scan_broker_csv(spark, root).collect())) == want


def test_transaction_id_equals_hashlib(spark):
    import hashlib
    import random
    rnd = random.Random(1)
    values = [0.0, 1.0, -1000.0, 0.1, 2.5, 1.001, 1.004, 1e15, 123456789012345.67, 1e16, 1.5e22, 1e-4, 0.00012, 9.9e-5, 1e-7,
              -2.2737367544323206e-13, 5e-324, 1.7976931348623157e308, 2e-3, 1e23, 100.0, 1e100]
    values += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 20) for _ in range(200)]
    rows = [("acc", dt.date(2024, 1, 2), ref, v) for v in values for ref in ("B1", None, "")]
    df = spark.createDataFrame(rows, "a string, d date, r string, v double")
    from ledgerline.functions.keys import transaction_id
    for r in df.select("*", transaction_id(F.col("a"), F.col("d"), F.col("r"), F.col("v")).alias("id")).collect():
        assert r.id == hashlib.md5(f"{r.a}|{r.d}|{r.r or ''}|{r.v}".encode()).hexdigest(), r.v


def test_materialise_keeps_earlier_tables(spark):
    one = W.materialise(spark.range(3), "same_name")
    two = W.materialise(spark.range(5), "same_name")
    assert (one.count(), two.count()) == (3, 5)


def test_upsert_replace_last_write_wins(spark):
    t = spark.createDataFrame([("A", "old"), ("B", "keep")], "id string, name string")
    b = spark.createDataFrame([("A", "new"), ("C", "add")], "id string, name string")
    assert sorted(tuple(r) for r in W.upsert_replace(t, b, ["id"]).collect()) == [("A", "new"), ("B", "keep"),
                                                                                  ("C", "add")]


def test_fund_reference_cleaning(spark):
    root = tempfile.mkdtemp(prefix="fundref-")
    with open(f"{root}/funds.csv", "w", encoding="utf-8-sig") as f:
        f.write("fund_ISIN,fund_code,fund_name,short_name\n"
                "GB0001,MS1,Fund Alpha,Alpha\n??,,Placeholder,\nNo_ISIN,MS3,  Beta & Gamma: Income (Acc) ,\n"
                ",,Not a fund,\n,MS5,Delta,D\n")
    got = sorted(tuple(r) for r in FD.clean_fund_reference(FD.read_fund_reference(spark, root)).collect())
    assert got == [("GB0001", "Fund Alpha", "GB0001", "MS1", "Alpha"),
                   ("beta_gamma_income_acc", "Beta & Gamma: Income (Acc)", None, "MS3", None),
                   ("delta", "Delta", None, "MS5", "D")]


def test_price_payload_normalisation(spark):
    ms = int(dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc).timestamp() * 1000)
    df = spark.createDataFrame([("F", f'[[{ms}, 1.2345], [null, 2], ["x"], [{ms + 86400000}, 2.5]]'),
                                ("G", '{"error": "nope"}')], "fund_id string, payload string")
    got = sorted((r.fund_id, r.date, r.price_pence) for r in FD.normalise_price_payload(df).collect())
    assert got == [("F", dt.date(2024, 1, 2), 123.45), ("F", dt.date(2024, 1, 3), 250.0)]


def test_price_days_do_not_depend_on_the_session_time_zone(spark):
    df = spark.createDataFrame([("F", "[[1704153600000, 1.0], [1704239999000, 2.0], [-1000, 3.0]]")], "fund_id string, payload string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Pacific/Auckland", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = sorted(str(r.date) for r in FD.normalise_price_payload(df).collect())
            assert got == ["1969-12-31", "2024-01-02", "2024-01-02"], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_account_from_partitioned_path(spark):
    df = spark.createDataFrame([("file:///x/account=Brand%252310/part-0.csv",), ("file:///x/ISA/a.csv",)], "p string")
    assert [r[0] for r in df.select(B.account_from_path(F.col("p"))).collect()] == ["Brand#10", "ISA"]


def test_dedupe_of_a_huge_copy_group_is_an_aggregate(spark):
    """A group of identical copies holding most rows collapses map-side (no window on the key)."""
    rows = [("dup", None, "x", 1.0)] * 5000 + [("dup", "2024-01-02", "a", 2.0)] + \
           [(f"id{i}", "2024-01-01", "y", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, settle_date string, raw_description string, quantity double")
    out = W.dedupe_first(df, ["id"], ["settle_date", "raw_description", "quantity"])
    got = {r.id: r for r in out.collect()}
    assert len(got) == 101 and got["dup"].settle_date is None       # nulls first, as in the old ordering
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def test_parsing_is_planned_once_whatever_is_filtered_behind_it(spark, tmp_path):
    folder = tmp_path / "ACC"
    folder.mkdir()
    (folder / "a.csv").write_text("Trade date,Reference,Description,Value\n"
                                  '01/02/2020,B1,Fund A (GBP) x,"1,000.50"\n01/02/2020,B2,Other (GBP) x,5\n01/02/2020,B3,Fund A (GBP) x,bad\n'
                                  "31/02/2020,B4,Fund A (GBP) x,5\n")
    funds = spark.createDataFrame([("F1", "Fund A")], "id string, name string")
    tx, rejects = B.ingest_transactions(B.scan_broker_csv(spark, str(tmp_path)), funds)
    for frame in (tx, rejects):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1, plan
    assert sorted((r.reference, r.fund_id, r.value_gbp) for r in tx.collect()) == [("B1", "F1", 1000.5), ("B2", None, 5.0)]
    assert sorted((r.reference, r.reject_reason, r.severity) for r in rejects.collect()) == [
        ("B2", "unmatched fund", B.WARNING), ("B3", "unparseable value", B.REJECTED), ("B4", "unparseable trade date", B.REJECTED)]


def test_windows_1252_characters_are_read_and_others_kept(spark, tmp_path):
    (tmp_path / "ACC").mkdir()
    (tmp_path / "ACC" / "a.csv").write_bytes(b"Trade date,Reference,Description,Value (\xa3)\n01/02/2020,B1,\x80 \x93q\x94 \xe9,5\n")
    assert [r.raw_description for r in B.parse_broker_rows(B.scan_broker_csv(spark, str(tmp_path))).collect()] == ["€ “q” \xe9"]


def test_splits_of_a_large_export_grow_with_it_and_its_partitions_are_not_sorted(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from ledgerline.plans import queries_ingest as Q
    p = SimpleNamespace(spark=spark)
    monkeypatch.setattr(Q.W, "folder_bytes", lambda *_: 10_000)
    assert Q._split_bytes(p, "x") == Q.SPLIT_BYTES
    monkeypatch.setattr(Q.W, "folder_bytes", lambda *_: 10 ** 9)
    assert 10 ** 9 / Q._split_bytes(p, "x") < 2 * Q.SPLITS
    with Q.W.open_writers(spark):
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == str(Q.W.OPEN_WRITERS)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"

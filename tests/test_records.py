"""CSV records over several lines against Python's csv module, with splits of a few lines (A1)."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import broker_csv as B
from ledgerline.sources import records as R

HEADER = "Trade date,Settle date,Reference,Description,Unit cost (p),Quantity,Value (£)\n"


@pytest.fixture
def tiny_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "300b"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="cp1252", newline="") as f:
        f.write(text)


def _random_csv(rnd, rows):
    cells = ["", "plain", 'say "hi"', "a,b", "two\nlines", "\n", 'x"\n"y', "1,234.00", 'in"ner', ' "led', '"', "three\n\nlines, all", "é"]
    out = io.StringIO()
    for _ in range(rows):
        row = [rnd.choice(cells) for _ in range(7)]
        if rnd.random() < 0.15:                     # as written by hand: quotes inside plain cells, text behind a closing quote
            out.write(",".join([rnd.choice(["pl", 'in"ner', '"q"tail', '"a""b"', '""', '"x, y"z"', ""]) for _ in range(7)]) + "\n")
        else:
            csv.writer(out, lineterminator="\n").writerow(row)
    return out.getvalue()


@pytest.mark.parametrize("seed", range(2))
def test_records_equal_python_csv(spark, tmp_path, tiny_splits, seed):
    rnd = random.Random(seed)
    want = {}
    for k in range(5):
        text = HEADER + _random_csv(rnd, 70 if k < 2 else rnd.choice([0, 3, 30]))
        _write(f"{tmp_path}/acc/{k}.csv", 'Client "quoted,\nValuation "date\n\n' + text)
        rows = list(csv.reader(io.StringIO(text, newline="")))[1:]
        want[f"{k}.csv"] = [r for r in rows if "".join(r).strip(" ") or len(r) > 1]
    lines = B.read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    rows = B.named_records(lines)
    assert rows.filter("unclosed").count() == 0
    got = rows.select(F.element_at(F.split("source_file", "/"), -1).alias("f"), F.array(*B.FIELDS).alias("cells")).collect()
    fields = ["trade_date", "settle_date", "reference", "description", "unit_cost", "quantity", "value"]
    order = [B.FIELDS.index(f) for f in fields]
    by = {f: [] for f in want}
    for r in got:
        by[r.f].append([r.cells[i] for i in order])
    for f, rows_ in want.items():
        pad = [(r + [None] * 7)[:7] for r in rows_]
        assert sorted(map(str, by[f])) == sorted(map(str, pad)), f


def test_open_cells_and_long_records_are_rejected_line_by_line(spark, tmp_path, tiny_splits):
    good = '02/02/2024,,FPC,"Card\npayment",,,1.00\n'
    _write(f"{tmp_path}/A/open.csv", HEADER + good + '03/02/2024,,FPC,"never closed,,,2.00\n04/02/2024,,FPC,x,,,3.00\n')
    _write(f"{tmp_path}/A/long.csv", HEADER + good + '03/02/2024,,FPC,"' + "long line\n" * 40 + '",,,2.00\n04/02/2024,,FPC,x,,,3.00\n')
    lines = B.read_lines(spark, str(tmp_path))
    headers = B.file_headers(lines)
    torn = R.stitched(lines.join(headers.select("source_file", "header_pos"), "source_file"), limit=200)
    by = {r.f: (r.n, r.bad) for r in torn.groupBy(F.element_at(F.split("source_file", "/"), -1).alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("unclosed").cast("int")).alias("bad")).collect()}
    assert by == {"open.csv": (4, 2), "long.csv": (44, 41)}
    tx, rejects = B.ingest_transactions(B.scan_broker_csv(spark, str(tmp_path)), spark.createDataFrame([], "id string, name string"))
    assert sorted((r.raw_description, r.value_gbp) for r in tx.collect()) == [
        ("Card\npayment", 1.0), ("Card\npayment", 1.0), (("long line\n" * 40).strip(), 2.0), ("x", 3.0)]
    assert sorted((r.reject_reason, r.raw_line) for r in rejects.collect()) == [
        ("unclosed quote", '03/02/2024,,FPC,"never closed,,,2.00'), ("unclosed quote", "04/02/2024,,FPC,x,,,3.00")]


def test_files_without_open_cells_are_not_scanned(spark, tmp_path, monkeypatch):
    _write(f"{tmp_path}/A/a.csv", HEADER + '02/02/2024,,FPC,"Card, payment",,,"1,000.00"\n')
    monkeypatch.setattr(B, "stitched", lambda *_: pytest.fail("scanned"))
    assert [r.value for r in B.scan_broker_csv(spark, str(tmp_path)).collect()] == ["1,000.00"]


def test_split_states_compose(spark):
    """States over random line maps, cut into splits anywhere, equal a walk over the file."""
    rnd = random.Random(5)
    rows, want = [], {}
    for f in range(30):
        state, rec, block = 0, None, 0
        for n in range(rnd.randint(1, 25)):
            if rnd.random() < 0.3:
                block += 1
            f0, f1 = rnd.choice([(0, 1), (0, 0), (1, 1), (1, 0)])
            rec = (block, n) if state == 0 else rec
            before, state = state, (f1 if state else f0)
            rows.append((f"f{f}", block, n, 1, f0, f1))
            want[f"f{f}", block, n] = (before, state, rec)
    maps = spark.createDataFrame(rows, "source_file string, block long, row long, chars int, f0 int, f1 int")
    got = {(r.source_file, r.block, r.row): (r.before, r.after, tuple(r.rec)) for r in R.record_places(maps).collect()}
    assert got == want

"""Broker transaction CSV ingestion.

Layout of a broker export: some metadata lines, one header line, then data
lines (UK dates, quoted thousands-separated amounts, 'n/a' for missing
numbers, Windows-1252 text). One folder per account.

Files are read as lines in parallel splits; a line's place is (block start,
row in its split), so order within a file is known without counting lines. A
quoted cell may hold line breaks (``records.py``); they come out as line feeds.
The header is the first line with a trade-date and a reference column. Every
later line that isn't empty is data and ends up as a transaction or as a
reject with its raw text and a reason: processed = inserted + skipped +
rejected holds for each file. Rows may have any number of columns, in any
order; header names are matched by case-insensitive substring, first rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_uk_date
from ledgerline.functions.keys import transaction_id
from ledgerline.functions.text import (NOT_AVAILABLE, classify_transaction, extract_fund_name, normalise_name,
                                       parse_number)
from ledgerline.operators.sizing import broadcast_if_small
from ledgerline.sources.records import opens, stitched
from ledgerline.sources.writers import open_writers, scratch_path, shuffles_removed, write_scratch

# Fixed values of the broker export format.
BROKER_HEADER = ["Trade date", "Settle date", "Reference", "Description", "Unit cost (p)", "Quantity", "Value (£)"]
HEADER_RULES = [  # (substring, internal name), checked in order; first match wins
    ("trade date", "trade_date"),
    ("settle date", "settle_date"),
    ("unit cost", "unit_cost"),
    ("value", "value"),
    ("reference", "reference"),
    ("description", "description"),
    ("quantity", "quantity"),
]
FIELDS = ["trade_date", "settle_date", "reference", "description", "unit_cost", "quantity", "value"]
ENCODING = "ISO-8859-1"          # what Spark can write; exports are read as Windows-1252
TRADE_TYPES = ("BUY", "SELL", "SWITCH_IN", "SWITCH_OUT")
REJECTED, WARNING = "rejected", "warning"
SALTS = 32
FILE_ROWS = 500_000              # of a compressed export
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"     # white space around references and descriptions

# Windows-1252 differs from ISO-8859-1 in the printable characters at 0x80-0x9F.
_CP1252 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_DIFFERING = r"[\x80-\x9f]"

# A cell with its leading comma: quoted (quotes doubled inside) or plain.
QUOTED = r'^"([^"]*+(?:""[^"]*+)*+)"'
CELL = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'


def account_from_path(path: Column) -> Column:
    """A2: the account is the name of the file's folder.

    ``path`` is a file URI, so the folder name is URL-decoded once; a folder
    written by a partitioned writer (``key=value``) has its key dropped and its
    value decoded once more (partition values are %-escaped on disk).
    """
    folder = F.url_decode(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1))
    return F.when(folder.rlike(r"^[^=/]+="), F.url_decode(F.regexp_replace(folder, r"^[^=/]+=", ""))) \
        .otherwise(folder)


def _header_name(h: Column) -> Column:
    expr = None
    for sub, name in HEADER_RULES:
        cond = F.lower(h).contains(sub)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(h)


def cp1252_text(raw: Column) -> Column:
    """Raw bytes of a line (as the text source gives them) read as Windows-1252."""
    text = F.decode(raw.cast("binary"), ENCODING)
    return F.when(text.rlike(_DIFFERING), F.translate(text, "".join(_CP1252), "".join(_CP1252.values()))).otherwise(text)


def csv_cells(line: Column) -> Column:
    """The cells of one CSV record, however many; outer quotes removed, doubled ones undone, text behind the closing quote
    kept as it is. Records without a quote are cut at their commas."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), 1)
    quoted = F.transform(raw, lambda c: F.when(c.startswith('"'), F.concat(
        F.replace(F.regexp_extract(c, QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_replace(c, QUOTED, ""))).otherwise(c))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def file_lines(text: DataFrame) -> DataFrame:
    """(line, source_file, pos) of a text source's rows; positions order the lines of a file."""
    return text.select(
        cp1252_text(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block")) \
        .select("line", "source_file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("pos"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return file_lines(spark.read.option("recursiveFileLookup", "true").text(path))


def file_headers(lines: DataFrame) -> DataFrame:
    """One row per file with a header or a line that leaves a quoted cell open: the header's position, the place of every
    internal field (0: none, last one wins), and whether some line ``opens`` a cell that it doesn't close."""
    low = F.lower("line")
    titled = low.contains("trade date") & low.contains("reference")
    cells = F.when(titled, F.transform(csv_cells(F.col("line")), _header_name))
    is_header = F.coalesce(F.array_contains("names", "trade_date") & F.array_contains("names", "reference"), F.lit(False))
    names = (lines.filter(titled | F.col("line").contains('"')).select("source_file", "pos", cells.alias("names"), opens(F.col("line")).alias("opens"))
             .filter(is_header | F.col("opens"))
             .groupBy("source_file").agg(F.min_by(F.struct("pos", "names"), F.when(is_header, F.col("pos"))).alias("h"),
                                         F.max("opens").alias("opens")))

    def place(f: str) -> Column:
        back = F.array_position(F.reverse(F.col("h.names")), f)
        return F.when(back > 0, F.size("h.names") - back + 1).otherwise(0).cast("int").alias(f"p_{f}")

    return names.select("source_file", F.col("h.pos").alias("header_pos"), *[place(f) for f in FIELDS], "opens")


def whole_records(lines: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, headers): lines that stand inside a quoted cell joined to their record's first line.

    Files without an open cell behind their header keep their lines as they are. The others' headers are found again
    among their records.
    """
    spark = lines.sparkSession
    torn = headers.filter(F.col("opens") & F.col("header_pos").isNotNull()).select("source_file", "header_pos")
    if not torn.limit(1).count():
        return lines.withColumn("unclosed", F.lit(False)), headers
    files, _ = broadcast_if_small(torn)
    as_is = lines.join(files.drop("header_pos"), "source_file", "left_anti").withColumn("unclosed", F.lit(False))
    records = stitched(lines.join(files, "source_file"))
    again = scratch_path(spark, "broker-headers")
    kept = headers.join(files.drop("header_pos"), "source_file", "left_anti")
    write_scratch(kept.unionByName(file_headers(records.filter(~F.col("unclosed")))), again)
    return as_is.unionByName(records), spark.read.parquet(again)


def named_records(lines: DataFrame) -> DataFrame:
    """Lines -> data records with named fields, each by its file's header; files without one keep the raw line only.

    The header map (a row per file) is written once and broadcast if its measured size allows; beyond that
    both sides are joined on (file, salt), so that one large file is not one task.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "broker-headers")
    write_scratch(file_headers(lines), path)
    lines, found = whole_records(lines, spark.read.parquet(path))
    # the account is worked out once a file, not once a line (files without a row here: below)
    headers, small = broadcast_if_small(found.withColumn("_account", account_from_path(F.col("source_file"))))
    if small:
        joined = lines.join(headers, "source_file", "left")
    else:
        salted = headers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = lines.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(SALTS)).cast("int")) \
            .join(salted, ["source_file", "_salt"], "left")
    data = joined.filter((F.trim("line") != "") & (F.col("header_pos").isNull() | (F.col("pos") > F.col("header_pos"))))
    data = data.withColumn("_cells", csv_cells(F.col("line")))
    return data.select(
        "source_file", F.coalesce("_account", account_from_path(F.col("source_file"))).alias("account_id"),
        *[F.when(F.col(f"p_{f}") > 0, F.get(F.col("_cells"), F.col(f"p_{f}") - 1)).alias(f) for f in FIELDS],
        F.col("line").alias("raw_line"), F.col("header_pos").isNotNull().alias("has_header"), "unclosed")


def scan_broker_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: raw data records with named string fields, source file, account and raw line."""
    return named_records(read_lines(spark, path))


def _given(cell: str) -> Column:
    text = F.lower(F.trim(cell))
    return F.coalesce((text != "") & (text != NOT_AVAILABLE), F.lit(False))


def parse_broker_rows(rows: DataFrame) -> DataFrame:
    """Typed columns, transaction class and a reject reason."""
    typed = rows.select(
        "source_file", "account_id",
        parse_uk_date(F.col("trade_date")).alias("trade_date"),
        parse_uk_date(F.col("settle_date")).alias("settle_date"),
        F.btrim("reference", F.lit(WHITE)).alias("reference"),
        F.btrim("description", F.lit(WHITE)).alias("raw_description"),
        parse_number(F.col("unit_cost")).alias("unit_cost_pence"),
        parse_number(F.col("quantity")).alias("quantity"),
        parse_number(F.col("value")).alias("value_gbp"),
        F.coalesce(F.trim("settle_date") != "", F.lit(False)).alias("_settled"), _given("unit_cost").alias("_costed"),
        _given("quantity").alias("_counted"), "has_header", "unclosed", "raw_line")
    # each cell is parsed once; the reasons and the class read the parsed columns
    reason = (F.when(~F.col("has_header"), F.lit("no header line"))
              .when(F.col("unclosed"), F.lit("unclosed quote"))
              .when(F.col("value_gbp").isNull(), F.lit("unparseable value"))
              .when(F.col("trade_date").isNull(), F.lit("unparseable trade date"))
              .when(F.col("_settled") & F.col("settle_date").isNull(), F.lit("unparseable settle date"))
              .when(F.col("_costed") & F.col("unit_cost_pence").isNull(), F.lit("unparseable unit cost"))
              .when(F.col("_counted") & F.col("quantity").isNull(), F.lit("unparseable quantity")))
    cls = classify_transaction(F.coalesce("reference", F.lit("")), F.col("value_gbp"))
    out = typed.select("source_file", "account_id", "trade_date", "settle_date", "reference", "raw_description", "unit_cost_pence",
                       "quantity", "value_gbp", reason.alias("reject_reason"), "raw_line", cls.alias("_cls"))
    return computed_once(out).select("*", "_cls.*").drop("_cls")


def computed_once(rows: DataFrame) -> DataFrame:
    """The same rows, through which no later filter is pushed: pushed below, it would hold a copy of the whole parsing for
    every column that it names, and each copy would be computed for each row."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def fund_lookup(funds: DataFrame) -> DataFrame:
    """A8 lookup: normalised fund name -> fund id; repeated names resolve to one id (the largest)."""
    return (funds.select(normalise_name(F.col("name")).alias("_name_key"), F.col("id").alias("_fund_id"))
            .groupBy("_name_key").agg(F.max("_fund_id").alias("_fund_id")))


def ingest_transactions(rows: DataFrame, funds: DataFrame, accounts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed rows -> (transactions in the source table's shape, rejects and warnings with reasons).

    With ``accounts`` given, rows of an account that isn't among them are rejected. Trades get a fund id by
    name (null when unmatched: kept, reported as a warning row); the id is the content hash, so a
    re-ingested row keeps its id.
    """
    return ingest_parsed(parse_broker_rows(rows), funds, accounts)


def ingest_parsed(parsed: DataFrame, funds: DataFrame, accounts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As :func:`ingest_transactions`, from rows that are parsed already."""
    return ingest_matched(match_parsed(parsed, funds, accounts))


def _unmatched() -> Column:
    """Good rows that get a warning: trades whose fund isn't known."""
    return F.col("transaction_type").isin(*TRADE_TYPES) & (F.col("raw_description") != "") & F.col("_fund_id").isNull()


def match_parsed(parsed: DataFrame, funds: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Parsed rows with their fund and the reason of unknown accounts; the raw line is kept where it is reported, i.e. of
    rejects and warnings. Callers that read the rows several times write these."""
    if accounts is not None:
        known, _ = broadcast_if_small(accounts.select(F.col("id").alias("account_id"), F.lit(True).alias("_known")).distinct())
        parsed = parsed.join(known, "account_id", "left").withColumn(
            "reject_reason", F.coalesce("reject_reason", F.when(F.col("_known").isNull(), F.lit("unknown account")))).drop("_known")
    good = F.col("reject_reason").isNull()
    is_trade = F.col("transaction_type").isin(*TRADE_TYPES) & (F.col("raw_description") != "")
    keyed = parsed.withColumn("_name_key", F.when(good & is_trade, normalise_name(extract_fund_name(F.col("raw_description")))))
    lookup, _ = broadcast_if_small(fund_lookup(funds))
    return (keyed.join(lookup, "_name_key", "left").drop("_name_key")
            .withColumn("raw_line", F.when(~good | _unmatched(), F.col("raw_line"))))


def ingest_matched(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions, rejects and warnings) of matched rows."""
    good = F.col("reject_reason").isNull()
    tx = matched.filter(good).select(
        transaction_id(F.col("account_id"), F.col("trade_date"), F.col("reference"), F.col("value_gbp")).alias("id"),
        "account_id", F.col("_fund_id").alias("fund_id"), "trade_date", "settle_date", "reference",
        "raw_description", "transaction_type", "transaction_subtype", "unit_cost_pence", "quantity", "value_gbp",
        "source_file")
    report = ["source_file", "account_id", "trade_date", "reference", "raw_description", "reject_reason", "severity", "raw_line"]
    # rejects and warnings in one pass over the rows
    told = (matched.filter(~good | _unmatched())
            .withColumn("severity", F.when(good, F.lit(WARNING)).otherwise(F.lit(REJECTED)))
            .withColumn("reject_reason", F.coalesce("reject_reason", F.lit("unmatched fund"))))
    return tx, told.select(*report)


def ingest_counts(batch: DataFrame, inserted: DataFrame, by: str = "source_file",
                  rejects: DataFrame | None = None) -> DataFrame:
    """processed = inserted + skipped + rejected per ``by`` (file or account), and a total row.

    Partial counts of each side are united and summed: one aggregation, no join.
    """
    def count(df: DataFrame, what: str) -> DataFrame:
        return df.groupBy(by).agg(F.count(F.lit(1)).alias(what))

    parts = [count(batch, "accepted"), count(inserted, "inserted")]
    if rejects is not None:
        parts.append(count(rejects.filter(F.col("severity") == REJECTED), "rejected"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    if rejects is None:
        both = both.withColumn("rejected", F.lit(0).cast("bigint"))
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("accepted", "inserted", "rejected")]
    per = both.groupBy(by).agg(*total)
    per = per.unionByName(per.agg(F.lit("TOTAL").alias(by), *[F.sum(c).alias(c) for c in ("accepted", "inserted", "rejected")]))
    return per.select(by, (F.col("accepted") + F.col("rejected")).alias("processed"), "inserted",
                      (F.col("accepted") - F.col("inserted")).alias("skipped"), "rejected")


# --------------------------------------------------------------- fixture export
def money_text(c: Column) -> Column:
    """Amount as a broker prints it: thousands separators, 2 places."""
    return F.format_number(c, 2)


def write_exports(out: DataFrame, root: str, account: str, packed: bool = True, **options) -> str:
    """Write export rows as CSV files with a header each, one folder per account.

    ``packed``: compressed, as plain text takes several times the room of the tables it is made of. A compressed file is one
    split, so that files end after ``FILE_ROWS`` rows. Plain ones are read in splits that begin anywhere.
    """
    writer = out.write.mode("overwrite").partitionBy(account).options(header=True, encoding=ENCODING, escape='"', **options)
    if packed:
        writer = writer.options(compression="gzip", maxRecordsPerFile=FILE_ROWS)
    with open_writers(out.sparkSession), shuffles_removed(out.sparkSession):
        writer.csv(root)
    return root


def write_broker_csv(transactions: DataFrame, root: str, packed: bool = True) -> str:
    """Write source-shaped transactions as broker CSV files, one folder per account.

    Every output file carries its own header line (Spark writes one per file);
    amounts are printed with thousands separators and missing numbers as 'n/a'.
    """
    na = F.lit("n/a")
    out = transactions.select(
        F.col("account_id").alias("account"),
        F.date_format("trade_date", "dd/MM/yyyy").alias(BROKER_HEADER[0]),
        F.coalesce(F.date_format("settle_date", "dd/MM/yyyy"), F.lit("")).alias(BROKER_HEADER[1]),
        F.col("reference").alias(BROKER_HEADER[2]),
        F.col("raw_description").alias(BROKER_HEADER[3]),
        F.coalesce(money_text(F.col("unit_cost_pence")), na).alias(BROKER_HEADER[4]),
        F.coalesce(money_text(F.col("quantity")), na).alias(BROKER_HEADER[5]),
        money_text(F.col("value_gbp")).alias(BROKER_HEADER[6]))
    return write_exports(out, root, "account", packed, emptyValue="")

"""Operator 10, line dedup by distinct-site spread (DataFrame functions only).

A line is boilerplate if it stands on at least ``min_sites`` distinct sites, in at least as many distinct texts (copies of
one whole text don't make its lines boilerplate, however many sites carry it). Lines are known by a 128-bit hash of
their trimmed text, texts by a 64-bit one; blank lines never count. Boilerplate goes from every document that holds it.

1. One aggregation by line counts its rows and its least and greatest site and text. A line on fewer rows than
   ``min_sites``, on one site or in one text only, cannot spread (it is out for certain).
2. For the others, HyperLogLog sketches of the sites and of the texts are built map-side and merged by aggregation.
3. Lines of which an estimate lies within ``band`` of the threshold, and none below, get exact distinct counts.
4. The line numbers to drop are gathered by text (copies of a text share them) and joined to the documents.

``copy_share`` (off unless given) leaves documents alone of which at least that share of characters is boilerplate:
near copies with small differences, for a later near-duplicate stage that keeps one of them.

Hot lines and sites combine map-side in every aggregation. The only join that moves texts is on the text's
own hash, whose partitions Spark can split.

Defined results: null texts count as empty; a null site is a site of its own; an empty text has one (blank) line;
repeated rows get a row each; a text of boilerplate only becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import packed, unpacked, written

MIN_SITES = 5
BAND = 0.25
LG_K = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _line_key(line: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds."""
    trimmed = F.trim(line)
    return [F.xxhash64(F.lit(1), trimmed).alias("h1"), F.xxhash64(F.lit(2), trimmed).alias("h2")]


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(3), text).alias("k1"), F.xxhash64(F.lit(4), text).alias("k2")]


def site_lines(docs: DataFrame, site: str) -> DataFrame:
    """(h1, h2, site, t) of every line that isn't blank; ``t`` is its text's hash."""
    return (docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), _text_key(F.col("text"))[0].alias("t"),
                        F.explode(_lines(F.col("text"))).alias("line"))
            .filter(F.trim("line") != "").select(*_line_key(F.col("line")), "site", "t"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, band: float = BAND,
                lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, sites, texts) of the lines on at least ``min_sites`` sites and in as many texts."""
    lines = site_lines(docs, site)
    several = lambda c: F.min(c) < F.max(c)
    spread = (lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), several("site").alias("s"), several("t").alias("x"))
              .filter((F.col("n") >= min_sites) & ((F.col("s") & F.col("x")) | F.lit(min_sites <= 1)))
              .select("h1", "h2"))
    spread = written(spread, "repeated-lines")
    own = lines.join(spread, ["h1", "h2"])
    least, enough = F.least("sites", "texts"), min_sites * (1 + band)
    sketched = (own.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("s"), F.hll_sketch_agg("t", lg_k).alias("x"))
                .select("h1", "h2", F.hll_sketch_estimate("s").alias("sites"), F.hll_sketch_estimate("x").alias("texts"))
                .filter(least >= min_sites * (1 - band)))
    sketched = written(sketched, "line-sketches")
    near = sketched.filter(least <= enough).select("h1", "h2")
    exact = (lines.join(near, ["h1", "h2"]).groupBy("h1", "h2")
             .agg(F.countDistinct("site").alias("sites"), F.countDistinct("t").alias("texts")).filter(least >= min_sites))
    return sketched.filter(least > enough).unionByName(exact)


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, band: float = BAND,
                lg_k: int = LG_K, copy_share: float | None = None) -> DataFrame:
    """(_row, _old, _new, _n_lines, _n_removed): each document's row, its text before and after, and counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), F.col(site).alias("site"))
    found = written(boilerplate(texts, "site", min_sites, band, lg_k).select("h1", "h2"), "boilerplate")
    drop = (texts.select(*_text_key(F.col("text")), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
            .filter(F.trim("line") != "")
            .select("k1", "k2", "at", *_line_key(F.col("line")))
            .join(found, ["h1", "h2"])
            .groupBy("k1", "k2").agg(F.collect_set("at").alias("_drop")))
    drop = written(drop, "dropped-lines")
    rows = packed(docs).withColumn("_old", F.coalesce(F.col("_row.text").cast("string"), F.lit("")))
    rows = rows.select("*", *_text_key(F.col("_old"))).join(drop, ["k1", "k2"], "left")
    lines = _lines(F.col("_old"))
    removes = F.col("_drop").isNotNull()
    if copy_share is not None:
        dropped = F.aggregate(F.transform("_drop", lambda i: F.length(F.get(lines, i))), F.lit(0), lambda s, n: s + n)
        removes = removes & F.coalesce(dropped < copy_share * F.length("_old"), F.lit(False))
    # line numbers without the dropped ones, by a hash set: linear in the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return rows.select("_row", "_old", F.when(removes, kept).otherwise(F.col("_old")).alias("_new"),
                       F.size(lines).cast("bigint").alias("_n_lines"),
                       F.when(removes, F.size("_drop")).otherwise(0).cast("bigint").alias("_n_removed"))


def line_report(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, lines, lines removed, cleaned text."""
    return dedup_lines(docs.select("doc_id", "text", "source"), **kw).select(
        F.col("_row.doc_id").cast("bigint").alias("doc_id"), F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"), F.col("_new").alias("text"))


def clean_lines(docs: DataFrame, **kw) -> DataFrame:
    """The rows and columns of ``docs``, texts without boilerplate lines; ``n_chars`` follows. Others are unchanged."""
    hit = F.col("_n_removed") > 0
    changed = {"text": F.when(hit, F.col("_new")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("_new")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return dedup_lines(docs, **kw).select(*unpacked(docs.columns, **changed))


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for :func:`line_report` with exact counts throughout."""
    return f"""
WITH l AS (
  SELECT rowid_ AS r, doc_id, source, t, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, source, md5(coalesce(text, '')) AS t,
               string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), spread AS (
  SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(1))) >= {min_sites} AND count(DISTINCT t) >= {min_sites}
), marked AS (
  SELECT l.*, spread.line IS NOT NULL AS wide FROM l LEFT JOIN spread ON trim(l.line, ' ') = spread.line
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE wide) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT wide), '') AS text
FROM marked GROUP BY r"""

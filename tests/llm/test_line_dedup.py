import duckdb
from edge import ROWS, edge_docs, no_docs

from ledgerline.llm import line_dedup as L


def docs_with_boilerplate(spark):
    rows = []
    for i in range(60):
        lines = [f"own line {i} of this page with enough text", f"second own line {i}, also long enough to stay"]
        if i % 2 == 0:
            lines.insert(1, "  Share this page ")
        if i % 15 == 0:
            lines.append("on four sites only")
        rows.append((i, "\n".join(lines), f"s{i % 10}" if i % 15 else f"s{i // 15}"))
    rows += [(100 + i, "a copied page\nwith two lines", f"s{i}") for i in range(8)]
    rows += [(200, None, "s1"), (201, "", None), (202, "\n\n", None), (203, "Share this page", "s1"),
             (204, " Share this page\nshort own line\n Share this page          ", "s2"),
             (205, "\n".join("Share this page" if k % 3 else f"own line number {k}, long enough to be a text" for k in range(600)), "s3")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_report_equals_sql(spark):
    df = docs_with_boilerplate(spark)
    got = sorted(map(tuple, L.line_report(df).select("doc_id", "n_lines", "n_removed", "text").collect()))
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    want = con.execute(L.oracle_sql()).df()
    assert got == sorted(map(tuple, want[["doc_id", "n_lines", "n_removed", "text"]].itertuples(index=False)))
    by = {r[0]: r for r in got}
    assert by[2][2] == 1 and "Share" not in by[2][3]                   # boilerplate goes
    assert by[15][2] == 0 and "four sites" in by[0][3]                 # not enough sites
    assert by[103][3] == "a copied page\nwith two lines"               # copies of one text are one text
    assert by[203][2] == 1 and by[203][3] == "" and by[200][3] == ""   # a page of nothing but boilerplate
    assert by[204][2] == 2 and by[204][3] == "short own line"          # mostly boilerplate, but not only
    assert by[205][2] == 400 and by[205][3].count("\n") == 199
    careful = {r["doc_id"]: r["n_removed"] for r in L.line_report(df, copy_share=0.75).collect()}
    assert careful[203] == 0 and careful[204] == 2 and careful[205] == 400 and careful[2] == 1


def test_near_threshold_counts_are_exact(spark):
    rows = [(s * 1000 + k, f"line on {n} sites\nown {s} {k} {n} text that is long enough", f"site{s}")
            for n in (3, 4, 5, 6, 7, 40) for s in range(n) for k in range(2)]
    got = L.line_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    found = L.boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["sites"] for r in found) == [5, 6, 7, 40]
    assert sum(r["n_removed"] for r in got) == 2 * (5 + 6 + 7 + 40)


def test_clean_lines_keeps_columns(spark):
    docs = edge_docs(spark)
    out = L.clean_lines(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert L.line_report(docs).count() == len(ROWS)
    assert L.line_report(no_docs(spark)).count() == 0 and L.clean_lines(no_docs(spark)).count() == 0

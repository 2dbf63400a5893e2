"""Data-quality assertions as Spark jobs over any table.

Each check is a single aggregation that returns rows of
(table_name, check_name, column_name, failures); ``dq_report`` unions them.
Not-null checks for many columns share one pass (one ``agg`` with a
conditional count per column, then unpivoted). Uniqueness groups by the key
(nulls form one group, as in SQL GROUP BY); relationships are left-anti
joins; expressions are filters. Nothing is collected: the report is a
DataFrame a caller can write, assert on, or alert from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df_agg: DataFrame, table: str, check: str, column: str) -> DataFrame:
    return df_agg.select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"),
                         F.lit(column).alias("column_name"), F.col("failures").cast("bigint").alias("failures"))


def assert_not_null(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Null count per column, all columns in one scan."""
    agg = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    stacked = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures"))
                                             for c in cols])).alias("s"))
    return stacked.select(F.lit(table).alias("table_name"), F.lit("not_null").alias("check_name"),
                          F.col("s.column_name"), F.col("s.failures").cast("bigint").alias("failures"))


def assert_unique(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Number of key values (or combinations) that occur more than once."""
    dup = df.groupBy(*cols).count().filter(F.col("count") > 1)
    name = "unique" if len(cols) == 1 else "unique_combination"
    return _row(dup.agg(F.count(F.lit(1)).alias("failures")), table, name, ",".join(cols))


def assert_accepted_values(df: DataFrame, table: str, col: str, values: Sequence) -> DataFrame:
    """Non-null values outside the accepted set."""
    bad = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*values))
    return _row(bad.agg(F.count(F.lit(1)).alias("failures")), table, "accepted_values", col)


def assert_relationship(df: DataFrame, table: str, col: str, parent: DataFrame, parent_col: str,
                        where: Column | None = None) -> DataFrame:
    """Child keys (non-null, optionally filtered) with no parent row."""
    child = df.filter(F.col(col).isNotNull())
    if where is not None:
        child = child.filter(where)
    # count child rows per key first (map-side combine), so only distinct keys are shuffled
    per_key = child.groupBy(col).agg(F.count(F.lit(1)).alias("_rows"))
    orphans = per_key.join(parent.select(F.col(parent_col).alias(col)).distinct(), col, "left_anti")
    return _row(orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("failures")), table, "relationships", col)


def assert_expression(df: DataFrame, table: str, name: str, expr: Column, where: Column | None = None) -> DataFrame:
    """Rows (optionally filtered) where the expression is not true."""
    rows = df if where is None else df.filter(where)
    bad = rows.filter(~F.coalesce(expr, F.lit(False)))
    return _row(bad.agg(F.count(F.lit(1)).alias("failures")), table, "expression_is_true", name)


def table_checks(df: DataFrame, table: str, not_null: Sequence[str] = (),
                 accepted: dict[str, Sequence] | None = None,
                 expressions: Sequence[tuple[str, Column, Column | None]] = ()) -> DataFrame:
    """J1 + J3 + J5 for one table in a single scan: every row-level check is a
    conditional count inside one aggregation, unpivoted to one row per check."""
    counts = []
    for c in not_null:
        counts.append(("not_null", c, F.count(F.when(F.col(c).isNull(), 1))))
    for c, values in (accepted or {}).items():
        counts.append(("accepted_values", c, F.count(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), 1))))
    for name, expr, where in expressions:
        applies = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        counts.append(("expression_is_true", name, F.count(F.when(applies & ~F.coalesce(expr, F.lit(False)), 1))))
    agg = df.agg(*[cnt.alias(f"_c{i}") for i, (_, _, cnt) in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(chk).alias("check_name"), F.lit(col).alias("column_name"),
                              F.col(f"_c{i}").cast("bigint").alias("failures"))
                     for i, (chk, col, _) in enumerate(counts)])
    return agg.select(F.explode(rows).alias("s")).select(
        F.lit(table).alias("table_name"), "s.check_name", "s.column_name", "s.failures")


def grouped_checks(df: DataFrame, table: str, not_null: Sequence[str] = (), accepted: dict[str, Sequence] | None = None,
                   expressions: Sequence[tuple[str, Column, Column | None]] = (), unique: Sequence[Sequence[str]] = (),
                   related: Sequence[tuple[str, str, DataFrame, str, Column | None]] = ()) -> DataFrame:
    """Every check of one table in one scan and one shuffle.

    ``related``: (check name, column, parent frame, parent column, condition). All unique keys and all child columns are
    grouping sets of one aggregation, combined map-side: a set of a key counts its repeated values, one of a child
    column the rows per distinct value. Row-level checks are sums that ride along; they are read from one set. Only the
    distinct child values then meet the parents, united to one frame of (relation, value).
    """
    flags = [("not_null", c, F.col(c).isNull()) for c in not_null]
    flags += [("accepted_values", c, F.col(c).isNotNull() & ~F.col(c).isin(*values)) for c, values in (accepted or {}).items()]
    for name, expr, where in expressions:
        applies = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        flags.append(("expression_is_true", name, applies & ~F.coalesce(expr, F.lit(False))))
    if not unique and not related:
        return table_checks(df, table, not_null, accepted, expressions)
    keys = list(dict.fromkeys(c for cols in unique for c in cols))
    columns = [F.col(c).alias(f"_k{keys.index(c)}") for c in keys]
    for i, (_, col, _, _, where) in enumerate(related):
        value = F.col(col).cast("string")
        columns.append((value if where is None else F.when(where, value)).alias(f"_r{i}"))
    named = [f"_k{i}" for i in range(len(keys))] + [f"_r{i}" for i in range(len(related))]
    sets = [[f"_k{keys.index(c)}" for c in cols] for cols in unique] + [[f"_r{i}"] for i in range(len(related))]
    gid = [sum(1 << (len(named) - 1 - k) for k, c in enumerate(named) if c not in own) for own in sets]
    grouped = (df.select(*columns, *[f.cast("int").alias(f"_f{i}") for i, (_, _, f) in enumerate(flags)])
               .groupingSets([[F.col(c) for c in own] for own in sets], *[F.col(c) for c in named])
               .agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_n"),
                    *[F.sum(f"_f{i}").alias(f"_f{i}") for i in range(len(flags))]))
    if related:
        first = len(unique)
        relation, value = F.lit(-1), F.xxhash64(*[F.col(c) for c in named]).cast("string")   # keys are spread, not one value
        for i in range(len(related)):
            here = (F.col("_set") == gid[first + i]) & F.col(f"_r{i}").isNotNull()
            relation, value = F.when(here, i).otherwise(relation), F.when(here, F.col(f"_r{i}")).otherwise(value)
        parents = reduce(DataFrame.unionByName, [
            parent.select(F.lit(i).alias("_relation"), F.col(column).cast("string").alias("_value")).filter("_value IS NOT NULL").distinct()
            for i, (_, _, parent, column, _) in enumerate(related)])
        grouped = (grouped.withColumns({"_relation": relation, "_value": value})
                   .join(parents.withColumn("_held", F.lit(True)), ["_relation", "_value"], "left"))
    counts = [(check, column, F.sum(F.when(F.col("_set") == gid[0], F.col(f"_f{i}")))) for i, (check, column, _) in enumerate(flags)]
    counts += [("unique" if len(cols) == 1 else "unique_combination", ",".join(cols),
                F.count(F.when((F.col("_set") == gid[i]) & (F.col("_n") > 1), 1))) for i, cols in enumerate(unique)]
    counts += [(check, column, F.sum(F.when((F.col("_relation") == i) & F.col("_held").isNull(), F.col("_n"))))
               for i, (check, column, _, _, _) in enumerate(related)]
    agg = grouped.agg(*[c.alias(f"_c{i}") for i, (_, _, c) in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(check).alias("check_name"), F.lit(column).alias("column_name"),
                              F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("bigint").alias("failures"))
                     for i, (check, column, _) in enumerate(counts)])
    return agg.select(F.explode(rows).alias("s")).select(F.lit(table).alias("table_name"), "s.check_name", "s.column_name", "s.failures")


def dq_report(checks: Sequence[DataFrame]) -> DataFrame:
    """Every check's rows in one frame."""
    return reduce(DataFrame.unionByName, checks)

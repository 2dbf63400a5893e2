"""Print the formatted physical plan of registered queries, with a one-line shape summary.

    python tests/show_plans.py [sf_dir] name [name ...]

The summary counts exchanges (shuffles), parquet scans, joins by strategy,
windows and generators (explodes) in the plan Spark would run, which is how
the plans behind README's scale notes were reviewed.
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from ledgerline.session import build_session  # noqa: E402


def shape(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    parts = {k: plan.count(k) for k in ("Exchange", "FileScan", "BroadcastHashJoin", "SortMergeJoin",
                                        "ShuffledHashJoin", "BroadcastNestedLoopJoin", "Window", "Generate")}
    return ", ".join(f"{k}={v}" for k, v in parts.items() if v)


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    spark = build_session("local[8]", 8)
    qs = E.queries()
    for name in args:
        df = qs[name](spark, sf_dir)
        print(f"==== {name}: {shape(df)}")
        df.explain("formatted")


if __name__ == "__main__":
    main()

"""Read-only SQL over named views.

``check_statement`` has Spark parse the statement and visits the parsed plan itself: every plan node, every expression and
every subquery plan, through all fields of a node (so definitions of named windows and WITH members too). Nothing is read
from printed text, which shortens long lists and shows literals like names. ``answer`` runs the statement under a time limit.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterator

from pyspark import InheritableThread
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

SECONDS = 30
ROW_CAP = 200            # answers are capped at 200 rows (the feature)

# Plan nodes that a statement may consist of; commands, scripts, files and table functions are not among them.
QUERY_NODES = frozenset([
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect",
    "Except", "Window", "WithWindowDefinition", "UnresolvedRelation", "UnresolvedHaving",
    "UnresolvedInlineTable", "LocalRelation", "UnresolvedSubqueryColumnAliases", "SubqueryAlias", "OneRowRelation", "LateralJoin",
    "Pivot", "Unpivot"])
# Built-in functions that call methods of the JVM.
METHOD_CALLS = frozenset(["reflect", "java_method", "try_reflect"])


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class _Visitor:
    def __init__(self, spark: SparkSession, views: Collection[str]):
        jvm = spark._jvm
        catalyst = jvm.org.apache.spark.sql.catalyst
        names = ["org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", "org.apache.spark.sql.catalyst.trees.TreeNode",
                 "scala.collection.Iterable", "scala.Product"]
        self.plan, self.node, self.iterable, self.product = [jvm.org.apache.spark.util.Utils.classForName(n, True, True) for n in names]
        registry = getattr(getattr(catalyst.analysis, "FunctionRegistry$"), "MODULE$")
        self.functions = {f.funcName().lower() for f in _items(registry.functionSet())}
        self.views = views
        self.relations: set[str] = set()

    def visit(self, plan, scope: frozenset[str] = frozenset()) -> None:
        """Check everything below a plan; ``scope`` has the names that WITH defines around it."""
        todo = [(plan, scope)]
        while todo:
            x, names = todo.pop()
            if x is None or isinstance(x, (str, int, float, bool, bytes)):
                continue
            if self.node.isInstance(x):
                kind = x.getClass().getSimpleName()
                if kind == "UnresolvedWith":
                    todo += self._members(x, names)
                    continue
                self._plan(x, kind, names) if self.plan.isInstance(x) else self._expression(x, kind)
                todo += [(part, names) for part in _items(x.productIterator())]
            elif self.iterable.isInstance(x):
                todo += [(part, names) for part in _items(x)]
            elif self.product.isInstance(x) and x.getClass().getName().startswith(("scala.Tuple", "scala.Some")):
                todo += [(part, names) for part in _items(x.productIterator())]

    @staticmethod
    def _members(x, names: frozenset[str]) -> list:
        """What a WITH holds, each part with the names it sees: a member those before it (and itself if recursive)."""
        parts = []
        for member in _items(x.cteRelations()):
            parts.append((member._2(), names | {member._1()} if x.allowRecursion() else names))
            names = names | {member._1()}
        return [*parts, (x.child(), names)]

    def _plan(self, x, kind: str, names: frozenset[str]) -> None:
        if kind not in QUERY_NODES:
            raise ValueError(f"only SELECT statements are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = ".".join(_items(x.multipartIdentifier()))
            if name not in names:
                if name not in self.views:
                    raise ValueError(f"{name} is not one of the views")
                self.relations.add(name)

    def _expression(self, x, kind: str) -> None:
        if "UnresolvedIdentifier" in kind:
            raise ValueError("names must be written out")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = ".".join(_items(x.nameParts())) if kind == "UnresolvedFunction" else x.name().unquotedString()
            if name.lower() not in self.functions or name.lower() in METHOD_CALLS:
                raise ValueError(f"{name} is not one of the SQL functions allowed")


def check_statement(spark: SparkSession, sql: str, views: Collection[str]) -> set[str]:
    """The views that a statement reads; ValueError if it is anything but one SELECT over ``views``.

    A WITH name hides a view of that name within its statement only. Names are matched as they are written.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ValueError("not a SELECT statement") from e
    visitor = _Visitor(spark, views)
    visitor.visit(plan)
    if not visitor.relations:
        raise ValueError("the statement names none of the views")
    return visitor.relations


def answer(df: DataFrame, seconds: float = SECONDS, rows: int = ROW_CAP) -> DataFrame:
    """The first ``rows`` rows of ``df`` if they are there within ``seconds``; else its jobs are cancelled: TimeoutError."""
    spark, tag = df.sparkSession, f"adhoc-{uuid.uuid4().hex}"
    done: dict = {}

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        spark.sparkContext.setInterruptOnCancel(True)
        try:
            done["rows"] = df.limit(rows).collect()
        except Exception as error:
            done["error"] = error
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    late = thread.is_alive()
    for _ in range(50):
        if not thread.is_alive():
            break
        # adaptive execution submits stages one by one, so jobs of this tag may still come
        spark.sparkContext.cancelJobsWithTag(tag)
        thread.join(0.2)
    if late:
        raise TimeoutError(f"the statement took more than {seconds:g} seconds")
    if "error" in done:
        raise done["error"]
    return spark.createDataFrame(done["rows"], df.schema)

"""Operator 4, secret scans over a trigram inverted index (DataFrame functions only on the main path).

Each rule's regex is read once, on the driver, into a Boolean query over trigrams that any match must hold
(:func:`trigram_query`). One pass over the texts writes the inverted index: postings (trigram, text key) for the
trigrams that some rule asks for. Postings are intersected and united by an aggregation by text key, which
gives the candidate texts of each rule. Candidates are joined back to the documents on the text key and
verified by the rule's regex. Rules without a mandatory trigram (``hex``) scan every text.

Text keys are 128-bit hashes, so copies share their postings; the join's partitions can be split by Spark.

Defined results: null and empty texts have no spans; a secret at a place counts per kind; repeated rows get a row
each. Spans are in code points, end exclusive, ordered by start, then by the order of RULES.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str       # the same in Java and Python
    least: int = 0     # characters that ``group`` must have
    group: int = 0


# The first three are the base kinds.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs are taken whole, so shorter ones can be left out in the pattern
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# ------------------------------------------------------------ trigram queries
ALL = ("all",)          # satisfied by every text
MAX_STRINGS = 24        # spelled-out strings are followed up to this many


def _and(*parts):
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(*parts):
    return ALL if ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _spelled(strings: set[str]):
    """Query of a text that holds one of ``strings``; alternatives that imply another one are left out.

    A string is covered by every third of its trigrams and the last one: those in between say little more.
    """
    sets = {frozenset(s[i:i + 3] for i in {*range(0, len(s) - 2, 3), max(len(s) - 3, 0)} if len(s) > 2) for s in strings}
    least = sorted(sorted(x) for x in sets if not any(y < x for y in sets))
    return _or(*(_and(*(("tri", t) for t in x)) for x in least))


def trigram_query(pattern: str):
    """Boolean query over lower-case trigrams that every text with a match satisfies."""
    strings, query = _walk(re._parser.parse(pattern))
    return query if strings is None else _and(query, _spelled(strings))


def _walk(nodes) -> tuple[set[str] | None, tuple]:
    """(all strings that the nodes match, or None if they can't be spelled out; a query implied beside them)."""
    strings, query, whole = {""}, ALL, True
    for op, arg in nodes:
        own, extra = _strings_of(str(op), arg)
        query = _and(query, extra)
        if own is not None and len(own) * len(strings) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in own}
        else:  # the strings so far end here; new ones begin
            query = _and(query, _spelled(strings))
            strings, whole = (own if own is not None and len(own) <= MAX_STRINGS else {""}), False
    return (strings, query) if whole else (None, _and(query, _spelled(strings)))


def _strings_of(name: str, arg) -> tuple[set[str] | None, tuple]:
    if name == "LITERAL":
        return {chr(arg).lower()}, ALL
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(a).lower() for _, a in arg}, ALL
    if name == "SUBPATTERN":
        return _walk(arg[-1])
    if name == "BRANCH":
        branches = [_walk(b) for b in arg[1]]
        if all(s is not None for s, _ in branches):
            return set().union(*(s for s, _ in branches)), _or(*(q for _, q in branches))
        return None, _or(*(_and(q, _spelled(s)) if s is not None else q for s, q in branches))
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = arg
        strings, query = _walk(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if low > 0:
            return None, query if strings is None else _and(query, _spelled(strings))
    return None, ALL


def trigrams_in(query) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(trigrams_in(q) for q in query[1:])) if query != ALL else set()


# -------------------------------------------------------------- the index
BITS_A_LONG = 60


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(5), text).alias("k1"), F.xxhash64(F.lit(6), text).alias("k2")]


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram number, k1, k2), for texts that hold the trigram in any case."""
    low = texts.select(*_text_key(F.col("text")), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)]))
    return (low.select("k1", "k2", held.alias("held")).filter(F.size("held") > 0)
            .select(F.explode("held").alias("trigram"), "k1", "k2").sortWithinPartitions("trigram"))


def _holds(query, number: dict[str, int]) -> Column:
    if query[0] == "tri":
        i = number[query[1]]
        return F.col(f"m{i // BITS_A_LONG}").bitwiseAND(F.lit(1 << (i % BITS_A_LONG))) != 0
    parts = [_holds(q, number) for q in query[1:]]
    return reduce(lambda a, b: (a & b) if query[0] == "and" else (a | b), parts)


def candidates(index: DataFrame, queries: dict[str, tuple], trigrams: list[str]) -> DataFrame:
    """(k1, k2, kinds): the texts whose postings satisfy a rule's query."""
    number = {t: i for i, t in enumerate(trigrams)}
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / BITS_A_LONG) == w,
                             F.expr(f"shiftleft(1L, trigram % {BITS_A_LONG})")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}")
             for w in range((len(trigrams) - 1) // BITS_A_LONG + 1)]
    kinds = F.array_compact(F.array(*[F.when(_holds(q, number), F.lit(k)) for k, q in queries.items()]))
    return (index.groupBy("k1", "k2").agg(*masks).select("k1", "k2", kinds.alias("kinds"))
            .filter(F.size("kinds") > 0))


# ---------------------------------------------------------------- spans
def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches: lengths of the matches and of the text between them."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(found.alias("m"), between.alias("b"),
                        (F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found).alias("g"))
    rows = F.filter(F.transform(rows, lambda r: F.struct(
        F.length(r["b"]).cast("bigint").alias("gap"), F.length(r["m"]).cast("bigint").alias("len"),
        (F.length(r["g"]) >= rule.least).alias("ok"))), lambda r: r["len"].isNotNull())
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    walked = F.aggregate(rows, start, lambda s, r: F.struct(
        (s["at"] + r["gap"] + r["len"]).alias("at"),
        F.when(r["ok"], F.array_append(s["out"], F.struct((s["at"] + r["gap"]).alias("start"),
                                                          (s["at"] + r["gap"] + r["len"]).alias("end"))))
        .otherwise(s["out"]).alias("out")))
    return F.when(F.size(found) > 0, walked["out"]).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                   s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, and all spans."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALL}
    trigrams = sorted(set().union(*(trigrams_in(q) for q in queries.values()))) if queries else []
    if queries:
        index = written(postings(rows, trigrams), "trigram-index")
        found = written(candidates(index, queries, trigrams), "secret-candidates")
        found = found.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
        keyed = rows.withColumns({c: k for c, k in zip(("_k1", "_k2"), _text_key(F.col("text")))})
        rows = keyed.join(found, ["_k1", "_k2"], "left").select("doc_id", "text", "kinds")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    by_kind = {}
    for r in rules:
        if r.kind in queries:
            by_kind[f"s_{r.kind}"] = F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r)).otherwise(none)
        else:  # scanned fully; spans are worked out where the pattern occurs at all
            by_kind[f"s_{r.kind}"] = F.when(F.col("text").rlike(r.pattern), _spans(F.col("text"), r)).otherwise(none)
    spans = rows.select("doc_id", *[c.alias(n) for n, c in by_kind.items()])
    order = {r.kind: i for i, r in enumerate(rules)}

    def of_kind(k: str) -> Column:
        return F.transform(F.col(f"s_{k}"), lambda s: F.struct(
            s["start"].alias("start"), F.lit(order[k]).alias("place"), s["end"].alias("end"), F.lit(k).alias("kind")))

    def listed(kinds) -> Column:
        return F.concat(*map(of_kind, kinds))

    counts = [F.size(f"s_{k}").cast("bigint").alias(f"n_{k}") if f"s_{k}" in by_kind else F.lit(0).cast("bigint").alias(f"n_{k}")
              for k in BASE_KINDS]
    return spans.select("doc_id", *counts,
                        F.sha2(_joined(listed([k for k in BASE_KINDS if k in order])).cast("binary"), 256).alias("base_sha256"),
                        _joined(listed(order)).alias("spans"))

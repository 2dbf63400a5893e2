"""Operator 11, conversation structure repair by the auction shortest-path algorithm.

A conversation is repaired by the cheapest edits that make its role initials match ``(s?(ua)+)?``. Edits of a row: Keep
(0), Rerole to user or assistant (1), Delete (2, required for blank rows and repeats); Insert puts an empty-text user or
assistant row anywhere (5). A truncated row that isn't deleted costs 5 more.

The lattice has a node for every place between rows and every state of the pattern (nothing yet, after the system
row, after a user row, after an assistant row); edits are its arcs, and places behind the last row in an accepting state
lead to the end. :func:`auction` finds shortest paths to the end with a price for each node: the path begins at an
origin, extends along an arc whose cost is exactly the difference of prices (a tight one) while there is one, and else
raises the price of its last node to the least cost of going on and contracts by that node. Origins are taken from the
last place to the first; a node that was an origin has its final price, so a path may stop there. All prices then are
exact distances, the tight arcs are exactly those of cheapest repairs, and :func:`trace` follows them, at each step
those of the least initial (D < I < K < R).

Rows become one symbol each (role initial and first fault) in Spark; symbols in turn order are cut into blocks of at most
``BLOCK_ROWS`` rows at range-partition borders. A conversation inside one block is solved in its task, and equal
symbol strings are solved once. Of a conversation over several blocks, each block's costs between its borders come
from auctions of their own, the few numbers per block are combined per conversation (no texts, no rows), and
each block is traced with the exact prices at its end; so no task holds a whole long conversation. The repaired
texts are hashed while they stream by in order (SHA-256 is sequential, so that one step of a conversation stays in one
task, in constant memory).

Defined results: in conversation ids and turns a null stands for itself, in the damage key for one space; null roles and
texts are one space; rows of the same turn are taken by role, then by a hash of the text; equal rows are repeats of each other;
a role without characters has no initial and can't be kept. A conversation without rows after damage has zeros, an
empty audit and the digest of the empty string. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import map_arrow, ship_package, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_ROWS = 4_096
INFINITE = 1 << 40

# Symbols of rows: a role's initial (o: any other), upper case if truncated; x for blank rows and repeats.
SYMBOLS = "suaoSUAOx"
# States of the pattern: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
ADDED = ["u", "u", "a", "u"]             # by state: the only role that an added or renamed row can have
REACHED = [{0, 1, 2, 3}, {1, 2, 3}, {2, 3}, {2, 3}]

# ------------------------------------------------------------------ the lattice
def _row_arcs(symbol: str) -> list[list[tuple[str, int, int]]]:
    """By state: (edit, cost, state behind the row) for a row of some symbol."""
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if symbol != "x":
            more = TRUNCATED if symbol.isupper() else 0
            if (kept := NEXT.get((q, symbol.lower()))) is not None:
                arcs.append(("K", KEEP + more, kept))
            arcs += [("R", REROLE + more, NEXT[q, r]) for r in ROLES if (q, r) in NEXT]
        out.append(arcs)
    return out


ROW_ARCS = {s: _row_arcs(s) for s in SYMBOLS}
INSERTS = [[("I", INSERT, NEXT[q, r]) for r in ROLES if (q, r) in NEXT] for q in range(4)]
LEAST = {s: min(cost for arcs in ROW_ARCS[s] for _, cost, _ in arcs) for s in SYMBOLS}


def arcs_of(symbols: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """(edit, cost, node) of the arcs from a node (place, state) but those to the end."""
    at, q = node
    if at < len(symbols):
        for edit, cost, to in ROW_ARCS[symbols[at]][q]:
            yield edit, cost, (at + 1, to)
        for edit, cost, to in INSERTS[q]:
            yield edit, cost, (at, to)


def auction(symbols: str, ends: tuple[int, ...]) -> list[list[int]]:
    """Prices by place and state: the exact cost of the cheapest way to the end.

    ``ends`` has the cost from each state behind the last row to the end. Insertions behind the last row are not arcs
    here; :func:`closed` puts them into ``ends``.
    """
    n = len(symbols)
    # feasible first prices: the least cost of every row to come (infinite where the pattern doesn't lead on)
    floors = [min(ends[e] for e in REACHED[q]) for q in range(4)]
    prices = [[0] * 4 for _ in range(n)] + [list(ends)]
    for at in reversed(range(n)):
        floors = [min(f + LEAST[symbols[at]], INFINITE) for f in floors]
        prices[at] = list(floors)
    settled = n                                                    # all nodes at this place and behind have final prices
    for at in reversed(range(n)):
        final: set[int] = set()
        for origin in range(4):
            path = [(at, origin)]
            while path[-1][0] < settled and path[-1][1] not in final:
                i, q = path[-1]
                least, best = INFINITE, None
                for _, cost, (j, to) in arcs_of(symbols, (i, q)):
                    total = cost + prices[j][to]
                    if total < least:
                        least, best = total, (j, to)
                if best is None or prices[i][q] < least:
                    prices[i][q] = least                           # raise the price and contract
                    if best is None:
                        break                                      # no way to the end from here
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(best)                              # a tight arc: extend
            final.add(origin)
        settled = at
    return prices


def closed(ends: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end from the states of a place, insertions there included (their cycles cost, so two rounds do)."""
    out = list(ends)
    for _ in range(3):
        for q in range(4):
            out[q] = min([out[q], *(cost + out[to] for _, cost, to in INSERTS[q])])
    return tuple(out)


LAST = tuple(0 if q in ACCEPTING else INFINITE for q in range(4))


def trace(symbols: str, prices: list[list[int]], start: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """(edits, states behind them): the ASCII-least edits along tight arcs from some states of the first place.

    Every way taken reaches the end, as prices are exact. A block that isn't the last ends behind its last row; the last
    one ends in an accepting state, with insertions behind the last row where needed.
    """
    out, at, states = [], 0, start
    while True:
        if at == len(symbols):
            if not last or any(q in ACCEPTING for q in states):
                return "".join(out), states
            arcs = [("I", at, to) for q in states for _, cost, to in INSERTS[q] if prices[at][q] == cost + prices[at][to]]
        else:
            arcs = [(edit, j, to) for q in states for edit, cost, (j, to) in arcs_of(symbols, (at, q))
                    if prices[at][q] == cost + prices[j][to]]
        least = min(edit for edit, _, _ in arcs)
        at = next(j for edit, j, _ in arcs if edit == least)       # a row's edits lead one place on, an insertion none
        states = frozenset(to for edit, _, to in arcs if edit == least)
        out.append(least)


@lru_cache(maxsize=50_000)
def repair(symbols: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of a whole conversation."""
    prices = auction(symbols, closed(LAST))
    return prices[0][0], trace(symbols, prices, frozenset([0]), True)[0]


@lru_cache(maxsize=50_000)
def between(symbols: str) -> tuple[int, ...]:
    """Costs from each state in front of a block to each state behind its last row, by start then end."""
    columns = [auction(symbols, tuple(0 if q == end else INFINITE for q in range(4)))[0] for end in range(4)]
    return tuple(columns[end][start] for start in range(4) for end in range(4))


# ---------------------------------------------------------------- rows in Spark
def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied
    (1), loses its ``[.!?]`` (2), is repeated (3) or becomes the user's (4)."""
    kind = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                _shown("role").alias("role"), _shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.filter("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy"))
            .drop("_copy"))


WHITE = " \t\n\x0b\x0c\r"
KEY = ["turn", "role", "h1", "h2"]       # order of a conversation's rows, nulls first


def keyed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2): two hashes of the text with different seeds."""
    return rows.select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(1), "text").alias("h1"),
                       F.xxhash64(F.lit(2), "text").alias("h2"))


def symbols_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, initial, copies, blank, later, symbol): distinct rows, ``symbol`` being that of the
    first copy; other copies are repeats. No texts travel; counts and first occurrences combine map-side."""
    body = F.rtrim("text", F.lit(WHITE))
    once = (keyed(rows).select("conv_id", *KEY, (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
            .groupBy("conv_id", *KEY, "blank", "cut").agg(F.count(F.lit(1)).alias("copies")))
    seen = (once.filter(~F.col("blank")).groupBy("conv_id", "role", "h1", "h2")
            .agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h1").alias("_1"),
                                    F.col("h2").alias("_2"), F.col("first.turn").alias("_first"), F.lit(True).alias("_again")))
    joined = once.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r"))
                       & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    later = F.coalesce(F.col("_again") & ~F.col("turn").eqNullSafe(F.col("_first")) & ~F.col("blank"), F.lit(False))
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("blank") | later, "x").when(F.col("cut"), F.upper(plain)).otherwise(plain)
    return joined.select("conv_id", *KEY, initial.alias("initial"), "copies", "blank", later.alias("later"), symbol.alias("symbol"))


# -------------------------------------------------------------------- blocks
LEGAL = {"su", "ua", "au"}
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
BLOCK = ("conv_id bigint, block bigint, whole boolean, turn bigint, role string, h1 bigint, h2 bigint, symbols string, "
         "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, "
         "head string, tail string, cost bigint, edits string")


class Block:
    """Rows of one conversation that follow each other: symbols and counts."""

    def __init__(self, row: dict):
        self.first = {k: row[k] for k in ("conv_id", *KEY)}
        self.symbols: list[str] = []
        self.rows = 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.head, self.tail = row["initial"], None

    def add(self, row: dict, copies: int, repeats: bool) -> None:
        """``copies`` of a distinct row; ``repeats``: its first copy stands in a block before."""
        initial, symbol = row["initial"], row["symbol"]
        self.symbols.append("x" * copies if repeats else symbol + "x" * (copies - 1))
        self.rows += copies
        if self.tail is not None:
            self.illegal += self.tail + initial not in LEGAL
        self.illegal += copies - 1                                 # equal initials side by side are never legal
        if row["blank"]:
            self.blank += copies
        elif row["later"] or repeats:
            self.duplicate += copies
        else:
            self.duplicate += copies - 1
            self.truncated += symbol.isupper()
        if (turn := row["turn"]) is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.tail = initial

    def row(self, number: int, whole: bool) -> dict:
        symbols = "".join(self.symbols)
        cost, edits = repair(symbols) if whole else (None, None)
        own = {k: getattr(self, k) for k in (*COUNTS, "low", "high", "head", "tail")}
        return self.first | own | {"block": number, "whole": whole, "symbols": symbols, "cost": cost, "edits": edits}


def blocks_of(symbols: DataFrame, block_rows: int = BLOCK_ROWS, partitions: int | None = None) -> DataFrame:
    """The rows in order, as blocks numbered in order. A block that holds a whole conversation is solved at once.

    The first and the last conversation of a range partition may go on in another, so they don't count as whole.
    """
    by = ["conv_id", *KEY]
    ordered = (symbols.repartitionByRange(partitions, *by) if partitions else symbols.repartitionByRange(*by)).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId() << 32, []
        block, whole = None, False                                 # whole: the open block's conversation began in it, and here
        for b in batches:
            for row in b.to_pylist():
                if block is not None and row["conv_id"] != block.first["conv_id"]:
                    out.append(block.row(number, whole))
                    number, block, whole = number + 1, None, True
                left, repeats = row["copies"], False
                while left:
                    if block is not None and block.rows >= block_rows:
                        out.append(block.row(number, False))
                        number, block, whole = number + 1, None, False
                    block = block or Block(row)
                    n = min(left, block_rows - block.rows)
                    block.add(row, n, repeats)
                    left, repeats = left - n, True
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK_ARROW)
                out = []
        if block is not None:
            out.append(block.row(number, False))
        yield pa.RecordBatch.from_pylist(out, schema=_BLOCK_ARROW)

    return map_arrow(ordered, run, BLOCK)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_BLOCK_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in BLOCK.split(", "))])


# ------------------------------------------- conversations over several blocks
def _mapped(frame: DataFrame, make, schema: str) -> DataFrame:
    """``frame`` with a column more, made from each row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(made=[make(r) for r in f.itertuples(index=False)])

    return frame.mapInPandas(run, schema)


def _states(mask: int) -> frozenset[int]:
    return frozenset(q for q in range(4) if mask >> q & 1)


def _mask(states: frozenset[int]) -> int:
    return sum(1 << q for q in states)


def _border_prices(blocks: pd.DataFrame) -> pd.DataFrame:
    """Exact prices at the end of each block of a conversation, from the last to the first."""
    blocks, ends, out = blocks.sort_values("block"), closed(LAST), []
    for k in reversed(range(len(blocks))):
        costs = blocks["made"].iloc[k]
        out.append((blocks["block"].iloc[k], k + 1 == len(blocks), list(ends), 0))
        ends = tuple(min(min(int(costs[4 * q + e]) + ends[e] for e in range(4)), INFINITE) for q in range(4))
    out[-1] = (*out[-1][:3], ends[0])                              # the first block tells the conversation's cost
    return pd.DataFrame(out, columns=["block", "last", "ends", "cost"])


def _border_states(blocks: pd.DataFrame) -> pd.DataFrame:
    """The states in front of each block of a conversation that its least cheapest edits lead to."""
    blocks, mask, out = blocks.sort_values("block"), 1, []
    for block, exits in zip(blocks["block"], blocks["made"]):
        out.append((block, mask))
        mask = int(exits[mask])
    return pd.DataFrame(out, columns=["block", "mask"])


def solve_parts(parts: DataFrame) -> DataFrame:
    """(block, cost, edits) of conversations over several blocks; the cost stands with a conversation's first block."""
    ship_package(parts.sparkSession)
    own = parts.select("conv_id", "block", "symbols")
    costs = _mapped(own, lambda r: list(between(r.symbols)), "conv_id bigint, block bigint, symbols string, made array<bigint>")
    borders = written(costs.drop("symbols").groupBy("conv_id").applyInPandas(
        _border_prices, "block bigint, last boolean, ends array<bigint>, cost bigint"), "block-borders")
    priced = own.join(borders, "block").select("conv_id", "block", "symbols", "last", "ends", "cost")
    kept = "conv_id bigint, block bigint, symbols string, last boolean, ends array<bigint>, cost bigint"

    def exits(r) -> list[int]:
        prices = auction(r.symbols, tuple(map(int, r.ends)))
        return [0] + [_mask(trace(r.symbols, prices, _states(m), r.last)[1]) for m in range(1, 16)]

    left = written(_mapped(priced, exits, f"{kept}, made array<bigint>"), "block-exits")
    states = left.select("conv_id", "block", "made").groupBy("conv_id").applyInPandas(_border_states, "block bigint, mask int")
    chosen = left.drop("made").join(states, "block").select("conv_id", "block", "symbols", "last", "ends", "cost", "mask")
    return _mapped(chosen, lambda r: trace(r.symbols, auction(r.symbols, tuple(map(int, r.ends))), _states(r.mask), r.last)[0],
                   f"{kept}, mask int, made string").select("block", "cost", F.col("made").alias("edits"))


def solved_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, partitions: int | None = None) -> DataFrame:
    """All blocks of some rows with cost and edits, and counts that hold across the blocks of a conversation."""
    blocks = written(blocks_of(symbols_of(rows), block_rows, partitions), "conversation-blocks")
    parts = blocks.filter(~F.col("whole")).drop("cost", "edits")
    order = Window.partitionBy("conv_id").orderBy("block")
    border = F.concat(F.lag("tail").over(order), F.col("head"))
    parts = parts.withColumns({"more": F.coalesce((~border.isin(*LEGAL)).cast("int"), F.lit(0)),
                               "same": F.coalesce((F.lag("high").over(order) == F.col("low")).cast("int"), F.lit(0))})
    parts = (parts.join(solve_parts(blocks.filter(~F.col("whole"))), "block")
             .withColumns({"illegal": F.col("illegal") + F.col("more"), "turns": F.col("turns") - F.col("same")}))
    return written(blocks.filter("whole").unionByName(parts.select(blocks.columns)), "solved-blocks")


# -------------------------------------------------------------- repaired rows
def _in_order(rows: DataFrame, blocks: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Rows and the edits of blocks, each block in front of its first row, in one partition a conversation.

    ``kind`` 0: a row of ``heads``, in front of all; 1: a block's edits; 2: a row.
    """
    nothing = {"block": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string"), "edits": F.lit(None).cast("string")}
    stream = (keyed(rows).withColumns({c: nothing[c] for c in ("block", "edits")}).withColumn("kind", F.lit(2))
              .unionByName(blocks.select("conv_id", *KEY, "block", "edits").withColumns({"text": nothing["text"], "kind": F.lit(1)})))
    if heads is not None:
        stream = stream.unionByName(heads.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return (stream.withColumn("head", F.col("kind") == 0).repartition("conv_id")
            .sortWithinPartitions("conv_id", F.desc("head"), *KEY, "kind", "block").drop("head"))


def edited(stream: Iterator[dict]) -> Iterator[tuple[str, str, str | None, str]]:
    """(edit, role, role before, text) of a conversation's rows and blocks in order, insertions included."""
    state, todo, at = 0, "", 0

    def added() -> str:
        nonlocal state
        initial = ADDED[state]
        state = NEXT[state, initial]
        return ROLES[initial]

    for r in stream:
        if r["kind"] == 1:
            todo, at = todo[at:] + r["edits"], 0
            continue
        while todo[at] == "I":
            at += 1
            yield "I", added(), None, ""
        edit, at = todo[at], at + 1
        if edit == "K":
            state = NEXT[state, r["role"][:1]]
        yield edit, added() if edit == "R" else r["role"], r["role"], r["text"]
    for _ in todo[at:]:
        yield "I", added(), None, ""


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    rows = (r for b in batches for k in range(0, b.num_rows, 1_000) for r in b.slice(k, 1_000).to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


REPAIRED = "conv_id bigint, place bigint, edit string, role string, was string, text string"


def repaired_rows(rows: DataFrame, **kw) -> DataFrame:
    """(conv_id, place, edit, role, was, text): every edit of the cheapest repair in order; the rows whose edit isn't D
    are the repaired conversation. ``rows`` has conv_id and turn (bigint), role and text (no nulls)."""
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in REPAIRED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, stream in _conversations(batches):
            for place, (edit, role, was, text) in enumerate(edited(stream)):
                out.append((conv, place, edit, role, was, text))
                if len(out) >= 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return map_arrow(_in_order(rows, solved_blocks(rows, **kw)), run, REPAIRED)


REPORT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")


def conversation_report(conversations: DataFrame, **kw) -> DataFrame:
    """One row per original conversation, by the damaged rows: faults, cost and edits of the repair, digest of its rows."""
    rows = damaged(conversations)
    blocks = solved_blocks(rows, **kw)
    counts = blocks.select("conv_id", *COUNTS, "low", "high", "cost", F.struct("block", "edits").alias("part"))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    heads = (counts.unionByName(every, allowMissingColumns=True).groupBy("conv_id")
             .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "cost")],
                  F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list("part")).alias("parts"))
             .select("conv_id", F.struct(
                 F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate",
                 "truncated", "illegal", "cost", F.array_join(F.col("parts.edits"), "").alias("audit")).alias("report")))
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in REPORT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, stream in _conversations(batches):
            report, digest, sep = next(stream)["report"], hashlib.sha256(), ""
            for edit, role, _, text in edited(stream):
                if edit != "D":
                    digest.update(f"{sep}{role}:{text}".encode())
                    sep = "\n"
            out.append({"conv_id": conv, **report, "repaired_sha256": digest.hexdigest()})
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_arrow(_in_order(rows, blocks, heads), run, REPORT)

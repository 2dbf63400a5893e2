import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash

from ledgerline.llm import conversations as C

SHAPE = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """Cheapest (cost, edits, repaired rows) by best-first search over whole edit strings; rows are (role, text, fault)."""
    import heapq

    heap, seen = [(0, "", 0, ())], set()
    limit = 2 * len(rows) + 12
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        initials = "".join(role[:1] for role, _ in out)
        if at == len(rows) and SHAPE.fullmatch(initials):
            return cost, audit, out
        key = (audit, at, initials)
        if key in seen or len(audit) > limit or not any(SHAPE.fullmatch(initials + t) for t in ("", "a", "ua", "uaua")):
            continue
        seen.add(key)
        steps = [("I", 5, at, (role, "")) for role in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            steps.append(("D", 2, at + 1, None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role:
                    steps.append(("K", more, at + 1, (role, text)))
                steps += [("R", 1 + more, at + 1, (r, text)) for r in ("user", "assistant")]
        for edit, c, to, row in steps:
            heapq.heappush(heap, (cost + c, audit + edit, to, out + (() if row is None else (row,))))


def brute(rows):
    """The report by plain Python; rows are (conv_id, turn, role, text)."""
    shown = lambda x: " " if x is None else str(x)
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(),
                                *[signed(_hash(seed, r[2])) for seed in (1, 2)]))
        faults, seen = [], set()
        for _, role, text in own:
            last = text.rstrip(WHITE)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = brute_repair([(r, t, f) for (_, r, t), f in zip(own, faults)])
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def _hash(seed, text):
    """xxhash64(int, string): each column's hash seeds the next."""
    first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
    return xxhash.xxh64_intdigest(text.encode(), seed=first)


def conversations(seed, n=60, most=9):
    rnd, rows = random.Random(seed), []
    for conv in range(n):
        texts = ["Hello there.", "Why?", "no end", " \n", "", "ok!  \n", "a.b", "Yes!\x85", "x." + "\x0b"]
        for turn in range(rnd.randint(0, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "agent", "", None])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn, turn * 2, None]), role,
                         rnd.choice([*texts, None, f"own {rnd.random()}."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
ORDER = lambda r: (r[0] is not None, r[0] or 0)


@pytest.mark.parametrize("kw", [{}, {"block_rows": 2, "partitions": 3}, {"block_rows": 1}, {"partitions": 7}])
def test_report_equals_brute_force(spark, kw):
    rows = conversations(len(kw) + kw.get("block_rows", 5))
    got = C.conversation_report(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert [tuple(r) for r in sorted(got, key=ORDER)] == sorted(brute(rows), key=ORDER)


def test_auction_prices_and_edits_are_exact():
    symbols = "suaoSUAOx"
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(4):
        for own in itertools.product(symbols, repeat=n):
            rows = [("user", "", "blank") if c == "x" else (roles[c.lower()], "", "truncated" if c.isupper() else "") for c in own]
            cost, audit, _ = brute_repair(rows)
            assert C.repair("".join(own)) == (cost, audit), own
    rnd = random.Random(5)
    for _ in range(60):
        own = "".join(rnd.choice(symbols) for _ in range(rnd.randint(4, 8)))
        rows = [("user", "", "blank") if c == "x" else (roles[c.lower()], "", "truncated" if c.isupper() else "") for c in own]
        assert C.repair(own) == brute_repair(rows)[:2], own


def test_long_conversation_over_many_blocks(spark):
    rnd = random.Random(8)
    rows = [(1, t, rnd.choice(["user", "assistant", "assistant", "system", "tool"]), rnd.choice([f"row {t}.", f"row {t}", "same.", ""]))
            for t in range(3_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    [want], [got], [one] = [C.conversation_report(df, **kw).collect() for kw in ({}, {"block_rows": 50, "partitions": 4},
                                                                                {"block_rows": 100_000, "partitions": 1})]
    assert want == got == one
    assert got["cost"] == C.auction("".join(_symbols(df)), C.closed(C.LAST))[0][0]
    edits = C.repaired_rows(C.damaged(df), block_rows=64).orderBy("place").collect()
    assert "".join(r["edit"] for r in edits) == got["audit"]
    kept = [r for r in edits if r["edit"] != "D"]
    assert SHAPE.fullmatch("".join(r["role"][0] for r in kept))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == got["repaired_sha256"]


def _symbols(df):
    for r in sorted(C.symbols_of(C.damaged(df)).collect(), key=lambda r: (r["turn"], r["role"], r["h1"], r["h2"])):
        yield r["symbol"] + "x" * (r["copies"] - 1)


def test_edges(spark):
    assert C.conversation_report(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "gone.")]
    [got] = C.conversation_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert tuple(got) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # long texts, repeated rows, extra columns with clashing names
    rows = [(7, t % 3, "user", "word. " * 40_000 if t % 2 else "again.", 1, "x") for t in range(9)]
    df = spark.createDataFrame(rows, SCHEMA + ", block long, kind string")
    assert [tuple(r) for r in C.conversation_report(df, block_rows=4).collect()] == brute([r[:4] for r in rows])

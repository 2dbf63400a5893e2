import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from edge import edge_docs, no_docs

from ledgerline.llm import collocations as C


def brute(rows, min_count=10, top=2000, inside=50):
    """Every phrase counted in plain Python; rows are (lang, text)."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


COUNTS = "lang string, phrase string, n long"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["new", "york", "city", "The", "of", "a", "B", "ü", "日本", "x\xa0y", "\x00", "I'd", "(the)"]
    glue = [" ", "  ", "\t", ", ", ".", "\n", " ", " ", " ", "\r\n", "\x1c"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(glue) for _ in range(rnd.randint(0, 40)))
        if rnd.random() < 0.5:
            text += "New York City. new york city hall of a"
        rows.append((rnd.choice(["en", "en", "de", None]), text))
    return [*rows, ("en", None), ("fr", ""), (None, " ., ")]


@pytest.mark.parametrize("kw", [{}, {"burst": 3, "held": 20, "bits": 1 << 15}, {"min_count": 2, "burst": 1, "held": 1}])
def test_equals_brute_force_and_sql(spark, kw):
    rows = corpus(len(kw))
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, C.collocations(df, **kw).select(COLUMNS).collect()))
    least = kw.get("min_count", C.MIN_COUNT)
    assert got == brute(rows, least) and len(got) > 5
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    want = con.execute(C.oracle_sql(least)).df()[COLUMNS]
    assert got == sorted(tuple(x if isinstance(x, str) else int(x) for x in r) for r in want.itertuples(index=False))


def test_top_and_ties(spark):
    rows = corpus(9, 200)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = sorted(map(tuple, C.collocations(df, top=5).select(COLUMNS).collect()))
    assert got == brute(rows, top=5)


def test_trie_counts_and_spills_sorted_runs():
    rnd = random.Random(2)
    for words in (1, 2, 3):
        trie, want, got = C.HatTrie(words, burst=4), Counter(), Counter()
        for _ in range(60):
            keys = []
            for _ in range(rnd.randint(0, 30)):
                key = 0
                for _ in range(words):
                    key = key << C.WORD_BITS | min(rnd.randint(0, 6), rnd.randint(0, C.WORD_MASK))
                keys.append(key)
            want.update(keys)
            trie.count(np.array(keys, np.int64))
            if rnd.random() < 0.2:
                for keys, counts in trie.spill(5):
                    got.update(dict(zip(keys.tolist(), counts.tolist())))
                assert len(trie) <= 5
        run = [(k, n) for keys, counts in trie.run() for k, n in zip(keys.tolist(), counts.tolist())]
        assert run == sorted(run)
        got.update(dict(run))
        assert got == want


def test_bitmap_holds_its_phrases(spark):
    names = [f"w{i} ü{i % 7}" for i in range(500)]
    df = spark.createDataFrame([("en", p, 1) for p in names], COUNTS)
    bits = np.frombuffer(C.filter_bits(df, 2, 1 << 20), np.uint8)
    lang = C.Language("en", 3, np.full(1 << 10, 255, np.uint8), 10)
    for w in dict.fromkeys(w.encode() for p in names for w in p.split()):
        lang.learn(w)
    hashes = {t.decode(): np.array([h], np.uint64) for t, h in zip(lang.texts, lang.hashes)}
    assert all(C.in_bitmap(bits, C.phrase_hash([hashes[w] for w in p.split()]))[0] for p in names)
    assert np.unpackbits(bits).sum() <= 500


def test_scores_pass_64_bits(spark):
    a = 3_000_000_000_000
    one = [("en", "x", a), ("en", "y", a + 1), ("en", "z", a + 2)]
    tables = [spark.createDataFrame(r, COUNTS) for r in (one, [("en", "x y", a), ("en", "y z", a)], [("en", "x y z", a - 7)])]
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in C.candidates(tables).collect()}
    assert got == {"x y z": (a, a, 1_000_000 * (a - 7) ** 2 // (a * a))}


def test_blocks_hold_each_phrase_once():
    rnd = random.Random(4)
    for _ in range(300):
        texts = ["".join(rnd.choice(["a", "bb", "c", " ", "  ", "\n", ". ", "\t"]) for _ in range(rnd.randint(0, 30))) for _ in range(4)]
        for k in (1, 2, 3):
            got = Counter()
            for words in C.blocks([t.encode() for t in texts], k - 1, size=rnd.choice([1, 5, 1000])):
                words = [w for w in words if w]
                got.update(p for i in range(len(words) - k + 1) if b"\n" not in (p := tuple(words[i:i + k])))
            want = Counter()
            for piece in re.split(r"[.\n]", "\n".join(texts)):
                words = [w.encode() for w in re.findall(r"[^ \t]+", piece)]
                want.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
            assert got == want


def test_numbers_run_out(monkeypatch, spark):
    monkeypatch.setattr(C, "WORD_MASK", 63)
    trie = C.Language("en", 1, None, 1000)
    got = Counter()
    for k in range(20):
        for run in trie.count([" ".join(f"w{(k * 7 + i) % 90}" for i in range(20)).encode()], None):
            for b in trie.rows(run):
                got.update({r["phrase"]: r["n"] for r in b.to_pylist()})
    for b in trie.rows(trie.trie.run()):
        got.update({r["phrase"]: r["n"] for r in b.to_pylist()})
    assert sum(got.values()) == 400 and trie.seen == 400


def test_edges(spark):
    docs = edge_docs(spark)
    got = C.collocations(docs).collect()
    assert {r["lang"] for r in got} == {"en"} and got[0]["a"] >= 10
    assert C.collocations(no_docs(spark)).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None)] * 3, "lang string, text string")).count() == 0

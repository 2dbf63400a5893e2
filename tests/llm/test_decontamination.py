import hashlib
import random

import numpy as np
from edge import ROWS, edge_docs, no_docs, words
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import decontamination as D


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_index_counts_and_locates(text, phrase):
    t = np.array([*text, 0], np.int64)
    index = D.FMIndex(t, 3, sample=4)
    sp, ep = index.search(np.array([phrase]))
    want = [i for i in range(len(t) - len(phrase) + 1) if t[i:i + len(phrase)].tolist() == phrase]
    assert ep[0] - sp[0] == len(want)
    assert sorted(index.locate(np.arange(sp[0], ep[0])).tolist()) == want


def test_wavelet_rank():
    seq = np.random.default_rng(1).integers(0, 9, 300)
    tree = D.WaveletMatrix(seq, 8)
    for c in range(9):
        i = np.arange(301)
        assert tree.rank(np.full(301, c), i).tolist() == [int((seq[:k] == c).sum()) for k in i]


def brute(docs, items, window=10):
    held = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in held}:
            for k in range(len(w) - n + 1):
                if own := held.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def small_tables(spark, seed=3):
    rnd = random.Random(seed)
    vocab = ["the", "a", "Of", "x", "on", "in"]
    items = [("q1", " ".join(rnd.choice(vocab) for _ in range(25))), ("q2", "The, A. of!"), ("q10", ""), (None, "on on on on"),
             ("q3", None), ("q1", "x x x x x x x x x x x x")]
    docs = []
    for i in range(60):
        t = [rnd.choice(vocab + ["y"]) for _ in range(rnd.randint(0, 60))]
        if i % 4 == 0:
            q = items[0][1].split()
            k = rnd.randint(0, 12)
            t[5:5] = q[k:k + rnd.randint(8, 13)]
        docs.append((i, rnd.choice([" ", "-", ".\n"]).join(t)))
    docs += [(100, items[0][1]), (101, None), (102, items[0][1])]
    return docs, items


def test_report_equals_brute_force(spark):
    docs, items = small_tables(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute(docs, [(i or "", t) for i, t in items])
    for kw in ({}, {"shard_words": 20}, {"slice_chars": 40}):
        assert sorted(map(tuple, D.contamination_report(df, bench, **kw).collect())) == sorted(want)


def test_removal(spark):
    bench = spark.createDataFrame([("b", "one two three four five six seven eight nine ten")], "item_id string, text string")
    docs = [(1, "Keep this. One two three, four five six seven eight nine TEN! And this.", 7, "x"),
            (2, "one two three four five six seven eight nine ten", 7, "x"), (3, "clean text", 7, None), (4, None, 7, "x")]
    out = {r["doc_id"]: r for r in D.remove_contamination(
        spark.createDataFrame(docs, "doc_id long, text string, n_chars int, _spans string"), bench).collect()}
    assert out[1]["text"] == "Keep this. ! And this." and out[1]["n_chars"] == len(out[1]["text"])
    assert 2 not in out and out[3]["text"] == "clean text" and out[4]["text"] is None and out[3]["n_chars"] == 7


def test_edges(spark):
    bench = spark.createDataFrame([(1, "zzz")], "item_id long, text string")
    for docs, n in ((edge_docs(spark), len(ROWS)), (no_docs(spark), 0)):
        assert D.contamination_report(docs, bench).count() == n
        assert D.contamination_report(docs, bench.limit(0)).count() == n
        cleaned = D.remove_contamination(docs, bench)
        assert cleaned.columns == docs.columns and cleaned.count() == n

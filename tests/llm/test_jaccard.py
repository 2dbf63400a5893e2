import random

import pytest
from edge import ROWS, edge_docs, no_docs

from ledgerline.llm import jaccard as J
from ledgerline.llm.components import connected_components


def shingles(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_copies(seed, groups=25, n=160):
    """Short and long texts, edited copies around the threshold, one large group, a passage that many share."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    bases = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 6, 8, 10, 12, 15, 40, 90]))] for _ in range(groups)]
    rows = []
    for i in range(n):
        t = list(bases[0] * 3 if i % 4 == 0 else rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        if i % 7 == 0:
            t = t + passage
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(t)))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n ")]


@pytest.mark.parametrize("seed,heavy", [(1, 64), (2, 4)])
def test_components_equal_brute_force(spark, seed, heavy, monkeypatch):
    monkeypatch.setattr(J, "HEAVY", heavy)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_report(df).collect())) == brute(rows)


def test_cost_chosen_boundary_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(J, "choose_boundary", lambda h: 9)
    rows = near_copies(3, n=120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_report(df).collect())) == brute(rows)


def test_sizes():
    for n in range(1, 40):
        for m in range(1, 40):
            o = J.least_overlap(n, m)
            assert o > min(n, m) or J.links(o, n, m) and not J.links(o - 1, n, m)
            if o <= min(n, m):  # linked sets meet within both prefixes
                assert J.prefix(n) + o > n and J.prefix(m) + o > m
    assert J.choose_boundary({}) == 0 and 0 < J.choose_boundary({1: 1000, 2: 1000, 3: 10}) <= J.MAX_SMALL


def test_connected_components(spark):
    rnd = random.Random(1)
    pairs = [(k, k + 1) for k in range(40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(25)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41))
    for a, b in pairs:
        if a != b:
            assert got[a] == got[b] <= min(a, b)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    rows = J.jaccard_report(edge_docs(spark)).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[4]["n_shingles"] == 1
    assert J.jaccard_report(no_docs(spark)).count() == 0
    kept = J.keep_representatives(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns and kept.count() == len(ROWS)


def test_representatives_of_repeated_ids(spark):
    a, b = "one two three four five six seven", "other words that nobody else has here today"
    docs = spark.createDataFrame([(2, a), (5, b), (5, a), (None, a), (7, a)], "doc_id long, text string")
    kept = sorted(map(str, ((r.doc_id, r.text) for r in J.keep_representatives(docs).collect())))
    assert kept == sorted(map(str, [(2, a), (5, b), (None, a)]))

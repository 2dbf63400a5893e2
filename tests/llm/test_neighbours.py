import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import neighbours as N


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows],
                                 "vec_id long, embedding array<float>, label int")


def brute(rows, k=5):
    good = [(i, np.array(v, np.float32)) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    ids = np.array([i for i, _ in good])
    out = {}
    for q, v in good:
        if q % 50 == 0:
            s = np.array([N.cosine(v, u) for _, u in good])
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    rnd = np.random.default_rng(5)
    centers = rnd.standard_normal((12, 24))
    rows = [(i, centers[i % 12] + 0.6 * rnd.standard_normal(24)) for i in range(2500)]
    got, want = answers(N.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    scores = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(scores[q, i] - s) < 1e-12 for q in got for i, s in got[q] if (q, i) in scores)


def test_hot_vector_ties_and_bad_rows(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)] + [(i, rnd.standard_normal(3)) for i in range(300, 420)]
    rows += [(500, None), (550, [0.0, 0.0, 0.0]), (600, [1.0, None, 2.0]), (650, [1.0, float("nan"), 2.0]),
             (700, [float("inf"), 1.0, 2.0]), (750, [1.0, 2.0])]
    got, want = answers(N.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0)), brute([r for r in rows if r[0] != 750])
    assert got.keys() == want.keys()
    for q in (0, 50, 250):
        assert [i for i, _ in got[q]] == [i for i in range(7) if i != q][:5]
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_few_and_none(spark):
    got = answers(N.nearest(vectors(spark, [(0, [1, 0]), (1, [1, 1]), (2, [0, 1])]), F.col("vec_id") % 50 == 0))
    assert [i for i, _ in got[0]] == [1, 2]
    assert N.nearest(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert N.nearest(vectors(spark, [(0, [1, 0])]), F.col("vec_id") % 50 == 0).count() == 0


def recall(spark, rows):
    got, want = answers(N.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows)
    assert got.keys() == want.keys()
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want))


def test_near_and_scaled_copies(spark):
    rnd = np.random.default_rng(8)
    base, other = rnd.standard_normal((2, 64))
    far = [(5000 + i, rnd.standard_normal(64)) for i in range(300)]
    near = [(i, base + (1e-3, 3e-3)[i // 1000] * rnd.standard_normal(64)) for i in range(2000)]
    scaled = [(2000 + i, other * (i + 1)) for i in range(1000)]
    assert recall(spark, near + far) >= 0.9
    assert recall(spark, scaled + far) >= 0.9
    # equal scores: the smaller ids
    doubled = [(i, base * 2.0 ** (i % 120 - 60)) for i in range(120)]
    got = answers(N.nearest(vectors(spark, doubled), F.col("vec_id") % 50 == 0))
    assert all([i for i, _ in got[q]] == [i for i in range(7) if i != q][:5] for q in (0, 50, 100))


def test_search_goes_on_while_nodes_are_open(spark, monkeypatch):
    # a chain of 12 nodes on an arc; the query's own list holds its far end only
    monkeypatch.setattr(N, "ENTRIES", 0)
    nodes = N.vector_nodes(vectors(spark, [(i, [np.cos(0.1 * i), np.sin(0.1 * i)]) for i in range(12)])).cache()
    graph = spark.createDataFrame([(i, [(0.0, i - 1 if i else 11, True)]) for i in range(12)],
                                  "node long, list array<struct<sim:double, id:long, new:boolean>>")
    found = N.search(graph, nodes, nodes.select("node").filter("node = 0"))
    assert {r["id"] for r in found.collect()} == set(range(1, 12))


def test_beam_and_rounds_grow():
    assert N.grown(N.BEAM, 100) == N.BEAM < N.grown(N.BEAM, 50_000) < N.grown(N.BEAM, 10**8)

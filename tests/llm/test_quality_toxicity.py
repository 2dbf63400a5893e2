import math
import random
import zlib

import numpy as np
from edge import ROWS, edge_docs, no_docs

from ledgerline.llm import features, quality, toxicity
from ledgerline.llm.common import table
from ledgerline.llm.features import word_features


def corpus(spark, n=600, seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        good, toxic = i % 4 != 0, i % 5 == 0
        if not good:
            w = [f"{x}{rnd.choice(['!!', '###', '$$'])}" for x in w]
        if toxic:
            for _ in range(rnd.randint(1, 8)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vileword", "nastyterm"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 60 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    kept = {r["doc_id"] for r in quality.keep_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert kept == {r["doc_id"] for r in scored.filter("predicted = 1").collect()}


def test_quality_on_given_table(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = quality.score_quality(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)


def test_dual_coordinate_descent_reaches_the_optimum():
    rnd = np.random.default_rng(0)
    rows = [np.flatnonzero(rnd.random(6) < 0.5) for _ in range(40)]
    values = [np.ones(len(r)) for r in rows]
    y = np.array([int(0 in r) for r in rows])
    w, b = quality.dual_coordinate_descent(rows, values, y, 6, penalty=1.0, epochs=400)
    sign = np.where(y == 1, 1, -1)
    share = (y == 1).mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) if share < 0.5 else np.where(y == 0, 0.5 / (1 - share), 0.5 / share)
    x = np.zeros((40, 7))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, 6] = 1
    own = np.append(w, b)
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    for _ in range(300):
        assert value(own) <= value(own + 0.05 * rnd.standard_normal(7)) + 1e-6


def test_toxicity_finds_planted_words(spark):
    docs, labels = corpus(spark, 800)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(
        labels.withColumnRenamed("toxic", "marked"), "doc_id").filter("held_out").collect()
    assert sum(r["toxic"] == (r["marked"] == 1) for r in scored) >= 0.97 * len(scored)
    assert all(0 <= r["expected_severity"] <= 3 and abs(r["score"]) <= 1 for r in scored)


def test_thresholds_are_ordered_and_weights_shared():
    rnd = np.random.default_rng(2)
    grade = rnd.integers(0, 4, 400)
    rows = [np.array([1] * int(g >= 1) + [2] * int(g >= 2) + [3] * int(g >= 3) + [9 + int(rnd.integers(0, 3))]) for g in grade]
    model = toxicity.fit(rows, grade, np.array([1, 2, 3, 9, 10, 11]), 4, 16)
    assert (np.diff(model.thresholds) > 0).all()
    expected = [model.at_least(np.unique(r)).sum() for r in rows]
    means = [np.mean([e for e, g in zip(expected, grade) if g == k]) for k in range(4)]
    assert means == sorted(means) and np.abs(np.array(means) - np.arange(4)).max() < 0.4


def test_frequent_stems():
    a, b = word_features(b"prefixa one two three"), word_features(b"prefixb four")
    assert set(a) & set(b)
    assert len(word_features(b"")) == 0


def test_edges(spark):
    docs, labels = corpus(spark, 100)
    q, t = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    for frame, n in ((edge_docs(spark), len(ROWS)), (no_docs(spark), 0)):
        assert quality.score_quality(frame, q).count() == n
        assert toxicity.score_toxicity(frame, t).count() == n
        assert quality.keep_quality(frame, q).columns == frame.columns
    none = labels.filter("false")
    assert quality.score_quality(docs, quality.fit_quality(docs, none)).filter("score <> 0.5").count() == 0
    one = quality.score_quality(docs, quality.fit_quality(docs, labels.filter("quality = 1"))).filter("score < 0.9").count()
    assert one == 0
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).filter("toxic").count() == 0


def test_the_sample_is_bounded(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i} {k % 3} " + "x" * 90) for i in ids for k in range(40)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(ids[0], 0), (ids[1], None)], "doc_id long, quality int")
    draw = lambda **kw: features.labelled_sample(docs, labels, "quality", **kw).collect()
    assert len(draw()) == len(ids) == len({r["text"].split()[1] for r in draw()})
    assert len(draw(rows=2)) == 2                                       # repeated rows of an id count once
    some = draw(chars=1_000)
    assert 0 < len(some) < len(ids) and sum(len(r["text"]) for r in some) <= 1_000
    assert draw(chars=5) == []
    assert sorted(map(str, draw())) == sorted(map(str, features.labelled_sample(docs.repartition(5), labels, "quality").collect()))


def brute_grams(text):
    """Buckets of a text's byte n-grams, one by one."""
    raw, out = text.encode(), set()
    mult = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]
    for i in range(len(raw) - 3):
        h = sum(raw[i + k] * mult[k] for k in range(4)) & 0xFFFFFFFF
        h ^= h >> 15
        out.add((h * mult[0] & 0xFFFFFFFF) >> 14)
    if len(raw) < 4:
        return out
    run = best = 0
    words = text.encode().split()
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 0
        best = max(best, run)
    return out | {(1 << 18) + k for k in range(min(best, 16))}


def test_quality_equals_brute_force(spark):
    """Ratios, values and scores of the fitted model recomputed in plain Python from the texts."""
    docs, labels = corpus(spark, 80)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    model = quality.fit_quality(docs, labels)
    count, total = [dict(), dict()], [0, 0]
    grams = {i: brute_grams(t) for i, t in texts.items()}
    for i in train:
        for g in grams[i]:
            count[y[i]][g] = count[y[i]].get(g, 0) + 1
    seen = set().union(*(grams[i] for i in train))
    rows = [np.array(sorted(grams[i])) for i in train]
    ratio = quality.log_count_ratios(rows, np.array([y[i] for i in train]), features.BUCKETS)
    total = [sum(c.values()) + features.BUCKETS for c in count]
    for g in list(seen)[:300]:
        want = math.log((count[1].get(g, 0) + 1) / total[1]) - math.log((count[0].get(g, 0) + 1) / total[0])
        assert abs(ratio[g] - want) < 1e-9
    assert np.allclose(model.ratio, ratio)
    for r in quality.score_quality(docs, model).collect():
        own = sorted(grams[r["doc_id"]])
        norm = math.sqrt(sum(ratio[g] ** 2 for g in own)) or 1.0
        margin = sum(model.weights[g] for g in own) / norm + model.bias
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.slope * margin + model.offset)))) < 1e-9


def test_severity_equals_brute_force(spark):
    """Expected severity is the sum of P(grade >= k) over the thresholds, from weights shared by all of them."""
    docs, labels = corpus(spark, 120)
    model = toxicity.fit_toxicity(docs, labels)
    for r in toxicity.score_toxicity(docs, model).join(docs, "doc_id").collect():
        own = {int(f) for f in word_features(r["text"].encode()) if model.weights[f] != 0}
        x = sum(model.weights[f] for f in own)
        at_least = [1 / (1 + math.exp(-(x - t))) for t in model.thresholds]
        assert abs(r["expected_severity"] - sum(at_least)) < 1e-9 and abs(r["score"] - at_least[0]) < 1e-9
        mass = [a - b for a, b in zip([1, *at_least], [*at_least, 0])]
        assert r["grade"] == mass.index(max(mass)) and all(m >= -1e-12 for m in mass)

"""Operator 3, approximate nearest neighbours: NN-descent and greedy graph search.

Equal vectors are one node (named by its smallest id), which keeps its ``MEMBERS`` smallest ids: no more can be
among the answers of one query, as ties go to smaller ids. So a vector that a third of all rows share is one
node.

**Graph.** Each node keeps its ``K`` nearest found. The first lists come from blocks of the nodes sorted by nearest
pivot and a random projection, a few times over. Then each round joins the members of every node's
neighbourhood (its neighbours and a sample of the nodes that list it) with their vectors, compares them pairwise
and keeps what improves a list, until hardly any entry changes.

**Search.** A query starts at its own node's list and a few entry points. Each round expands the best ``BEAM``
nodes found that aren't expanded yet: their neighbours are joined, compared and kept, until none is left. The beam and
the bound on the graph's rounds grow with the logarithm of the number of nodes.

All comparisons, of lists as of the search, are in double precision on the original vectors, so near copies
are told apart; ties go to the smaller id. Every row is indexed.

**Groups.** Vectors that agree in direction to about a hundredth of a component (one ``code``), such as scaled copies
or very near ones, are compared with each query of their group exactly, in blocks. So no list or beam, however short
against the group, cuts its true neighbours.

Recall against brute force is measured in the tests (0.9 at least).

Defined results: rows that are null, zero, or hold null or non-finite components take no part, nor do rows whose
number of components isn't the commonest; repeated ids count once per distinct vector; fewer candidates than
asked give fewer answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_arrow, written

ANSWERS = 5
MEMBERS = ANSWERS + 1
K = 32
REVERSE = 24         # nodes that list a node, sampled for its neighbourhood (in expectation)
ROUNDS = 12          # at most, up to 2 ** GROWN_FROM nodes; more with their logarithm
SETTLED = 0.003      # share of list entries that a last round may change
INITS = 6
FIRST = 16           # neighbours kept by each first list
MOST_PIVOTS = 4096   # sent to all tasks
BLOCK = 2048
GROUP_BLOCK = 2048   # members, and queries, of one cell of a group
BEAM = 96            # up to 2 ** GROWN_FROM nodes; more with their logarithm
GROWN_FROM = 12
ENTRIES = 4


BROADCAST_BYTES = 32 * 1024 * 1024


def _side(df: DataFrame, rows: int, width: int) -> DataFrame:
    """A join side that is broadcast if its rows, at their known width, stay within the bound; else shuffled."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


ROWS_A_TASK = 100_000


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than its number of rows (an estimate) asks for, but enough for all cores."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, int(rows) // ROWS_A_TASK))


def grown(base: int, n: int) -> int:
    """``base``, grown with the logarithm of the number of nodes."""
    return math.ceil(base * max(1.0, math.log2(max(n, 1)) / GROWN_FROM))


# -------------------------------------------------------------- vectors
def vector_nodes(vectors: DataFrame) -> DataFrame:
    """(node, members, vec, code): distinct valid vectors, float32 bytes and a hash of the coarse direction."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e")) \
        .filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0))
    common = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, list[int]] = {}
        for b in batches:
            e = b.column("e")
            flat = np.asarray(e.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim) + np.float32(0)  # no -0
            good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            for i, v in zip(b.column("vec_id").to_numpy()[good].tolist(), flat[good]):
                own = least.setdefault(v.tobytes(), [])
                own.append(i)
                if len(own) > 64:
                    own[:] = sorted(set(own))[:MEMBERS]
        for k in range(0, len(least), 4096):
            part = list(least.items())[k:k + 4096] if len(least) <= 4096 else [*_slice(least, k, 4096)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in part], pa.binary()),
                                              pa.array([sorted(set(m))[:MEMBERS] for _, m in part], pa.list_(pa.int64()))],
                                             names=["vec", "ids"])

    some = map_arrow(rows.filter(F.size("e") == dim), run, "vec binary, ids array<bigint>")
    nodes = (some.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, MEMBERS)
                                     .alias("members"))
             .select(F.element_at("members", 1).alias("node"), "members", "vec"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([_coarse(np.frombuffer(v, np.float32)).tobytes() for v in b.column("vec").to_pylist()],
                                      pa.binary())], names=[*b.schema.names, "code"])

    coded = map_arrow(nodes, code, "node bigint, members array<bigint>, vec binary, code binary")
    return coded.withColumn("code", F.xxhash64("code"))


def _slice(d: dict, start: int, n: int) -> Iterator:
    from itertools import islice
    return islice(d.items(), start, start + n)


def _coarse(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max()
    return np.rint(v * 127).astype(np.int8)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision, from a column of original vectors."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, 1))
    m = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


# ---------------------------------------------------------------- graph
EDGES = "node bigint, id bigint, sim double, new boolean"


def _edges(node, ident, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(ident, pa.int64()), pa.array(sim, pa.float64()),
                                       pa.array(np.ones(len(node), bool))], names=["node", "id", "sim", "new"])


def first_lists(nodes: DataFrame, seed: int, k: int) -> DataFrame:
    """Edges to the nearest of a block of nodes that are neighbours in an order by pivot and projection.

    About one pivot a block, as far as their bound allows.
    """
    n = min(max(nodes.count() // BLOCK, 4), MOST_PIVOTS)
    pivots = (nodes.select("node", "vec").orderBy(F.xxhash64(F.lit(seed), F.col("node"))).limit(n).toArrow())
    sent = nodes.sparkSession.sparkContext.broadcast(_matrix(pivots.column("vec")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        direction = np.random.default_rng(seed).standard_normal(p.shape[1]) if len(p) else None
        for b in batches:
            m = _matrix(b.column("vec"))
            if len(m):
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array((m @ p.T).argmax(axis=1).astype(np.int32)),
                                                  pa.array(m @ direction), b.column("vec")],
                                                 names=["node", "pivot", "along", "vec"])

    placed = map_arrow(nodes.select("node", "vec"), place, "node bigint, pivot int, along double, vec binary")
    placed = placed.repartitionByRange("pivot", "along").sortWithinPartitions("pivot", "along")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.zeros(0, np.int64), None
        for b in batches:
            m = _matrix(b.column("vec"))
            ids, rows = np.concatenate([ids, b.column("node").to_numpy()]), m if rows is None else np.concatenate([rows, m])
            while len(ids) >= 2 * BLOCK:  # the last rows stay until their number is known
                yield _block(ids[:BLOCK], rows[:BLOCK], k)
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        half = len(ids) if len(ids) <= BLOCK else len(ids) // 2
        for a, b in ((0, half), (half, len(ids))):
            if b - a > 1:
                yield _block(ids[a:b], rows[a:b], k)

    return map_arrow(placed, compare, EDGES)


def _block(ids: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    sims = rows @ rows.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sims, best, axis=1).min(axis=1, keepdims=True)
    for i in np.flatnonzero((sims >= least).sum(axis=1) > k):  # a tie at the end of the list
        best[i] = np.lexsort((ids, -sims[i]))[:k]
    return _edges(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sims, best, axis=1).ravel())


def _first(k: int, *more: str):
    """An aggregate: the ``k`` most similar (sim, id, ...), ties to the smaller id."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "id", *more))), 1, k)
    return F.transform(best, lambda e: F.struct((-e["far"]).alias("sim"), e["id"].alias("id"), *[e[m].alias(m) for m in more]))


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """(node, list): the k most similar of each node's edges; an edge seen before is not new."""
    one = edges.repartition("node").groupBy("node", "id").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return one.groupBy("node").agg(_first(k, "new").alias("list"))


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot: all pairs of a neighbourhood with a new member that improve one of their lists."""
    held: list[tuple] = []
    for b in batches:
        held.append((b.column("pivot").to_numpy(), b.column("id").to_numpy(), _matrix(b.column("vec")),
                     b.column("kth").to_numpy(), np.asarray(b.column("new").to_numpy(zero_copy_only=False), bool)))
        pivot, *rest = (np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(pivot, pivot[-1])) if len(pivot) else 0
        if last:
            yield _compare(pivot[:last], *(x[:last] for x in rest))
        held = [tuple(x[last:] for x in (pivot, *rest))]
    if held and len(held[0][0]):
        yield _compare(*held[0])


def _compare(pivot, ids, unit, kth, new) -> pa.RecordBatch:
    bounds = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1], [True]]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a < 2 or not new[a:b].any():
            continue
        m, i, t, fresh = unit[a:b], ids[a:b], kth[a:b], new[a:b]
        sims = m @ m.T
        use = (sims >= t[:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(use, False)
        x, y = np.nonzero(use)
        out.append((i[x], i[y], sims[x, y]))
    if not out:
        return _edges(*[np.zeros(0)] * 3)
    return _edges(*(np.concatenate(x) for x in zip(*out)))


def build_graph(nodes: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(node, list) with list an array of (sim, id, new), most similar first."""
    edges = first_lists(nodes, 1, min(k, FIRST))
    for seed in range(2, INITS + 1):
        edges = edges.unionByName(first_lists(nodes, seed, min(k, FIRST)))
    graph = written(_tasks(best_lists(edges, k), nodes.count() * k), "knn-graph")
    n, dim = nodes.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    units = nodes.select(F.col("node").alias("id"), "vec")
    total = graph.select(F.sum(F.size("list"))).first()[0] or 0
    for r in range(grown(rounds, n)):
        flat = graph.select("node", F.explode("list").alias("e")).select("node", "e.id", "e.sim", "e.new")
        degree = flat.groupBy("id").agg(F.count(F.lit(1)).alias("in"))
        # a node listed by many is joined with a sample of them, new each round
        back = (flat.join(_side(degree, n, 24), "id")
                .filter(F.pmod(F.xxhash64(F.lit(r), "id", "node"), F.lit(1 << 30)) * F.col("in") < REVERSE * float(1 << 30))
                .select(F.col("id").alias("pivot"), F.col("node").alias("id"), "new"))
        near = flat.select(F.col("node").alias("pivot"), "id", "new").unionByName(back)
        near = near.repartition("pivot").groupBy("pivot", "id").agg(F.max("new").alias("new"))
        kth = graph.select(F.col("node").alias("id"), F.when(F.size("list") >= k, F.element_at("list", -1)["sim"])
                           .otherwise(F.lit(-2.0)).alias("kth"))
        known = _side(units.join(_side(kth, n, 24), "id"), n, (dim or 0) + 40)
        rows = near.join(known, "id").select("pivot", "id", "vec", "kth", "new")
        if n * ((dim or 0) + 40) > BROADCAST_BYTES:
            rows = rows.repartition("pivot")  # the shuffle join has dealt them by member
        found = map_arrow(_tasks(rows, n * (k + REVERSE)).sortWithinPartitions("pivot"), _local_join, EDGES)
        found = found.groupBy("node", "id").agg(F.max("sim").alias("sim")).withColumn("new", F.lit(True))
        graph = written(_tasks(best_lists(flat.withColumn("new", F.lit(False)).unionByName(found), k), n * k), "knn-graph")
        changed = graph.select(F.sum(F.size(F.filter("list", lambda e: e["new"])))).first()[0] or 0
        if changed <= SETTLED * total:
            break
    return graph


# --------------------------------------------------------------- search
def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, id, sim): the best that the greedy search of each query node has found, ``beam`` nodes (grown) at most.

    The state is one row a query, its beam. What has been seen stands in a table per round, written once and then only
    read to leave it out.
    """
    own = queries.select(F.col("node").alias("query")).distinct()
    own = written(own.join(nodes.select(F.col("node").alias("query"), F.col("vec").alias("own")), "query"), "knn-queries")
    n, dim = nodes.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    q, width, beam = own.count(), (dim or 0) + 24, grown(beam, n)
    units = _side(nodes.select(F.col("node").alias("id"), "vec"), n, width)
    near = _side(graph.select(F.col("node").alias("id"), F.col("list.id").alias("next")), n, 8 * K + 40)
    entries = [r["node"] for r in nodes.select("node").orderBy(F.xxhash64(F.lit(0), "node")).limit(ENTRIES).collect()]
    starts = own.select("query", F.explode(F.array(*[F.lit(e).cast("bigint") for e in entries])).alias("id")) if entries else None
    start = own.select("query", F.col("query").alias("id")).join(near, "id").select("query", F.explode("next").alias("id"))
    if starts is not None:
        start = start.unionByName(starts)
    state, front, visited = None, None, []
    new = start.filter("id <> query").distinct()
    while True:  # a node is expanded once for a query, so this ends
        # what a round looks at is written and only read again, to leave out what was seen before
        new = written(_tasks(new, q * beam * K // 2), "knn-visited")
        visited.append(new)
        rows = new.join(_side(own, q, width), "query").join(units, "id").select("query", "id", "own", "vec")
        scored = map_arrow(rows, _similar, "query bigint, id bigint, sim double").withColumn("open", F.lit(True))
        if state is not None:                                      # all that stood open has been expanded
            kept = state.select("query", F.explode("b").alias("b")).select("query", "b.id", "b.sim", F.lit(False).alias("open"))
            scored = scored.unionByName(kept)
        # one row a query: its beam
        state = written(scored.groupBy("query").agg(_first(beam, "open").alias("b")), "knn-beams")
        front = state.select("query", F.explode("b").alias("b")).filter("b.open").select("query", F.col("b.id").alias("id"))
        if front.isEmpty():
            break
        seen = visited[0]
        for v in visited[1:]:
            seen = seen.unionByName(v)
        reached = front.join(near, "id").select("query", F.explode("next").alias("id")).filter("id <> query").distinct()
        new = reached.join(seen, ["query", "id"], "left_anti")
    return state.select("query", F.explode("b").alias("b")).select("query", "b.id", "b.sim")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sims = (_matrix(b.column("own")) * _matrix(b.column("vec"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array(sims.astype(np.float64))],
                                         names=["query", "id", "sim"])


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = [cosine(np.frombuffer(x, np.float32), np.frombuffer(y, np.float32))
                  for x, y in zip(b.column("own").to_pylist(), b.column("vec").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("query"), b.column("members"), pa.array(scores, pa.float64())],
                                         names=["query", "members", "score"])


# --------------------------------------------------------------- groups
def group_answers(nodes: DataFrame, asked: DataFrame, answers: int) -> DataFrame:
    """(query, id): for each query node, the nearest nodes of its own code, compared exactly.

    A group's members and queries are dealt to blocks by hash; each pair of blocks is one cell, compared on its own.
    """
    own = nodes.join(asked.select("node"), "node", "left_semi").groupBy("code").agg(F.count(F.lit(1)).alias("asking"))
    size = (nodes.groupBy("code").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").join(own, "code")
            .select("code", F.ceil(F.col("held") / GROUP_BLOCK).cast("int").alias("nm"),
                    F.ceil(F.col("asking") / GROUP_BLOCK).cast("int").alias("nq")))
    held = written(nodes.select("code", "node", "vec").join(size, "code"), "knn-groups")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = held.select("code", block("nm").alias("mb"), every("nq").alias("qb"), F.lit(False).alias("asks"), "node", "vec")
    queries = (held.join(asked.select("node"), "node", "left_semi")
               .select("code", every("nm").alias("mb"), block("nq").alias("qb"), F.lit(True).alias("asks"), "node", "vec"))
    cells = members.unionByName(queries).repartition("code", "mb", "qb").sortWithinPartitions("code", "mb", "qb", "asks", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            keys = np.stack([rest.column(c).to_numpy() for c in ("code", "mb", "qb")], axis=1)
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            at = 0
            for end in starts.tolist():
                yield _cell(rest.slice(at, end - at), answers)
                at = end
            rest = rest.slice(at)
        if rest is not None and len(rest):
            yield _cell(rest, answers)

    near = map_arrow(cells, run, "query bigint, id bigint, sim double")
    return near.groupBy("query").agg(_first(answers + 1).alias("b")).select("query", F.explode("b.id").alias("id"))


def _cell(t: pa.Table, answers: int) -> pa.RecordBatch:
    """Of each query of a cell, its nearest members by :func:`cosine`, ties to the smaller id."""
    asks = np.asarray(t.column("asks").to_numpy(), bool)
    ids = t.column("node").to_numpy()
    rows = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(len(ids), -1).astype(np.float64)
    norm = np.array([np.sqrt(np.dot(x, x)) for x in rows])
    m, q = np.flatnonzero(~asks), np.flatnonzero(asks)
    out: list[tuple[int, int, float]] = []
    if len(m) and len(q):
        unit = rows / norm[:, None]
        for i, sims in zip(q.tolist(), unit[q] @ unit[m].T):
            # rounding differs between a product of matrices and one of two vectors: the latter decides near the end
            least = np.partition(sims, -min(answers + 1, len(m)))[-min(answers + 1, len(m))]
            some = m[sims >= least - 1e-13]
            exact = np.array([np.dot(rows[i], rows[j]) / (norm[i] * norm[j]) for j in some])
            for j in np.lexsort((ids[some], -exact))[:answers + 1]:
                out.append((int(ids[i]), int(ids[some[j]]), float(exact[j])))
    query, ident, sim = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ident, pa.int64()), pa.array(sim, pa.float64())],
                                      names=["query", "id", "sim"])


def nearest(vectors: DataFrame, is_query, answers: int = ANSWERS, k: int = K, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    nodes = written(vector_nodes(vectors), "knn-nodes")
    # the node of each query row: of the same vector
    wanted = vectors.filter(is_query).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    asked = written(vector_nodes(wanted).select("vec").join(nodes.select("vec", "node"), "vec").select("node"), "knn-asked")
    graph = build_graph(nodes, k)
    found = search(graph, nodes, asked, beam)
    n = nodes.count()
    vecs = nodes.select("node", "vec", "members")
    best = (found.groupBy("query").agg(_first(max(grown(beam, n), answers)).alias("b"))
            .select("query", F.explode("b.id").alias("id"))
            .unionByName(asked.select(F.col("node").alias("query"), F.col("node").alias("id")))
            .unionByName(group_answers(nodes, asked, answers)).distinct())
    exact = (best.join(vecs.select(F.col("node").alias("query"), F.col("vec").alias("own")), "query")
             .join(vecs.select(F.col("node").alias("id"), "vec", "members"), "id").select("query", "own", "vec", "members"))
    scored = map_arrow(exact, _exact, "query bigint, members array<bigint>, score double")
    # of each query node, the best candidates: one more than asked, as a query may be among them itself
    cand = scored.select("query", F.explode("members").alias("vec_id"), "score")
    top = written(cand.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, answers + 1)
                                            .alias("top")), "knn-answers")
    # query rows by their vector's node
    rows = _query_rows(wanted, nodes)
    return (rows.join(top, "query")
            .select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter(
                "top", lambda t: t["vec_id"] != F.col("vec_id")), 1, answers)).alias("rank", "t"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"),
                    (-F.col("t.far")).alias("score")))


def _query_rows(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vec_id, query): each query row and its node; rows that take no part find none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for i, e in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                if i is not None and e and all(x is not None for x in e):
                    ids.append(i)
                    vecs.append((np.asarray(e, np.float32) + np.float32(0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["vec_id", "vec"])

    rows = map_arrow(wanted.withColumn("embedding", F.col("embedding").cast("array<float>")), run, "vec_id bigint, vec binary")
    return rows.join(nodes.select("vec", F.col("node").alias("query")), "vec").select("vec_id", "query").distinct()

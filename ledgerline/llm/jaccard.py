"""Operator 9, n-gram Jaccard join: size-aware heavy-light join of shingle sets.

Documents with the same set are one class; only classes are compared. Two classes link when
100 * |intersection| >= 75 * |union|.

- **Small sets** (up to a boundary size) enumerate fixed-size subsets: for each possible partner size, all subsets
  as large as the overlap that such a pair needs. Sharing one subset is the link itself.
- **Large sets**, and small ones that could link with them, scan inverted lists. A set enters the lists of its
  first n - ceil(0.75 n) + 1 shingles, rare ones before heavy ones; linked sets meet in at least one list.
- The boundary minimises the estimated cost of both over the histogram of set sizes.

Lists are not expanded into pairs. In each list every class is verified against one leader (the class with the
largest share of heavy shingles, i.e. the one most like all others). Connected components of the links follow;
only lists that still hold several components give further pairs, between components. Two classes that meet in
lists of heavy shingles alone share no rare shingle at all, so their overlap is at most the smaller count of
heavy shingles; pairs that cannot reach the threshold that way are left out. So every link between different
texts is either verified or already implied by components.

Which shingles count as heavy only sets the order: any choice gives the same links. They are those that repeat
within blocks of documents, at most ``MAX_HEAVY`` of the most frequent ones.

Shingles and sets are known by 64-bit hashes. Defined results: null, empty and wordless texts have an empty set
and link with nothing; repeated rows and ids get a row each; the component of an id is the smallest id reachable
from any of its rows; null ids take no part in naming a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ledgerline.llm.common import bitmap, id_and_text, in_bitmap, map_arrow, packed, ship_package, slices, texts_of, unpacked, written
from ledgerline.llm.components import connected_components
from ledgerline.operators.sizing import broadcast_if_small

WORDS = 5
BLOCK_SHINGLES = 1_500_000
LOCAL_REPEATS = 4        # of a shingle within a block, to be counted as possibly heavy
HEAVY = 64               # repeats in all
MAX_HEAVY = 1 << 19      # 4 MB at the tasks
LIST_WEIGHT = 6.0        # cost of a list entry (a share of a verification) against one of a subset
MAX_SMALL = 16
POSTINGS_A_BUCKET = 400_000
LONG_LIST = 1_000        # classes of a list that one row may hold
WANTED_BITS = 1 << 26    # of the bitmap by which tasks know the classes to verify (8 MB)
MEMBERS_A_TASK = 2_000   # members of one leader that are verified together

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text's words (ASCII case folded)."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxh3_64_intdigest(b" ".join(w))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = (out ^ (h[k:k + n] * _P[k])) * _P[(k + 1) % 5]
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit number of a set; 0 for the empty one."""
    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes()) or 1).astype(np.int64)) if len(shingles) else 0


def links(overlap: int, n: int, m: int) -> bool:
    return 100 * overlap >= 75 * (n + m - overlap)


def least_overlap(n: int, m: int) -> int:
    """Shared shingles that sets of n and m need: the least o with 100 o >= 75 (n + m - o)."""
    return -(-75 * (n + m) // 175)


def prefix(n: int) -> int:
    return n - -(-3 * n // 4) + 1


# ------------------------------------------------------- small sets: subsets
def partner_sizes(n: int, most: int) -> list[int]:
    return [m for m in range(-(-3 * n // 4), min(4 * n // 3, most) + 1) if least_overlap(n, m) <= min(n, m)]


def subset_count(n: int, most: int) -> int:
    return sum(math.comb(n, least_overlap(n, m)) for m in partner_sizes(n, most))


def subset_keys(shingles: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(key, smaller size, larger size) of all subsets by which a partner of at most ``most`` shingles is found."""
    n = len(shingles)
    for m in partner_sizes(n, most):
        a, b = min(n, m), max(n, m)
        tag = np.array([a, b], np.uint64).tobytes()
        for part in combinations(shingles.tolist(), least_overlap(n, m)):
            key = xxh3_64_intdigest(tag + np.array(part, np.uint64).tobytes())
            yield int(np.uint64(key).astype(np.int64)), a, b


def choose_boundary(histogram: dict[int, int]) -> int:
    """Largest size of small sets with the least total cost (0: no subsets at all)."""
    def cost(x: int) -> float:
        small = sum(c * subset_count(n, x) for n, c in histogram.items() if n <= x)
        return small + LIST_WEIGHT * sum(c * prefix(n) for n, c in histogram.items() if n >= -(-3 * (x + 1) // 4))
    return min(range(MAX_SMALL + 1), key=cost)


# ------------------------------------------------------------ first pass
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of blocks of whole documents."""
    ids, sets, size = [], [], 0
    for b in (part for whole in batches for part in slices(whole)):
        for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text"))):
            s = shingle_set(t)
            ids.append(i)
            sets.append(s)
            size += len(s)
            if size >= BLOCK_SHINGLES:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _distinct(sets: list[np.ndarray], classes: list[int]) -> dict[int, np.ndarray]:
    return {c: s for c, s in zip(classes, sets) if c}


FIRST = "doc_id bigint, n int, class bigint, shingle bigint, repeats bigint"


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (doc_id, n, class), and rows of shingles that repeat within a block."""
    names = ["doc_id", "n", "class", "shingle", "repeats"]
    for ids, sets in _blocks(batches):
        classes = [class_of(s) for s in sets]
        no = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                                          pa.array(classes, pa.int64()), no, no], names=names)
        own = list(_distinct(sets, classes).values())
        if own:
            shingle, repeats = np.unique(np.concatenate(own), return_counts=True)
            often = repeats >= LOCAL_REPEATS
            k = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()),
                 pa.array(shingle[often].view(np.int64)), pa.array(repeats[often].astype(np.int64))], names=names)


# ------------------------------------------------------------- the lists
def ordered(shingles: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, int]:
    """Shingles with rare ones first, each part by hash, and the number of rare ones."""
    if not len(heavy):
        return shingles, len(shingles)
    at = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
    is_heavy = heavy[at] == shingles
    rare = shingles[~is_heavy]
    return np.concatenate([rare, shingles[is_heavy]]), len(rare)


RARE = "bucket int, shingles binary, classes binary, ns binary, heavies binary"
HOT = "shingle bigint, class bigint, n int, heavy int"


def _prefixes(sets: list[np.ndarray], least: int, heavy: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(class, its first shingles, how many of them are rare, size, heavy ones of all) of a block's distinct sets."""
    for c, s in _distinct(sets, [class_of(s) if len(s) >= least else 0 for s in sets]).items():
        order, rare = ordered(s, heavy)
        p = prefix(len(s))
        yield c, order[:p], min(p, rare), len(s), len(s) - rare


def _rare_postings(sent, least: int, buckets: int):
    """Postings of rare shingles as arrays, a row for each block and bucket: 20 bytes a posting, one shuffle."""
    names = ["bucket", "shingles", "classes", "ns", "heavies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = sent.value
        for _, sets in _blocks(batches):
            shingles, classes, ns, heavies = [], [], [], []
            for c, first, rare, n, h in _prefixes(sets, least, heavy):
                shingles.append(first[:rare])
                classes.append(np.full(rare, c, np.int64))
                ns.append(np.full(rare, n, np.int32))
                heavies.append(np.full(rare, h, np.int32))
            if not shingles:
                continue
            x, c, n, h = map(np.concatenate, (shingles, classes, ns, heavies))
            at = ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            x, c, n, h, at = x[order].astype(np.uint32), c[order], n[order], h[order], at[order]  # low halves: buckets hold the high
            bounds = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, int)
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(at[i]) for i, _ in spans], pa.int32()),
                 *[pa.array([v[i:j].tobytes() for i, j in spans], pa.binary()) for v in (x, c, n, h)]], names=names)

    return run


def _hot_postings(sent, least: int):
    """Postings of heavy shingles as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = sent.value
        for _, sets in _blocks(batches):
            hot = [(x, c, n, h) for c, first, rare, n, h in _prefixes(sets, least, heavy) if rare < len(first)
                   for x in first[rare:].view(np.int64).tolist()]
            cols = list(zip(*hot)) if hot else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])],
                                             names=["shingle", "class", "n", "heavy"])

    return run


LISTS = "shingle bigint, weight int, members array<struct<class:bigint,n:int,heavy:int>>"
_MEMBER = pa.struct([("class", pa.int64()), ("n", pa.int32()), ("heavy", pa.int32())])


def _lists_of_bucket(rows: pa.Table) -> pa.Table:
    """The distinct lists of a bucket that hold two classes or more, each with the number of shingles that have it
    (a long one in several rows of its first shingle).

    Shingles are told apart by 32 bits more than the bucket has: where two share a list, it only has more members
    to verify.
    """
    bucket = rows.column("bucket")[0].as_py()
    x, c, n, h = (np.frombuffer(b"".join(rows.column(k).to_pylist()), t) for k, t in
                  (("shingles", np.uint32), ("classes", np.int64), ("ns", np.int32), ("heavies", np.int32)))
    order = np.lexsort((c, x))
    x, c, n, h = x[order], c[order], n[order], h[order]
    first = np.concatenate([[True], (x[1:] != x[:-1]) | (c[1:] != c[:-1])]) if len(x) else np.zeros(0, bool)
    x, c, n, h = x[first], c[first], n[first], h[first]  # a class may come from several blocks
    bounds = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, int)
    same: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(np.diff(bounds) >= 2).tolist():
        same.setdefault(c[bounds[k]:bounds[k + 1]].tobytes(), []).append(k)
    shingles, weights, starts, ends = [], [], [], []
    for ks in same.values():
        a, b = int(bounds[ks[0]]), int(bounds[ks[0] + 1])
        for s in range(a, b, LONG_LIST):
            shingles.append(bucket << 32 | int(x[a]))
            weights.append(len(ks))
            starts.append(s)
            ends.append(min(s + LONG_LIST, b))
    flat = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if starts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([b - a for a, b in zip(starts, ends)])]).astype(np.int32)
    members = pa.StructArray.from_arrays([pa.array(c[flat]), pa.array(n[flat]), pa.array(h[flat])], fields=list(_MEMBER))
    return pa.table({"shingle": pa.array(shingles, pa.int64()), "weight": pa.array(weights, pa.int32()),
                     "members": pa.ListArray.from_arrays(pa.array(offsets), members)})


# ------------------------------------------------------------ verification
def class_sets(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, object]:
    """((class, set) of the wanted classes and some others, the broadcast in use); copies may give a class several rows.

    Tasks know the wanted classes by a bitmap of fixed size; what it lets through by chance finds no partner later.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("class"), WANTED_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _blocks(batches):
            out = {}
            for s in sets:
                c = class_of(s)
                if c and c not in out:
                    out[c] = s
            found = np.array(list(out), np.int64)
            kept = in_bitmap(sent.value, found.view(np.uint64)) if len(found) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(found[kept]), pa.array([out[c].tobytes() for c in found[kept].tolist()], pa.binary())],
                                             names=["class", "set"])

    return map_arrow(docs, run, "class bigint, set binary"), sent


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, salt) with the leader's own set in front of its members: the linked pairs."""
    group, own = None, np.zeros(0, np.uint64)
    for b in batches:
        pairs = []
        for lead, salt, member, s in zip(b.column("lead").to_pylist(), b.column("salt").to_pylist(),
                                         b.column("class").to_pylist(), b.column("set").to_pylist()):
            s = np.frombuffer(s, np.uint64)
            if member == lead:
                group, own = (lead, salt), s
            elif group == (lead, salt):
                both = own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s
                if links(int(both.sum()), len(own), len(s)):
                    pairs.append((lead, member))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of ``pairs`` (lead, class). A leader with many members is worked on in several tasks."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(1 << 20)))
    fans = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_TASK).cast("int").alias("parts"))
    few, _ = broadcast_if_small(written(fans, "jaccard-fans"))  # a leader's pairs needn't meet in one task for this
    members = pairs.join(few, "lead").select("lead", F.pmod("salt", F.col("parts")).cast("int").alias("salt"), "class")
    leads = fans.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"),
                        F.col("lead").alias("class"))
    asked, _ = broadcast_if_small(written(members.unionByName(leads), "jaccard-asked"))
    rows = sets.join(asked, "class").select("lead", "salt", "class", "set")
    rows = (rows.withColumn("_member", F.col("class") != F.col("lead"))
            .repartition("lead", "salt").sortWithinPartitions("lead", "salt", "_member"))
    return map_arrow(rows.drop("_member"), _verify, "a bigint, b bigint").distinct()


# -------------------------------------------------------------- the join
def class_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, class) of every document, (class, component) of every class with a link)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    first = written(map_arrow(rows, _first, FIRST), "jaccard-first")
    by_doc = first.filter("class is not null").select("doc_id", "n", "class")

    # which shingles are heavy, and where small sets end
    often = (first.filter("shingle is not null").groupBy("shingle").agg(F.sum("repeats").alias("repeats"))
             .filter(F.col("repeats") >= HEAVY).orderBy(F.desc("repeats"), "shingle").limit(MAX_HEAVY).select("shingle"))
    heavy = spark.sparkContext.broadcast(np.sort(often.toArrow().column("shingle").to_numpy().view(np.uint64)))
    sizes = by_doc.filter("class <> 0").agg(F.sum("n").alias("total"), *[
        F.count_if(F.col("n") == n).alias(f"n{n}") for n in range(1, MAX_SMALL * 2)]).first()
    boundary = choose_boundary({n: sizes[f"n{n}"] for n in range(1, MAX_SMALL * 2)})
    total = sizes["total"] or 0

    # lists
    buckets = max(16, math.ceil(total / 4 / POSTINGS_A_BUCKET))
    least = -(-3 * (boundary + 1) // 4)
    rare = (map_arrow(rows, _rare_postings(heavy, least, buckets), RARE)
            .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lists_of_bucket, LISTS))
    hot = map_arrow(rows, _hot_postings(heavy, least), HOT).distinct()
    member = [F.col("m.class").alias("class"), F.col("m.n").alias("n"), F.col("m.heavy").alias("heavy")]
    in_lists = (rare.select("shingle", "weight", F.explode("members").alias("m"))
                .select("shingle", "weight", *member, F.lit(False).alias("hot"))
                .unionByName(hot.select("shingle", F.lit(1).alias("weight"), "class", "n", "heavy", F.lit(True).alias("hot"))))
    in_lists = written(in_lists, "jaccard-members")

    # every class of a list against the list's leader; subsets of small sets link at once
    leaders = (in_lists.groupBy("shingle", "hot").agg(
        F.max_by(F.struct(F.col("class").alias("lead"), F.col("n").alias("ln"), F.col("heavy").alias("lh")),
                 F.struct(F.col("heavy") / F.col("n"), "n", "class")).alias("l"), F.count(F.lit(1)).alias("k"))
        .filter("k > 1").select("shingle", "hot", "l.*"))
    star = (in_lists.join(leaders, ["shingle", "hot"]).filter(_can_link("n", "ln", "heavy", "lh"))
            .filter(F.col("class") != F.col("lead")).select("lead", "class", "n", "ln", "heavy", "lh").distinct())
    star = written(star, "jaccard-star")
    linked = written(_links_of(rows, _with_shared(star, in_lists)).unionByName(_small_links(rows, boundary)), "jaccard-links")
    heavy.destroy()
    found = written(connected_components(linked), "jaccard-components")

    # lists that still hold several components: pairs between these
    marked = (in_lists.join(found.withColumnRenamed("node", "class"), "class", "left")
              .withColumn("component", F.coalesce("component", "class")))
    open_ = (marked.groupBy("shingle", "hot").agg(F.min("component").alias("x"), F.max("component").alias("y"))
             .filter("x < y").select("shingle", "hot"))
    open_ = written(marked.join(open_, ["shingle", "hot"]), "jaccard-open")
    other = open_.select("shingle", "hot", F.col("class").alias("lead"), F.col("n").alias("ln"), F.col("heavy").alias("lh"),
                         F.col("component").alias("other"))
    met = (open_.join(other, ["shingle", "hot"])
           .filter((F.col("lead") < F.col("class")) & (F.col("other") != F.col("component")) & _can_link("n", "ln", "heavy", "lh")))
    # such a pair meets in open lists only, so all rare shingles that both prefixes hold are counted here
    counted = (met.filter(~F.col("hot")).groupBy("lead", "class", "n", "ln")
               .agg(F.sum("weight").alias("shared"), F.min("heavy").alias("heavy"), F.min("lh").alias("lh"))
               .filter(_enough_shared()).select("lead", "class"))
    across = (counted.unionByName(met.filter("hot").select("lead", "class")).distinct()
              .join(star, ["lead", "class"], "left_anti")
              .join(star.select(F.col("class").alias("lead"), F.col("lead").alias("class")), ["lead", "class"], "left_anti"))
    across = written(across, "jaccard-across")
    more = written(_links_of(rows, across).unionByName(linked), "jaccard-all-links")
    return by_doc, written(connected_components(more), "jaccard-final").withColumnRenamed("node", "class")


def _can_link(n: str, m: str, n_heavy: str, m_heavy: str):
    """Whether sizes allow a link; in a list of a heavy shingle, whether the heavy shingles alone do."""
    o = F.when(F.col("hot"), F.least(F.col(n_heavy), F.col(m_heavy))).otherwise(F.least(F.col(n), F.col(m)))
    return 175 * o >= 75 * (F.col(n) + F.col(m))


def _with_shared(pairs: DataFrame, in_lists: DataFrame) -> DataFrame:
    """The pairs whose shared rare shingles allow a link, counted in the lists that hold both: whole sets travel for these
    only. A list's row stands for all shingles with the same members (``weight``)."""
    rare = in_lists.filter(~F.col("hot"))
    shared = (pairs.select("lead", "class").join(rare.select("class", "shingle", "weight"), "class")
              .join(rare.select(F.col("class").alias("lead"), "shingle"), ["lead", "shingle"])
              .groupBy("lead", "class").agg(F.sum("weight").alias("shared")))
    return (pairs.join(shared, ["lead", "class"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
            .filter(_enough_shared()).select("lead", "class"))


def _enough_shared():
    """Whether a pair that shares ``shared`` rare shingles within both prefixes can reach the threshold.

    Rare shingles come first in the common order. Of a set whose rare ones all lie in its prefix only heavy ones
    are left behind it; else all that the prefix leaves, n - prefix(n). Two sets of the first kind share at most
    the smaller heavy count besides; otherwise what one of the second kind has left bounds the rest (the
    larger of the two, if both are).
    """
    def left(n: str, heavy: str):
        behind = F.ceil(F.col(n) * 0.75) - 1
        return F.col(heavy), behind, F.col(n) - F.col(heavy) > F.col(n) - behind  # the last: some rare ones are behind

    (hx, bx, more_x), (hy, by, more_y) = left("n", "heavy"), left("ln", "lh")
    rest = (F.when(more_x & more_y, F.greatest(bx, by)).when(more_x, bx).when(more_y, by).otherwise(F.least(hx, hy)))
    return 175 * (F.col("shared") + rest) >= 75 * (F.col("n") + F.col("ln"))


def _links_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    pairs = written(pairs, "jaccard-candidates")
    wanted = pairs.select(F.col("lead").alias("class")).unionByName(pairs.select("class"))
    sets, sent = class_sets(rows, wanted)
    found = written(verified(pairs, sets), "jaccard-verified")
    sent.destroy()
    return found


def _small_links(rows: DataFrame, boundary: int) -> DataFrame:
    """Links between small sets: the members of a shared subset, each with a member of the other size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _blocks(batches):
            out = [(k, a, b, c, len(s)) for c, s in _distinct(sets, [class_of(s) if len(s) <= boundary else 0 for s in sets]).items()
                   for k, a, b in subset_keys(s, boundary)]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()])],
                                             names=["key", "a", "b", "class", "n"])

    keys = written(map_arrow(rows, run, "key bigint, a int, b int, class bigint, n int").distinct(), "jaccard-subsets")
    least = keys.groupBy("key", "a", "b").agg(
        F.min(F.when(F.col("n") == F.col("a"), F.col("class"))).alias("x"),
        F.min(F.when(F.col("n") == F.col("b"), F.col("class"))).alias("y")).filter("x is not null and y is not null")
    met = keys.join(least, ["key", "a", "b"])
    return (met.select(F.when(F.col("n") == F.col("a"), F.col("y")).otherwise(F.col("x")).alias("a"), F.col("class").alias("b"))
            .filter("a <> b").distinct())


def named_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n, class, component_id) of every document."""
    by_doc, found = class_components(docs)
    named = by_doc.join(found, "class", "left").withColumn("component", F.when(F.col("class") != 0, F.coalesce("component", "class")))
    least = written(named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "jaccard-names")
    return named.join(least, "component", "left").select("doc_id", "n", "class", F.coalesce("least", "doc_id").alias("component_id"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return named_documents(docs).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their component (smallest doc_id); rows without words all stay.

    A row is known by its id and its set, so of an id with several texts only the repeated text goes. Rows without
    an id all stay.
    """
    dropped = written(named_documents(docs).filter(F.col("doc_id") != F.col("component_id"))
                      .select("doc_id", "class").distinct(), "jaccard-dropped")
    rows = packed(docs).select("_row", F.col("_row.doc_id").cast("bigint").alias("doc_id"),
                               F.col("_row.text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            classes = [class_of(shingle_set(t)) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), pa.array(classes, pa.int64())],
                                             names=["_row", "doc_id", "class"])

    schema = T.StructType([rows.schema["_row"], T.StructField("doc_id", T.LongType()), T.StructField("class", T.LongType())])
    return map_arrow(rows, run, schema).join(dropped, ["doc_id", "class"], "left_anti").select(*unpacked(docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`jaccard_report`: all pairs that share a shingle, then reachability."""
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), linked AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT linked.b, reach.root FROM reach JOIN linked ON linked.a = reach.doc_id
), least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id
FROM w JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""

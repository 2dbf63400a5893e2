"""Operator 2, benchmark decontamination: an FM-index per training shard.

A shard is a block of whole documents inside one input partition (``shard_words`` words). Its words become
symbols of the test phrases' vocabulary; a word that no phrase holds ends a run, since no phrase can span
it. The shard's runs are suffix-sorted (prefix doubling, distinct run ends), the Burrows-Wheeler transform
goes into a wavelet matrix, and all phrases are searched backwards at once through its ranks. Occurrences
are located by walking to sampled suffix positions; overlapping ones merge to removal spans.

Nothing is shuffled: phrases go to the tasks, results stay with their rows. Phrases are taken in slices of
at most ``slice_chars`` characters, so what a task receives has a fixed bound; more slices mean more passes
over the rows, each adding its spans.

Defined results: null or wordless texts and items match nothing; a repeated item counts once by its id; a
null item_id is the empty id; repeated documents get a row each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import WORD_BYTES, map_arrow, packed, texts_of, unpacked, words_of, written

WINDOW = 10
SHARD_WORDS = 2_000_000
SLICE_CHARS = 8_000_000
SAMPLE = 8


# ------------------------------------------------------------------ index
class Bits:
    """A bit vector with rank: 64-bit words and running counts."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        cur = seq
        for shift in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            bit = ((cur >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit), len(bit) - int(bit.sum())))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of its position i."""
        lo, hi = np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; symbol 0 ends a run, and each end is a symbol of its own (in order of position)."""
    n = len(text)
    ends = text == 0
    first = np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + text.astype(np.int64))
    order = np.argsort(first, kind="stable")
    key = first[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))  # position of its group's first
    tied = ~(starts & np.concatenate([starts[1:], [True]]))
    active, k = order[tied], 1
    while len(active):
        old = rank[active]
        key = old * (n + 1) + rank[active + k]  # a tied suffix reaches k symbols within its run
        o = np.argsort(key, kind="stable")
        active, old, key = active[o], old[o], key[o]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        part = np.maximum.accumulate(np.where(starts, at, 0))
        rank[active] = old + part - group
        active, k = active[~(starts & np.concatenate([starts[1:], [True]]))], 2 * k
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.tree = WaveletMatrix(self.bwt, sigma)
        marked = (sa % sample == 0) | (self.bwt == 0)  # run starts too: no walk leaves its run
        self.marked, self.samples = Bits(marked), sa[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [sp, ep) of phrases of one length (a row each), by backward search."""
        sp = self.counts[phrases[:, -1]]
        ep = self.counts[phrases[:, -1] + 1]
        live = np.flatnonzero(sp < ep)
        for j in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[live, j]
            sp[live] = self.counts[c] + self.tree.rank(c, sp[live])
            ep[live] = self.counts[c] + self.tree.rank(c, ep[live])
            live = live[sp[live] < ep[live]]
        return sp, np.maximum(sp, ep)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps of the last-to-first mapping up to a sampled one."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            there = self.marked.get(rows)
            out[todo[there]] = self.samples[self.marked.rank(rows[there])] + steps
            todo, rows = todo[~there], rows[~there]
            c = self.bwt[rows]
            rows = self.counts[c] + self.tree.rank(c, rows)
            steps += 1
        return out


# ---------------------------------------------------------------- phrases
@dataclass
class Phrases:
    """Distinct test phrases by length, their vocabulary, and the items that hold each phrase."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, np.ndarray]           # length -> symbols, a phrase a row
    items_of: dict[int, list[list[str]]]        # length -> for each phrase, its item ids

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=1)


def compile_phrases(items: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text))
        if ids:
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1):
                found.setdefault(size, {}).setdefault(ids[k:k + size], set()).add(item)
    return Phrases(vocabulary, {n: np.array(list(p), np.int64) for n, p in found.items()},
                   {n: [sorted(s) for s in p.values()] for n, p in found.items()})


@dataclass
class Shard:
    """Hits in a block of documents: marked words by document, and the items found there."""

    word_count: list[int]
    spans: list[list[tuple[int, int]]]
    items: list[set[str]]


def search_shard(texts: list[bytes], phrases: Phrases) -> Shard:
    get = phrases.vocabulary.get
    parts, counts = [], []
    end = np.zeros(1, np.int32)
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        parts += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), end]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    flat = np.concatenate(parts) if parts else end
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]])))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= phrases.shortest
    starts, stops = starts[long], stops[long]
    if not len(starts) or not phrases.by_length:
        return Shard(counts, spans, items)
    keep = np.zeros(len(flat) + 1, np.int32)  # the runs, each with the end behind it
    keep[starts] += 1
    np.add.at(keep, stops + 1, -1)
    where = np.flatnonzero(np.cumsum(keep)[:-1])
    text = flat[where].astype(np.int64)
    index = FMIndex(text, len(phrases.vocabulary))
    first_word = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    change = np.zeros(len(text) + 1, np.int64)
    for size, rows in phrases.by_length.items():
        sp, ep = index.search(rows)
        n = ep - sp
        which = np.repeat(np.arange(len(rows)), n)
        if not len(which):
            continue
        rank = np.repeat(sp, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = index.locate(rank)
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        doc = np.searchsorted(first_word, where[at], side="right") - 1
        pairs = np.unique(doc * len(rows) + which)
        for d, p in zip((pairs // len(rows)).tolist(), (pairs % len(rows)).tolist()):
            items[d].update(phrases.items_of[size][p])
    hit = np.cumsum(change)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        d = int(np.searchsorted(first_word, where[a], side="right")) - 1
        spans[d].append((int(where[a] - first_word[d]), int(where[b - 1] - first_word[d]) + 1))
    return Shard(counts, spans, items)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` (and what stands between them)."""
    if not spans:
        return text
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


# -------------------------------------------------------------- operators
FOUND = T.StructType([
    T.StructField("_n_words", T.LongType()),
    T.StructField("_spans", T.ArrayType(T.LongType())),
    T.StructField("_items", T.ArrayType(T.StringType())),
    T.StructField("_cut", T.StringType()),
])


def _slices(benchmark: DataFrame, slice_chars: int) -> list[list[tuple[str, bytes]]]:
    """The items in lists of about ``slice_chars`` characters, collected one list at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(total / slice_chars))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"].encode()) for r in part.collect()]


def _pass(df: DataFrame, items: list[tuple[str, bytes]], window: int, shard_words: int) -> DataFrame:
    """Add one slice's finds to the columns of FOUND, which ``df`` ends with; ``_cut`` is the text without all spans."""
    sent = df.sparkSession.sparkContext.broadcast(items)
    kinds = [("_n_words", pa.int64()), ("_spans", pa.list_(pa.int64())), ("_items", pa.list_(pa.string())), ("_cut", pa.string())]

    def finish(batches: list[pa.RecordBatch], texts: list[bytes], phrases: Phrases) -> Iterator[pa.RecordBatch]:
        shard, at = search_shard(texts, phrases), 0
        for batch in batches:
            part = slice(at, at + batch.num_rows)
            at = part.stop
            spans = [merge_spans([*zip(s[::2], s[1::2]), *new]) for s, new in
                     zip((x or [] for x in batch.column("_spans").to_pylist()), shard.spans[part])]
            items_ = [sorted({*(s or []), *new}) for s, new in
                      zip(batch.column("_items").to_pylist(), shard.items[part])]
            cut = [cut_spans(t, s).decode() if s else None for t, s in zip(texts[part], spans)]
            new = [shard.word_count[part], [[x for ab in s for x in ab] for s in spans], items_, cut]
            kept = [c for c in batch.schema.names if c not in FOUND.names]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(v, k) for v, (_, k) in zip(new, kinds)]],
                names=[*kept, *FOUND.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = compile_phrases(sent.value, window)
        waiting: list[pa.RecordBatch] = []
        texts: list[bytes] = []
        size = 0
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                waiting.append(batch)
                new = texts_of(batch.column("text"))
                texts += new
                size += sum(map(len, new))
                if size >= 6 * shard_words:
                    yield from finish(waiting, texts, phrases)
                    waiting, texts, size = [], [], 0
        if waiting:
            yield from finish(waiting, texts, phrases)

    return map_arrow(df, run, df.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       shard_words: int = SHARD_WORDS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(_row, text, _n_words, _spans, _items, _cut): each document's row, flat word starts and ends of its merged
    removal spans, the sorted ids of the items found, and the text without the spans (null if there are none)."""
    out = packed(docs).withColumn("text", F.col("_row.text").cast("string"))
    for f in FOUND:
        out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    for k, items in enumerate(_slices(benchmark, slice_chars)):
        out = _pass(written(out, "contamination") if k else out, items, window, shard_words)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """One row per document: words, words inside occurrences, items found and their digest."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **kw)
    sums = lambda at: F.aggregate(
        F.filter("_spans", lambda x, i: i % 2 == at), F.lit(0).cast("bigint"), lambda s, x: s + x)
    found = found.withColumn("n_hit", sums(1) - sums(0))
    return found.select(
        F.col("_row.doc_id").cast("bigint").alias("doc_id"), F.col("_n_words").alias("n_words"), "n_hit",
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` with the removal spans cut out of their texts; a text left without any word goes.

    Documents without a hit come through unchanged, empty ones too. ``n_chars`` follows the new text.
    """
    found = find_contamination(docs, benchmark, **kw)

    hit = F.size("_spans") > 0
    left = F.col("_n_words") > F.aggregate(F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                                           F.lit(0).cast("bigint"), lambda s, x: s + x)
    changed = {"text": F.when(hit, F.col("_cut")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("_cut")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.filter(~hit | left).select(*unpacked(docs.columns, **changed))

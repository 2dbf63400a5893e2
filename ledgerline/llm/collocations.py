"""Operator 12, phrase collocation mining by HAT-trie counting.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. Per
language (null: ``und``), every phrase of one to three words is counted within pieces, overlaps included.

Counting, one pass over the texts for each phrase length:

1. A task numbers the words it meets and packs a phrase into one integer of word numbers. A :class:`HatTrie` counts
   them: a shallow trie over word numbers with hash containers below; a container that grows too large bursts, into two
   halves of its word range or, if it holds one word only, into a trie node one word deeper.
2. A trie that holds too many phrases spills its largest subtrees whole, as sorted runs of (phrase, count); at the end
   of the task the rest follows. Runs are dealt by prefix partition (language, first word, and a part of the rest, as
   one prefix may hold a third of all phrases) and merged there by summing.
3. A phrase of n words occurs at most as often as those of n - 1 words inside it. So a pass counts only phrases whose
   shorter parts reached ``min_count``. The parts are known by a bitmap of hashes (``FILTER_BITS`` bits, whatever the
   data's size); hits by chance only cost time, as every count is exact and is compared with ``min_count`` again.

Candidates (two or three words, at least ``min_count`` times) then meet the counts of their parts in joins on (language,
phrase). All arithmetic is over decimals of 38 digits and exact while counts stay below 4 * 10**15.

Defined results: a null text counts as empty; repeated rows count each; a language without words gives no row; other
columns and ids are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bitmap, in_bitmap, map_arrow, slices, texts_of, written
from ledgerline.operators.sizing import broadcast_if_small

MIN_COUNT = 10
TOP = 2_000
INSIDE_PERCENT = 50
SCALE = 1_000_000

FILTER_BITS = 1 << 26
BURST = 16_384            # phrases in a hash container
HELD = 1_000_000          # phrases in a task's tries before subtrees are spilled
WORDS_HELD = 1_000_000    # words numbered by a task before all is spilled and numbering begins again
BLOCK = 4 << 20           # bytes of text split into words at a time
WORD_BITS = 21
WORD_MASK = (1 << WORD_BITS) - 1
PREFIXES = 1 << 16        # prefix partitions of a language, by hash of the first word
TAILS = 16                # parts of a prefix partition

_LOWER = bytes(ord(" ") if chr(b) == "\t" else ord("\n") if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b
               for b in range(256))
LANGUAGE = "und"


# ------------------------------------------------------------------ the trie
Run = tuple[np.ndarray, np.ndarray]       # packed phrases in order, and their counts


class Container:
    """Counts of packed phrases whose word at ``depth`` is at least a lower bound kept by the parent node."""

    def __init__(self, counts: Counter | None = None):
        self.counts: Counter = counts or Counter()

    def __len__(self) -> int:
        return len(self.counts)

    def run(self) -> Iterator[Run]:
        """The phrases in order."""
        keys = np.fromiter(self.counts, np.int64, len(self.counts))
        counts = np.fromiter(self.counts.values(), np.int64, len(self.counts))
        order = np.argsort(keys)
        yield keys[order], counts[order]


class Node:
    """A trie node: children by ranges of the word at ``depth``, each a container or (one word) a node below."""

    def __init__(self, depth: int, words: int, burst: int):
        self.depth, self.words, self.burst = depth, words, burst
        self.shift = WORD_BITS * (words - 1 - depth)
        self.lows = [0]                                            # least word of each child's range
        self.children: list[Container | Node] = [Container()]

    def __len__(self) -> int:
        return sum(map(len, self.children))

    def add(self, keys: np.ndarray) -> None:
        """Count packed phrases, given in order, that share all words above this node."""
        words = (keys >> self.shift) & WORD_MASK
        cuts = [*np.searchsorted(words, self.lows).tolist(), len(keys)]
        for k in reversed(range(len(self.children))):              # a burst shifts only children behind
            if cuts[k] < cuts[k + 1]:
                child, part = self.children[k], keys[cuts[k]:cuts[k + 1]]
                if isinstance(child, Node):
                    child.add(part)
                else:
                    child.counts.update(part.tolist())
                    if len(child) > self.burst:
                        self._burst(k)

    def _burst(self, k: int) -> None:
        counts = self.children[k].counts
        keys = np.sort(np.fromiter(counts, np.int64, len(counts)))
        words = (keys >> self.shift) & WORD_MASK
        first, last = int(words[0]), int(words[-1])
        if first < last:                                           # two containers, each of half the word range's phrases
            mid = int(words[len(words) // 2])
            mid = mid if mid > first else int(words[np.searchsorted(words, first, "right")])
            at = int(np.searchsorted(words, mid))
            halves = [Container(Counter({x: counts[x] for x in part.tolist()})) for part in (keys[:at], keys[at:])]
            self.children[k:k + 1] = halves
            self.lows.insert(k + 1, mid)
        elif self.depth + 1 < self.words:                          # one word: a node for it, between what lies around
            node = Node(self.depth + 1, self.words, self.burst)
            node.children = [Container(counts)]
            high = self.lows[k + 1] if k + 1 < len(self.lows) else WORD_MASK + 1
            lows, children = [first], [node]
            if self.lows[k] < first:
                lows, children = [self.lows[k], *lows], [Container(), *children]
            if first + 1 < high:
                lows, children = [*lows, first + 1], [*children, Container()]
            self.lows[k:k + 1] = lows
            self.children[k:k + 1] = children

    def run(self) -> Iterator[Run]:
        for child in self.children:
            yield from child.run()

    def spill(self, most: int) -> Iterator[Run]:
        """Take whole subtrees out, largest first, until at most ``most`` phrases are left: a sorted run each."""
        left = len(self)
        for k in sorted(range(len(self.children)), key=lambda k: -len(self.children[k])):
            if left <= most:
                return
            child = self.children[k]
            yield from child.run()
            left -= len(child)
            self.children[k] = Container()


class HatTrie(Node):
    """Counts of phrases of ``words`` packed word numbers."""

    def __init__(self, words: int, burst: int = BURST):
        super().__init__(0, words, burst)

    def count(self, keys: np.ndarray) -> None:
        self.add(np.sort(keys))


# ------------------------------------------------------------------ one task
def phrase_hash(parts: list) -> np.ndarray:
    """Hash of phrases from the hashes of their words: rotate, exclusive or (the same as :func:`_hash_column`)."""
    out = parts[0]
    for h in parts[1:]:
        out = ((out << np.uint64(WORD_BITS)) | (out >> np.uint64(64 - WORD_BITS))) ^ h
    return out


def blocks(texts: list[bytes], overlap: int, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of some texts in blocks of about ``size`` bytes, with ``b"\\n"`` between pieces. A block within a long
    text begins with the ``overlap`` words before it, so that every phrase of one word more lies whole in one block."""
    group, n = [], 0
    for k, text in enumerate(texts):
        group.append(text)
        n += len(text)
        if n < size and k + 1 < len(texts):
            continue
        data, at, before = b"\n".join(group).translate(_LOWER), 0, []
        while at < len(data):
            ends = [x for x in (data.find(b" ", at + size), data.find(b"\n", at + size)) if x >= 0] if at + size < len(data) else []
            cut = min(ends, default=len(data))
            words = [*before, *data[at:cut].replace(b"\n", b" \n ").split(b" ")]
            yield words
            before = list(islice(filter(None, reversed(words)), overlap))[::-1]
            at = cut
        group, n = [], 0


class Numbers(dict):
    """Word -> number; a word that isn't there yet gets its number from ``learn``."""

    def __init__(self, learn):
        super().__init__({b"": -2, b"\n": -1})                    # nothing between blanks; the end of a piece
        self.learn = learn

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.learn(word)
        return number


class Language:
    """Words of one language numbered by a task, and the trie over them."""

    def __init__(self, name: str, words: int, allowed: np.ndarray | None, burst: int):
        self.name, self.words, self.allowed, self.seen = name.encode(), words, allowed, 0
        self.trie = HatTrie(words, burst)
        self.texts: list[bytes] = []
        self.hashes: list[int] = []
        self.forget()

    def learn(self, word: bytes) -> int:
        """The number of a new word; -1 if no counted phrase holds it."""
        if self.allowed is not None:
            h = xxhash.xxh64_intdigest(self.name + b"\0" + word, seed=42)
            if not self.allowed[(h % (len(self.allowed) * 8)) >> 3] >> (h & 7) & 1:
                return -1
            self.hashes.append(h)
        self.texts.append(word)
        return len(self.texts) - 1

    def forget(self) -> None:
        """Begin numbering again, with an empty trie."""
        self.trie = HatTrie(self.words, self.trie.burst)
        self.number = Numbers(self.learn)
        self.texts, self.hashes = [], []

    def count(self, texts: list[bytes], pairs: np.ndarray | None) -> Iterator[Iterator[Run]]:
        """Count the phrases of some texts. Yields a run of all it holds whenever no numbers are left for new words."""
        for words in blocks(texts, self.words - 1):
            room = WORD_MASK - len(self.texts)
            if len(words) > room and sum(w not in self.number for w in set(words)) > room:
                yield self.trie.run()
                self.forget()
            self._count(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), pairs)

    def _count(self, ids: np.ndarray, pairs: np.ndarray | None) -> None:
        if self.words == 1:
            ids = ids[ids >= 0]
            self.seen += len(ids)
            self.trie.count(ids)
            return
        ids = ids[ids > -2]
        held = ids >= 0
        whole = held[:-1] & held[1:]
        keys = (ids[:-1] << WORD_BITS) | ids[1:]
        if self.words == 3:
            if not self.hashes or len(ids) < 3:
                return
            own = np.array(self.hashes, np.uint64)[np.maximum(ids, 0)]
            whole = whole & in_bitmap(pairs, phrase_hash([own[:-1], own[1:]]))
            whole = whole[:-1] & whole[1:]
            keys = (keys[:-1] << WORD_BITS) | ids[2:]
        self.trie.count(keys[whole])

    def rows(self, runs: Iterator[Run]) -> Iterator[pa.RecordBatch]:
        """Sorted runs as rows: phrases are words joined by a blank."""
        texts = pa.array(self.texts, pa.binary())
        prefix = np.array(self.hashes, np.uint64) % np.uint64(PREFIXES) if self.hashes else None
        held: list[Run] = []
        for run in runs:
            held.append(run)
            if sum(len(k) for k, _ in held) >= 50_000:
                yield self._batch(texts, prefix, held)
                held = []
        if held:
            yield self._batch(texts, prefix, held)

    def _batch(self, texts: pa.Array, prefix: np.ndarray | None, runs: list[Run]) -> pa.RecordBatch:
        keys, counts = map(np.concatenate, zip(*runs))
        words = [(keys >> (WORD_BITS * (self.words - 1 - k))) & WORD_MASK for k in range(self.words)]
        named = [texts.take(pa.array(w)) for w in words]
        phrases = named[0] if self.words == 1 else pc.binary_join_element_wise(*named, pa.scalar(b" ", pa.binary()))
        # the partition: the first word, and a part of the last, by hashes that all tasks share
        part = None if prefix is None else (prefix[words[0]] * np.uint64(TAILS)
                                            + prefix[words[-1]] % np.uint64(TAILS)).astype(np.int32)
        return self.batch(phrases.cast(pa.string()), part, counts)

    def batch(self, phrases: pa.Array, part: np.ndarray | None, counts: np.ndarray) -> pa.RecordBatch:
        n = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.name.decode()], pa.string()).take(pa.array(np.zeros(n, np.int32))), phrases,
             pa.nulls(n, pa.int32()) if part is None else pa.array(part, pa.int32()), pa.array(counts, pa.int64())],
            names=["lang", "phrase", "part", "n"])


RUNS = "lang string, phrase string, part int, n bigint"


def phrase_runs(docs: DataFrame, words: int, allowed=None, pairs=None, burst: int = BURST, held: int = HELD) -> DataFrame:
    """(lang, phrase, part, n): sorted runs of phrase counts, several a phrase; ``part`` is the prefix partition (phrases of two
    words or more). A null phrase counts all words (``words`` = 1).

    ``allowed`` and ``pairs`` are broadcast bitmaps of the words and pairs that may stand in a phrase.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if allowed is None else np.frombuffer(allowed.value, np.uint8)
        pair_bits = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        languages: dict[str, Language] = {}

        def spilled(most: int) -> Iterator[pa.RecordBatch]:
            for own in sorted(languages.values(), key=lambda x: -len(x.trie)):
                rest = sum(len(x.trie) for x in languages.values() if x is not own)
                yield from own.rows(own.trie.spill(max(0, most - rest)))

        for b in (part for whole in batches for part in slices(whole, 500)):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), texts_of(b.column("text"))):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                if lang not in languages:
                    languages[lang] = Language(lang, words, bits, burst)
                own = languages[lang]
                for full in own.count(texts, pair_bits):
                    yield from own.rows(full)
                if own.seen:
                    yield own.batch(pa.nulls(1, pa.string()), None, np.array([own.seen]))
                    own.seen = 0
            if sum(len(x.trie) for x in languages.values()) > held:
                yield from spilled(held // 2)
            if sum(len(x.number) for x in languages.values()) > WORDS_HELD:
                yield from spilled(0)
                languages.clear()
        yield from spilled(0)

    return map_arrow(docs, run, RUNS)


def merged(runs: DataFrame) -> DataFrame:
    """One count per (lang, phrase): runs are dealt by prefix partition and summed there."""
    return (runs.repartition("lang", "part").groupBy("lang", "part", "phrase").agg(F.sum("n").alias("n")).select("lang", "phrase", "n"))


# ------------------------------------------------------------------ bitmaps
def _hash_column(words: int):
    """64-bit hash of a phrase column, the same as the tasks take from its words."""
    parts = [F.xxhash64(F.concat(F.col("lang"), F.lit("\x00"), F.get(F.split("phrase", " "), F.lit(k)))) for k in range(words)]
    out = parts[0]
    for h in parts[1:]:
        out = F.shiftleft(out, WORD_BITS).bitwiseOR(F.shiftrightunsigned(out, 64 - WORD_BITS)).bitwiseXOR(h)
    return out


def filter_bits(counts: DataFrame, words: int, bits: int = FILTER_BITS) -> bytes:
    """The bitmap of the phrases' hashes: ``bits`` bits (a power of two, 2^15 at least), however many phrases there are."""
    return bitmap(counts.select(_hash_column(words).alias("hash")), bits).tobytes()


# --------------------------------------------------------------------- steps
def language_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(LANGUAGE)).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, bits: int = FILTER_BITS, burst: int = BURST,
                  held: int = HELD) -> list[DataFrame]:
    """[words in all by lang, counts of one, two and three words that reach ``min_count``], written tables."""
    texts, sc = language_texts(docs), docs.sparkSession.sparkContext
    runs = written(phrase_runs(texts, 1, burst=burst, held=held), "word-runs")
    totals = written(runs.filter(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language")
    words_ = runs.filter(F.col("phrase").isNotNull()).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))   # a word is its own prefix
    counts = [written(words_.filter(F.col("n") >= min_count), "words")]
    sent = []
    for words in (2, 3):
        sent.append(sc.broadcast(filter_bits(counts[-1], words - 1, bits)))
        counts.append(written(merged(phrase_runs(texts, words, *sent, burst=burst, held=held))
                              .filter(F.col("n") >= min_count), f"phrases-{words}"))
    for b in sent:
        b.destroy()
    return [totals, *counts]


def _score(a: str, left: str, right: str):
    big = "decimal(19,0)"
    return F.expr(f"cast({SCALE} as decimal(7,0)) * cast({a} as {big}) * cast({a} as {big}) div (cast({left} as {big}) * cast({right} as {big}))")


def candidates(counts: list[DataFrame], inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and three words that no longer one stands for."""
    one, two, three = [c.withColumnRenamed("n", f"n{k}") for k, c in enumerate(counts, 1)]
    part = F.split("phrase", " ")

    def with_part(df: DataFrame, table: DataFrame, start: int, length: int, name: str) -> DataFrame:
        side = table.select("lang", F.col("phrase").alias("_part"), F.col(table.columns[-1]).alias(name))
        return (df.withColumn("_part", F.array_join(F.slice(part, start, length), " "))
                .join(side, ["lang", "_part"]).drop("_part"))

    pairs = with_part(with_part(two.withColumnRenamed("n2", "a"), one, 1, 1, "l"), one, 2, 1, "r")
    pairs = pairs.withColumn("score", _score("a", "l", "r"))
    triples = three.withColumnRenamed("n3", "a")
    for table, start, length, name in ((one, 1, 1, "l1"), (two, 2, 2, "r1"), (two, 1, 2, "l2"), (one, 3, 1, "r2")):
        triples = with_part(triples, table, start, length, name)
    triples = triples.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                             F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    # the most frequent longer phrase around each pair
    around = (three.select("lang", F.explode(F.array(F.array_join(F.slice(part, 1, 2), " "), F.array_join(F.slice(part, 2, 2), " ")))
                           .alias("phrase"), "n3").groupBy("lang", "phrase").agg(F.max("n3").alias("longer")))
    kept = (pairs.join(around, ["lang", "phrase"], "left")
            .filter(F.coalesce(F.col("longer") * 100 < F.col("a") * inside_percent, F.lit(True))))
    return kept.select(*triples.columns).unionByName(triples)


def collocations(docs: DataFrame, top: int = TOP, **kw) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Ranks are taken in two steps, first within 64 parts of a language, so no task sorts all of its phrases.
    """
    counts = count_phrases(docs, **kw)
    found = written(candidates(counts[1:]), "candidates")
    order = "score desc, a desc, phrase"
    for part in ("lang, pmod(xxhash64(phrase), 64)", "lang"):
        found = found.withColumn("rank", F.expr(f"row_number() over (partition by {part} order by {order})")).filter(F.col("rank") <= top)
    return (found.join(broadcast_if_small(counts[0])[0], "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def oracle_sql(min_count: int = MIN_COUNT, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> str:
    """DuckDB SQL for :func:`collocations`: every phrase counted at once, without filters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, '{LANGUAGE}') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents)
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(ws) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY 1
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {min_count}
), parts AS MATERIALIZED (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM c JOIN (VALUES (1), (2)) AS places(cut) ON cut < c.k
), cuts AS (
  SELECT p.lang, p.k, p.phrase, a, cut, x.n AS l, y.n AS r, (({SCALE}::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.tail
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, part AS phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE best.k = 3 OR longer IS NULL OR longer * 100 < best.a * {inside_percent}
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a,
       l::BIGINT AS l, r::BIGINT AS r, totals.n::BIGINT AS n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {top}"""

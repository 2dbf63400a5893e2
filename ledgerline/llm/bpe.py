"""Operator 8, BPE encoding and decoding: tree concatenation.

A long text is cut in halves down to leaves of ``leaf_chars`` characters, wherever the cuts fall (inside words
too). Spark encodes all leaves of all documents in parallel. Neighbours are then joined pairwise up the
tree: the text around a join is encoded again in a growing window until both sides agree exactly, i.e.
until on each side the window's tokens and the half's tokens share two consecutive tokens (ids and places);
the window's tokens replace those in between. Two tokens that stand side by side in the encoding of some
text stay so wherever all their neighbours do, so the joined list is the encoding of the whole. A window
that reaches both ends is the whole encoding and ends the search.

Texts up to a leaf are encoded directly, word by word: white space separates pre-tokens and yields no token, so a
text's ids are those of its words in order, and each task remembers words it has met (a bounded memory;
a forgotten word is encoded again).

Defined results: null counts as empty; empty texts have no tokens (digests of the empty string); special
tokens written in a text become special ids, as the library does by default; repeated rows get a row each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, filterfalse
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerline.llm.common import id_and_text, map_arrow, slices, texts_of

LEAF_CHARS = 16_384
WINDOW_CHARS = 64
REMEMBERED_WORDS = 150_000


class Tokens(NamedTuple):
    """Token ids with their places in the text, as arrays."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def part(self, a: int, b: int) -> Tokens:
        return Tokens(self.ids[a:b], self.starts[a:b], self.ends[a:b])

    def rows(self) -> list[tuple[int, int, int]]:
        return list(zip(self.ids.tolist(), self.starts.tolist(), self.ends.tolist()))


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


# -------------------------------------------------------------- the tree
def encode_part(tok: Tokenizer, text: str, start: int, end: int) -> Tokens:
    """Tokens of text[start:end], with places in ``text``."""
    enc = tok.encode(text[start:end], add_special_tokens=False)
    ids = np.array(enc.ids, np.int32)
    places = np.fromiter(chain.from_iterable(enc.offsets), np.int32, 2 * len(ids)).reshape(-1, 2) + np.int32(start)
    return Tokens(ids, places[:, 0], places[:, 1])


def join_halves(tok: Tokenizer, text: str, start: int, cut: int, end: int, left: Tokens, right: Tokens,
                window: int = WINDOW_CHARS) -> Tokens:
    """Encoding of text[start:end] from those of text[start:cut] and text[cut:end]."""
    margin = longest_added(tok)
    while True:
        a, b = max(start, cut - window), min(end, cut + window)
        mid = encode_part(tok, text, a, b)
        # left: the last pair in front of the cut that both have; right: the first pair behind it. Neither may
        # lie so near to the window's edge that a token written in the text could begin or end outside
        i, u = (0, 0) if a == start else _agree(left, mid, a + margin, cut, last=True)
        j, v = (len(right.ids), len(mid.ids)) if b == end else _agree(right, mid, cut, b - margin, last=False)
        if i is not None and j is not None and u <= v:
            return Tokens(*map(np.concatenate, zip(left.part(0, i), mid.part(u, v), right.part(j, len(right.ids)))))
        window *= 2


def longest_added(tok: Tokenizer) -> int:
    """Characters of the longest token that is found as a string in the text (a special token)."""
    if tok not in _LONGEST:
        _LONGEST[tok] = max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0) + 1
    return _LONGEST[tok]


_LONGEST: dict[Tokenizer, int] = {}


def _agree(half: Tokens, mid: Tokens, low: int, high: int, last: bool) -> tuple[int | None, int]:
    """Positions in ``half`` and ``mid`` between two consecutive tokens that both have, within [low, high] and
    nearest to the cut (the last such pair, or the first).

    Tokens that share a place and an id (pieces of one character) cannot be told apart and are skipped.
    """
    near = np.flatnonzero((half.starts >= low) & (half.ends <= high))
    if not len(near):
        return None, 0
    first = int(near[0])
    own, other = half.part(first, int(near[-1]) + 1).rows(), mid.rows()
    places: dict[tuple[int, int, int], int] = {}
    for k, t in enumerate(other):
        places[t] = -1 if t in places else k
    order = range(len(own) - 1)
    for k in reversed(order) if last else order:
        u = places.get(own[k], -1)
        if (u >= 0 and u + 1 < len(other) and other[u + 1] == own[k + 1] and places[other[u + 1]] >= 0
                and own[k][1] >= low and own[k + 1][2] <= high):
            return first + k + 1, u + 1
    return None, 0


def join_tree(tok: Tokenizer, text: str, cuts: list[int], parts: list[Tokens], window: int = WINDOW_CHARS) -> Tokens:
    """Pairwise joins of neighbouring parts; ``cuts`` are the parts' bounds, one more than parts."""
    while len(parts) > 1:
        new_parts, new_cuts = [], [cuts[0]]
        for k in range(0, len(parts), 2):
            if k + 1 < len(parts):
                new_parts.append(join_halves(tok, text, cuts[k], cuts[k + 1], cuts[k + 2], parts[k], parts[k + 1], window))
                new_cuts.append(cuts[k + 2])
            else:
                new_parts.append(parts[k])
                new_cuts.append(cuts[k + 1])
        parts, cuts = new_parts, new_cuts
    return parts[0] if parts else Tokens(*[np.zeros(0, np.int32)] * 3)


# ------------------------------------------------------- words of short texts
def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


# Lower-case Latin letters (composed, of one lower-case form) as byte-level symbols.
_SYMBOLS = byte_symbols()
LATIN = {c: "".join(_SYMBOLS[b] for b in chr(c).encode()) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}
LATIN_WORD = re.compile("[a-z" + "".join(map(chr, LATIN)) + "]+").fullmatch


WORD = re.compile("[^ \t\n\r\x0b\x0c]+").finditer             # what bytes.split() cuts out, with places


class WordCodec:
    """ids and token strings of white-space-free words, remembered as the bytes that the digests take.

    Words met lately are kept; of the older generation, only those that are met again. A full stop or comma
    behind a word is a token of its own and letters lose their case, so forms of a word share one encoding.
    """

    def __init__(self, path: str, limit: int = REMEMBERED_WORDS):
        self.tok, self.limit = load(path), limit
        self.ids: dict[bytes, bytes] = {}
        self.strings: dict[bytes, bytes] = {}
        self.older: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
        self.placed: dict[str, tuple[bytes, bytes]] = {}     # words of leaves: ids, and places within the word
        self.pieces = {i: t.encode() for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.direct = all(self._agrees(t) for t in ("straße", "élan", "año", "word"))
        self.ends = {w: self._look_up([w])[0] for w in (b".", b",")}

    def _agrees(self, word: str) -> bool:
        """Whether the model alone encodes a Latin word as the whole tokenizer does."""
        got = [x.id for x in self.tok.model.tokenize(word.translate(LATIN))]
        return got == self.tok.encode(word, add_special_tokens=False).ids

    def _look_up(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Encode words: plain lower-case Latin ones by the model alone (they are one pre-token that the
        normalizer leaves as it is), the rest in one call, as a text with a blank between each two."""
        out: list[tuple[bytes, bytes] | None] = [None] * len(words)
        rest: list[int] = []
        texts = [w.decode() for w in words]
        tokenize, pieces = self.tok.model.tokenize, self.pieces
        for k, t in enumerate(texts):
            if t.isascii():
                plain = t if self.direct and t.isalpha() and t.islower() else None
            else:
                plain = t.translate(LATIN) if self.direct and LATIN_WORD(t) else None
            if plain is None:
                rest.append(k)
            else:
                ids = [x.id for x in tokenize(plain)]
                out[k] = " ".join(map(str, ids)).encode(), b" ".join([pieces[i] for i in ids])
        if rest:
            enc = self.tok.encode(" ".join([texts[k] for k in rest]), add_special_tokens=False)
            found: list[list[int]] = [[] for _ in rest]
            k, end = -1, -1
            for i, (start, _) in zip(enc.ids, enc.offsets):
                while start > end:
                    k += 1
                    end += len(texts[rest[k]]) + 1
                found[k].append(i)
            for k, ids in zip(rest, found):
                out[k] = " ".join(map(str, ids)).encode(), b" ".join([pieces[i] for i in ids])
        return out

    def learn(self, words: set[bytes]) -> None:
        """Put words that aren't there into the memory."""
        ids, strings = self.ids, self.strings
        old_ids, old_strings = self.older
        ends = self.ends
        asked: dict[bytes, list[tuple[bytes, bytes]]] = {}
        for w in words:
            if (known := old_ids.get(w)) is not None:
                ids[w], strings[w] = known, old_strings[w]
                continue
            stem, end = w, b""
            if b"<" not in w:
                stem = w.lower()
                if stem[-1:] in ends and stem[-2:-1].isalnum():
                    stem, end = stem[:-1], stem[-1:]
            asked.setdefault(stem, []).append((w, end))
        todo = [stem for stem in asked if stem not in ids]
        for stem, (a, b) in zip(todo, self._look_up(todo)):
            ids[stem], strings[stem] = a, b
        for stem, forms in asked.items():
            a, b = ids[stem], strings[stem]
            for w, end in forms:
                if end:
                    x, y = ends[end]
                    ids[w], strings[w] = a + b" " + x, b + b" " + y
                else:
                    ids[w], strings[w] = a, b

    def leaf(self, piece: str) -> Tokens:
        """Tokens of a piece of text with their places, word by word from the memory of placed words."""
        found = list(WORD(piece))
        words = [m.group() for m in found]
        if len(self.placed) > self.limit:
            self.placed = {}
        new = list(filterfalse(self.placed.__contains__, set(words)))
        if new:
            enc = self.tok.encode(" ".join(new), add_special_tokens=False)
            places = np.fromiter(chain.from_iterable(enc.offsets), np.int32, 2 * len(enc.ids)).reshape(-1, 2)
            starts = np.cumsum([0] + [len(w) + 1 for w in new])
            cuts = np.searchsorted(places[:, 0], starts).tolist()
            ids = np.array(enc.ids, np.int32)
            for w, a, b, start in zip(new, cuts, cuts[1:], starts.tolist()):
                self.placed[w] = ids[a:b].tobytes(), (places[a:b] - np.int32(start)).tobytes()
        if not words:
            return Tokens(*[np.zeros(0, np.int32)] * 3)
        ids, places = zip(*map(self.placed.__getitem__, words))
        at = np.repeat(np.fromiter((m.start() for m in found), np.int32, len(words)), [len(i) // 4 for i in ids])
        both = np.frombuffer(b"".join(places), np.int32).reshape(-1, 2)
        return Tokens(np.frombuffer(b"".join(ids), np.int32), both[:, 0] + at, both[:, 1] + at)

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text, for a tokenizer that joins its token strings by blanks."""
        return b" ".join([self.pieces[i] for i in ids])

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text, ids in decimal joined by one space."""
        for k in range(0, len(texts), 512):
            split = [t.split() for t in texts[k:k + 512]]
            if len(self.ids) > self.limit:
                self.older, self.ids, self.strings = (self.ids, self.strings), {}, {}
            missing: set[bytes] = set()
            for words in split:
                missing.update(filterfalse(self.ids.__contains__, words))
            if missing:
                self.learn(missing)
            ids, strings = self.ids.__getitem__, self.strings.__getitem__
            for words in split:
                yield b" ".join(filter(None, map(ids, words))), b" ".join(filter(None, map(strings, words)))


def plain_words(path: str) -> bool:
    """Whether a tokenizer drops white space, knows no token across it and decodes to token strings joined by
    blanks, as the word memory needs."""
    tok = load(path)
    one = tok.encode("a b\n c", add_special_tokens=False).ids
    if tok.decode(one, skip_special_tokens=False) != " ".join(map(tok.id_to_token, one)):
        return False
    def ids(*words: str) -> list[int]:
        return [i for w in words for i in tok.encode(w, add_special_tokens=False).ids]

    # case is dropped, and a full stop or comma behind a letter or digit is a token of its own
    forms = all(ids(w) == ids(w[:-1].lower(), w[-1]) for w in ("Word.", "wOrD,", "X1.", "aB,", "7."))
    return one == ids("a", "b", "c") and forms and not any(c.isspace() for t in tok.get_added_tokens_decoder().values() for c in t.content)


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(ids: list, pairs: Iterator[tuple[bytes, bytes]]) -> pa.RecordBatch:
    rows = [(i.count(b" ") + 1 if i else 0, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest())
            for i, d in pairs]
    n, a, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                                       pa.array(b, pa.string())],
                                      names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def leaf_numbers(path: str, leaf_chars: int) -> type:
    """What holds the ids and the places within a leaf."""
    return np.uint16 if max(leaf_chars, load(path).get_vocab_size(with_added_tokens=True)) < 1 << 16 else np.int32


def encode_leaves(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Long documents as rows of leaves: (doc, copies, leaf, piece of text, ids, starts, lengths).

    Equal rows are one document with a count of copies, so many copies of a long text are encoded once.
    """
    long = docs.withColumn("doc", F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                                     F.col("text")).cast("binary"), 256))
    n = F.ceil(F.length("text") / leaf_chars).cast("int")
    leaves = long.select("doc", "doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), n - 1), lambda k: F.substr(F.col("text"), k * leaf_chars + 1, F.lit(leaf_chars))))
        .alias("leaf", "piece"))
    # one shuffle spreads the leaves over the tasks and counts copies (map-side first)
    leaves = (leaves.groupBy("doc", "leaf").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("piece").alias("piece"),
                                                F.count(F.lit(1)).alias("copies"))
              .select("doc", "doc_id", "copies", "leaf", "piece"))

    kind, by_word = leaf_numbers(path, leaf_chars), plain_words(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                encs = [codec.leaf(p) if by_word else encode_part(codec.tok, p, 0, len(p)) for p in part.column("piece").to_pylist()]
                # of the ends, the tokens' lengths: mostly one byte that isn't zero
                cols = [pa.array([x.astype(kind).tobytes() for x in xs], pa.binary())
                        for xs in zip(*[(e.ids, e.starts, e.ends - e.starts) for e in encs])]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, "ids", "starts", "lengths"])

    return map_arrow(leaves, run, "doc string, doc_id bigint, copies bigint, leaf int, piece string, "
                                  "ids binary, starts binary, lengths binary")


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS,
                     window_chars: int = WINDOW_CHARS) -> DataFrame:
    """One row per document: token count and digests of the ids and of the decoded text."""
    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    is_long = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    by_word, kind = plain_words(path), leaf_numbers(path, leaf_chars)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in (part for whole in batches for part in slices(whole)):
            texts = texts_of(b.column("text"))
            if by_word:
                pairs = codec.encode(texts)
            else:
                encs = (codec.tok.encode(t.decode(), add_special_tokens=False).ids for t in texts)
                pairs = ((" ".join(map(str, i)).encode(),
                          codec.tok.decode(i, skip_special_tokens=False).encode()) for i in encs)
            yield _digests(b.column("doc_id").to_pylist(), pairs)

    def join(leaves: pa.Table) -> pa.Table:
        rows_ = sorted(leaves.to_pylist(), key=lambda r: r["leaf"])
        codec = _codec(path)
        text, cuts, parts = "".join(r["piece"] for r in rows_), [0], []
        for r in rows_:
            ids, starts, lengths = (np.frombuffer(r[k], kind).astype(np.int32) for k in ("ids", "starts", "lengths"))
            parts.append(Tokens(ids, starts + np.int32(cuts[-1]), starts + lengths + np.int32(cuts[-1])))
            cuts.append(cuts[-1] + len(r["piece"]))
        ids = join_tree(codec.tok, text, cuts, parts, window_chars).ids.tolist()
        pair = (" ".join(map(str, ids)).encode(), codec.decode(ids) if by_word
                else codec.tok.decode(ids, skip_special_tokens=False).encode())
        one = _digests([rows_[0]["doc_id"]], iter([pair]))
        return pa.Table.from_batches([one] * rows_[0]["copies"])

    return (map_arrow(rows.filter(~is_long), short, DIGEST)
            .unionByName(encode_leaves(rows.filter(is_long), path, leaf_chars)
                         .groupBy("doc").applyInArrow(join, DIGEST)))


_CODECS: dict[str, WordCodec] = {}


def _codec(path: str) -> WordCodec:
    """One codec per worker process: what it remembers serves all its tasks."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def decode_ids(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the decoded text of a column of ids; null ids decode to the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for b in batches:
            out = [tok.decode(x or [], skip_special_tokens=False) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text])

    return map_arrow(frame, run, T.StructType([*frame.schema, T.StructField(text, T.StringType())]))

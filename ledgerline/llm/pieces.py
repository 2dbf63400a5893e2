"""Operator 13, SentencePiece encoding and decoding that keeps offsets.

1. :class:`Normalizer` rewrites a text by the model's compiled character map: at each place the longest prefix that the
   map's double-array trie holds is replaced, any other character stays. Every byte of the result records the byte of
   the original it came from (blank handling and the leading blank of the model included).
2. The normalised text is cut where no piece of the vocabulary can reach across (before a blank that follows something
   else, around line feeds if no piece holds one) and the units are encoded by the model without its own normaliser.
   Merges never cross such a cut, so the units' ids in order are the ids of the whole text. Each worker remembers
   units it has met (a bounded memory; a forgotten unit is encoded again).
3. The ids of the whole text, the end id included, are decoded by the library.
4. Every piece knows how many normalised bytes it covers; running sums give its normalised span, and the recorded
   places project that to a span of bytes of the original text. Of the byte pieces of one character only the last has
   a span, as in the library; the end id has an empty span at the end.

Everything is row-local: no shuffle. :func:`encode_texts` returns ids and spans, :func:`encode_documents` their
digests, :func:`decode_ids` texts.

Defined results: null counts as empty; an empty text has the end id alone; repeated rows get a row each; marker strings
such as ``</s>`` written in a text are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from ledgerline.llm.common import id_and_text, map_arrow, slices, texts_of

REMEMBERED_UNITS = 150_000
LONGEST_REMEMBERED = 64
BLANK = "▁"
BLANK_BYTES = BLANK.encode()


# ------------------------------------------------------------ normalisation
class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, its values being places of replacements."""

    def __init__(self, blob: bytes):
        size = int(np.frombuffer(blob, "<u4", 1)[0])
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest prefix of text[at:] in the map."""
        units, best = self.units, None
        pos = self._offset(units[0])
        for k in range(at, len(text)):
            pos ^= text[k]
            unit = units[pos]
            if (unit & 0x800000FF) != text[k]:
                break
            pos ^= self._offset(unit)
            if unit & 0x100:
                best = k + 1 - at, units[pos] & 0x7FFFFFFF
        if best is None:
            return None
        n, start = best
        return n, self.replacements[start:self.replacements.index(b"\0", start)]


def char_bytes(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    """Normalised bytes of a text, with the original byte place of each of them (and of the end)."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.blank = BLANK_BYTES if self.escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        return self._plain(text) if self.map is None and not self.squeeze else self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only blanks change: places follow from the bytes' widths."""
        raw = np.frombuffer(text, np.uint8)
        width = np.where(raw == 0x20, len(self.blank), 1)
        places = np.repeat(np.arange(len(raw)), width)
        lead = len(self.blank) if self.dummy else 0
        return (self.blank * self.dummy + text.replace(b" ", self.blank),
                np.concatenate([np.zeros(lead, np.int64), places, [len(raw)]]))

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        """(bytes consumed, their replacement) at a place."""
        found = self.map.longest(text, at) if self.map else None
        if found:
            return found
        n = char_bytes(text[at])
        return n, text[at:at + n]

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at, end = 0, len(text)
        if self.squeeze:                                          # blanks in front vanish
            while at < end:
                n, new = self._prefix(text, at)
                if new != b" ":
                    break
                at += n
            if at == end:
                return b"", np.full(1, end, np.int64)
        out, places = bytearray(), []
        if self.dummy:
            out += self.blank
            places += [at] * len(self.blank)
        after_blank = self.squeeze
        while at < end:
            n, new = self._prefix(text, at)
            if after_blank:
                new = new.lstrip(b" ")
            if new:
                shown = new.replace(b" ", self.blank)
                out += shown
                places += [at] * len(shown)
                after_blank = self.squeeze and new.endswith(b" ")
            at += n
        last = end
        if self.squeeze:                                          # and those behind
            while out.endswith(self.blank):
                del out[len(out) - len(self.blank):]
                last = places[len(out)]
                del places[len(out):]
        return bytes(out), np.array([*places, last], np.int64)


# ----------------------------------------------------------------- encoding
# Encoding of a unit: ids in decimal, the ids themselves and the normalised bytes that each covers, both as little-endian
# 32-bit integers.
Unit = tuple[bytes, bytes, bytes]


class PieceCodec:
    """ids, spans and decoded texts by a BPE model file."""

    def __init__(self, path: str | bytes, limit: int = REMEMBERED_UNITS):
        """``path``: a model file, or its bytes."""
        proto = sentencepiece_model_pb2.ModelProto()
        if isinstance(path, bytes):
            data = path
        else:
            with open(path, "rb") as f:
                data = f.read()
        proto.ParseFromString(data)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or any(
                p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in proto.pieces):
            raise ValueError("only BPE models without unused or user-defined pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec = proto.normalizer_spec
        self.normalise = Normalizer(spec)
        self.end = self.library.eos_id()
        # the model without its normaliser: it gets text that is normalised already
        spec.Clear()
        spec.name = "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.texts = [p.piece if p.type == kinds.NORMAL else None for p in proto.pieces]
        self.bytes = {i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.single = {t for t in self.texts if t and len(t) == 1}
        # by id: decimal digits, and bytes covered (-1 where that depends on the text)
        self.digits = [b"%d" % i for i in range(len(self.texts))]
        self.covers = np.array([-1 if t is None else len(t.encode()) for t in self.texts], "<i4")
        inner = [t for t in self.texts if t]
        if any(BLANK in t.lstrip(BLANK) for t in inner):
            self.cut = None                                        # pieces reach across blanks: no cuts
        elif any("\n" in t for t in inner):
            self.cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall
        else:
            self.cut = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n+").findall
        if not self.bytes:
            # runs of unknown characters are one piece, which a cut could tear
            self.cut = None
        self.limit, self.known, self.older = limit, {}, {}

    def units(self, text: str) -> list[str]:
        return self.cut(text) if self.cut else [text] if text else []

    def _encoded(self, units: list[str]) -> Iterator[Unit]:
        lists = self.model.encode(units, num_threads=1)
        flat = np.fromiter(chain.from_iterable(lists), "<i4")
        numbers = flat.tobytes()
        widths, at = self.covers[flat], 0
        digits = self.digits.__getitem__
        odd = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(widths < 0, out=odd[1:])
        odd, raw = odd.tolist(), widths.tobytes()
        for unit, ids in zip(units, lists):
            end = at + len(ids)
            own = raw[4 * at:4 * end] if odd[at] == odd[end] else self._widths(unit, ids).tobytes()
            yield b" ".join(map(digits, ids)), numbers[4 * at:4 * end], own
            at = end

    def _widths(self, unit: str, ids: list[int]) -> np.ndarray:
        """Bytes covered by the ids of a unit that holds characters outside the vocabulary."""
        widths, at, k = [], 0, 0
        while k < len(ids):
            piece = self.texts[ids[k]]
            if piece is not None:
                widths.append(len(piece.encode()))
                at += len(piece)
                k += 1
            elif ids[k] in self.bytes:                             # the bytes of one character: its last has the span
                n = len(unit[at].encode())
                widths += [0] * (n - 1) + [n]
                at += 1
                k += n
            else:                                                  # a run of characters that no piece holds
                start = at
                while at < len(unit) and unit[at] not in self.single:
                    at += 1
                widths.append(len(unit[start:at].encode()))
                k += 1
        return np.array(widths, "<i4")

    def lookup(self, texts: list[list[str]]) -> Mapping[str, Unit]:
        """A mapping that holds every unit of ``texts``."""
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        asked = {u for units in texts for u in units if u not in self.known}
        new = []
        for u in asked:
            if (old := self.older.get(u)) is not None:
                self.known[u] = old
            else:
                new.append(u)
        if not new:
            return self.known
        once = {}
        for u, x in zip(new, self._encoded(new)):
            (self.known if len(u) <= LONGEST_REMEMBERED else once)[u] = x
        return ChainMap(self.known, once) if once else self.known

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, bytes]]:
        """(ids in decimal, spans, decoded text) of each text; spans hold start and end of each id in bytes of the
        original text, as little-endian 32-bit integers."""
        for k in range(0, len(texts), 256):
            pairs = [self.normalise(t) for t in texts[k:k + 256]]
            cut = [self.units(norm.decode(errors="replace")) for norm, _ in pairs]
            known = self.lookup(cut).__getitem__
            for units, (norm, places) in zip(cut, pairs):
                shown, numbers, widths = zip(*map(known, units)) if units else ((), (), ())
                ends = np.cumsum(np.frombuffer(b"".join(widths), "<i4"), dtype=np.int64)
                spans = np.empty((len(ends) + 1, 2), "<i4")
                spans[:-1, 1] = places[ends]
                spans[1:-1, 0] = places[ends[:-1]]
                spans[:1, 0] = places[0]
                spans[-1] = places[-1]                             # the end id stands behind the text
                ids = b" ".join([*shown, self.digits[self.end]])
                yield ids, spans, self.decode([*np.frombuffer(b"".join(numbers), "<i4").tolist(), self.end]).encode()

    def decode(self, ids: list[int]) -> str:
        """The library's decoding of the ids themselves; nothing of the text that they were made from goes in."""
        return self.library.decode(ids)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker process: what it remembers serves all its tasks."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


# ----------------------------------------------------------- over DataFrames
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                        T.StructField("starts", T.ArrayType(T.IntegerType())),
                        T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def _rows(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: ids, where each begins and ends in the bytes of the original text, and the decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in (part for whole in batches for part in slices(whole, 200)):
            out = [(list(map(int, ids.split())), spans, decoded.decode())
                   for ids, spans, decoded in own.encode(texts_of(b.column("text")))]
            lists = [pa.array([f(x) for x in out], pa.list_(pa.int32()))
                     for f in (lambda x: x[0], lambda x: x[1][:, 0], lambda x: x[1][:, 1])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists, pa.array([x[2] for x in out], pa.string())],
                                             names=ENCODED.names)

    return map_arrow(_rows(docs), run, ENCODED)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: count of ids and digests of ids, decoded text and spans (start and end of each id as
    little-endian 32-bit integers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = codec(path), lambda x: hashlib.sha256(x).hexdigest()
        for b in (part for whole in batches for part in slices(whole)):
            out = [(len(spans), digest(ids), digest(decoded), digest(spans.tobytes()))
                   for ids, spans, decoded in own.encode(texts_of(b.column("text")))]
            n, *digests = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in digests]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return map_arrow(_rows(docs), run, DIGEST)


def decode_ids(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the decoded text of a column of ids; null ids decode to the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            out = [own.decode([int(i) for i in x or []]) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text])

    return map_arrow(frame, run, T.StructType([*frame.schema, T.StructField(text, T.StringType())]))

import hashlib
import random

import public_tokenizers
import pytest
from edge import ROWS, edge_docs, no_docs

from ledgerline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "ab", "the ", "'s", "'", " ", "\n", "é", "é", "́", "ß", "1", "23", "<|endoftext|>", "<|end", "日本",
         "😀", "!!", "...", "zz", "ing", "\xa0", "Σ", "İ", "THE", "Word, ", "naïve. ", "\x1c", " "]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), digest(" ".join(map(str, ids))), digest(tok.decode(ids, skip_special_tokens=False))


def random_text(rnd, parts, most):
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(0, most)))


@pytest.mark.parametrize("path", [PATH, public_tokenizers.path("byte_bpe_50k.json")])
def test_tree_joins_equal_whole_encoding(path):
    tok, rnd = bpe.load(path), random.Random(3)
    for trial in range(600):
        s = random_text(rnd, PARTS if trial % 3 else ["a", "b", "th", "ing", "er"], 150)
        leaf = rnd.choice([3, 7, 16, 33])
        cuts = [*range(0, len(s), leaf), len(s)] if s else [0]
        parts = [bpe.encode_part(tok, s, a, b) for a, b in zip(cuts, cuts[1:])]
        got = bpe.join_tree(tok, s, cuts, parts, rnd.choice([4, 8, 16])).ids.tolist()
        assert got == tok.encode(s, add_special_tokens=False).ids, (s, leaf)


def test_leaves_equal_whole_encoding():
    tok, rnd, codec = bpe.load(PATH), random.Random(6), bpe.WordCodec(PATH, limit=30)
    for _ in range(400):
        s = random_text(rnd, PARTS, 60)
        got, want = codec.leaf(s), bpe.encode_part(tok, s, 0, len(s))
        assert all((a == b).all() for a, b in zip(got, want)) and len(got.ids) == len(want.ids), s


def test_words_equal_whole_encoding():
    tok, rnd, codec = bpe.load(PATH), random.Random(4), bpe.WordCodec(PATH, limit=50)
    texts = [random_text(rnd, PARTS, 60) for _ in range(400)]
    for text, (ids, decoded) in zip(texts, codec.encode([t.encode() for t in texts])):
        enc = tok.encode(text, add_special_tokens=False).ids
        assert ids.decode() == " ".join(map(str, enc)) and decoded.decode() == tok.decode(enc, skip_special_tokens=False), text


@pytest.mark.parametrize("path", [PATH, public_tokenizers.path("byte_bpe_50k.json")])
def test_documents_with_leaves(spark, path):
    tok, rnd = bpe.load(path), random.Random(5)
    rows = [(i, random_text(rnd, PARTS, 120)) for i in range(40)] + [(7, "repeat " * 40)] * 3 + [(8, None), (9, "x" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, bpe.encode_documents(df, path, leaf_chars=40, window_chars=8).collect()))
    assert got == sorted((i, *expected(tok, t)) for i, t in rows)


def test_decode_round_trip(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "ids array<int>")
    tok = bpe.load(PATH)
    assert [r["decoded"] for r in bpe.decode_ids(df, PATH).collect()] == [tok.decode([1, 2, 3], skip_special_tokens=False), "", ""]


def test_edges(spark):
    tok = bpe.load(PATH)
    got = bpe.encode_documents(edge_docs(spark), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *expected(tok, r[1])) for r in ROWS), key=key)
    assert bpe.encode_documents(no_docs(spark), PATH).count() == 0

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from edge import ROWS, edge_docs, no_docs
from sentencepiece import sentencepiece_model_pb2 as pb

from ledgerline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "ab", "the ", "'s", " ", "  ", "\n", "\n\n", "é", "ß", "1", "23", "<s>", "</s>", "<0x41>", "日本", "😀", "!!",
         "...", "ing", "\xa0", "Σ", "▁", "▁▁", "ＡＢ", "①", "ﬁ", "\t", "\x00", "�", "​", "½", "Word, ", "ガ", "ｶﾞ",
         "ﷺ", " "]


def variant(charmap=False, squeeze=False, dummy=True, fallback=True):
    """The public model with another normaliser, or without byte pieces."""
    m = pb.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    if charmap:
        n = pb.ModelProto()
        n.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
        m.normalizer_spec.precompiled_charsmap = n.normalizer_spec.precompiled_charsmap
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, dummy
    if not fallback:
        m.trainer_spec.byte_fallback = False
        kept = [p for p in m.pieces if p.type != pb.ModelProto.SentencePiece.BYTE]
        del m.pieces[:]
        m.pieces.extend(kept)
    return m.SerializeToString()


@pytest.mark.parametrize("kw", [{}, {"charmap": True}, {"charmap": True, "squeeze": True}, {"squeeze": True}, {"dummy": False},
                                {"charmap": True, "squeeze": True, "dummy": False}, {"fallback": False},
                                {"fallback": False, "charmap": True, "squeeze": True}])
def test_ids_spans_and_decoded_texts_equal_the_library(kw):
    model, rnd = variant(**kw), random.Random(1)
    own, lib = pieces.PieceCodec(model, limit=300), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    for s, (ids, spans, decoded) in zip(texts, own.encode([s.encode() for s in texts])):
        want = lib.encode(s, add_eos=True)
        assert ids.decode() == " ".join(map(str, want)) and decoded.decode() == lib.decode(want), s
        assert spans[:-1].tolist() == [[p.begin, p.end] for p in lib.encode(s, return_type="proto").pieces], s
        assert spans[-1, 0] == spans[-1, 1]


def test_spans_cover_the_text_in_order():
    texts = ["Naïve  ﬁne\n日本 x" * 3, "é" * 50, "<s> 😀😀 </s>"]
    for s, (_, spans, _) in zip(texts, pieces.PieceCodec(PATH).encode([s.encode() for s in texts])):
        raw = s.encode()
        assert b"".join(raw[a:b] for a, b in spans.tolist()) == raw


def expected(lib, text):
    ids = lib.encode(text or "", add_eos=True)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))


def test_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [r[:2] for r in ROWS] + [(70, "word " * 3000), (71, "x" * 5000), (71, "x" * 5000), (72, "日" * 700 + " " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r)[:4] for r in pieces.encode_documents(df, PATH).collect()), key=key)
    assert got == sorted(((i, *expected(lib, t)) for i, t in rows), key=key)
    full = pieces.encode_texts(df, PATH).collect()
    for r in full:
        text = dict(rows)[r["doc_id"]] or ""
        assert r["ids"] == lib.encode(text, add_eos=True) and len(r["starts"]) == len(r["ends"]) == len(r["ids"])
        assert r["decoded"] == lib.decode(r["ids"])
    assert [r["back"] for r in pieces.decode_ids(spark.createDataFrame([([1, 300, 2],), ([],), (None,)], "ids array<int>"),
                                                 PATH, text="back").collect()] == [lib.decode([1, 300, 2]), "", ""]


def test_edges(spark):
    assert pieces.encode_documents(edge_docs(spark), PATH).count() == len(ROWS)
    assert pieces.encode_documents(no_docs(spark), PATH).count() == 0 and pieces.encode_texts(no_docs(spark), PATH).count() == 0


def test_other_models_are_refused():
    m = pb.ModelProto()
    m.ParseFromString(variant())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError):
        pieces.PieceCodec(m.SerializeToString())


def test_texts_are_decoded_from_their_ids():
    own, asked = pieces.PieceCodec(PATH), []
    own.decode = lambda ids: asked.append(list(ids)) or "decoded"
    out = list(own.encode(["a b  c é".encode(), b""]))
    assert [" ".join(map(str, ids)) for ids in asked] == [ids.decode() for ids, _, _ in out]
    assert [decoded for _, _, decoded in out] == [b"decoded"] * 2

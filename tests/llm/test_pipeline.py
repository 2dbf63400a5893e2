import corpus_pipeline as P
from test_bpe import PATH, expected
from test_decontamination import brute as leaks
from test_jaccard import brute as near

from ledgerline.llm import bpe
from ledgerline.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    bench = [(str(r["item_id"]), r["text"]) for r in table(spark, SF, "benchmark").collect()]
    steps = [docs]
    for name, stage in P.STAGES:
        steps.append(written(stage(spark, steps[-1], SF), "test-stage"))
    raw, good, lines, distinct, clean, encoded = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    assert all(s.columns == columns for s in steps[:-1])
    assert good.keys() < raw.keys() and lines.keys() == good.keys()
    # near duplicates: the smallest id of each brute-force group
    groups = near([(i, r["text"]) for i, r in lines.items()])
    assert distinct.keys() == {i for i, _, c in groups if i == c}
    # decontamination: nothing is left, documents without a hit are as they were
    before = leaks([(i, r["text"]) for i, r in distinct.items()], bench)
    assert any(r[2] for r in before)
    for i, n_words, n_hit, *_ in before:
        if not n_hit:
            assert clean[i] == distinct[i]
        elif n_hit == n_words:
            assert i not in clean
    assert not any(r[2] for r in leaks([(i, r["text"]) for i, r in clean.items()], bench))
    # encoding: every row, as the library does it
    tok = bpe.load(PATH)
    assert {i: tuple(r)[1:] for i, r in encoded.items()} == {i: expected(tok, r["text"]) for i, r in clean.items()}
    whole = sorted(map(tuple, P.run(spark, SF).collect()))
    assert whole == sorted(map(tuple, encoded.values())) and P.ORACLE_SQL is None

import re

from edge import ROWS, edge_docs, no_docs

from ledgerline.llm import pii

TEXTS = [
    "Write to Anna.Lee42@mail3.example.com or call +1 (213) 555-0199, card 4111111111111111.",
    "ANNA.LEE42@mail3.example.com and anna.lee42@mail3.example.com; 4111-1111-1111-1111; ip 10.0.0.1.",
    "Mrs Clara Schmidt met Mr. Brown; Г-жа Анна Петрова; ssn 123-45-6789; 1.2.3.4.5 is no address",
    "no entities: 12 345 6.7 a@b", None, "",
]


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pii_report(df, key).collect()}


def test_format_coreference_and_rest(spark):
    out = replaced(spark, TEXTS)
    m = re.fullmatch(r"Write to ([A-Z][a-z]{3}\.[A-Z][a-z]{2}\d\d@[a-z]{4}\d\.[a-z]{7}\.com) or call "
                     r"(\+\d \(\d{3}\) \d{3}-\d{4}), card (\d{16})\.", out[0]["text"])
    assert m and m[1] != "Anna.Lee42@mail3.example.com" and m[3] != "4111111111111111"
    n = re.fullmatch(r"(\S+) and (\S+); (\d{4}-\d{4}-\d{4}-\d{4}); ip (\d+\.\d+\.\d+\.\d+)\.", out[1]["text"])
    assert n and n[1].lower() == n[2].lower() == m[1].lower()          # one address in three spellings
    assert n[3].replace("-", "") == m[3] and n[4] != "10.0.0.1"        # one card in two formats
    p = re.fullmatch(r"Mrs (\w+) (\w+) met Mr\. (\w+); Г-жа (\w+) (\w+); ssn \d{3}-\d{2}-\d{4}; 1\.2\.3\.4\.5 is no address", out[2]["text"])
    assert p and p[1] in pii.GIVEN["f", "latin"] and p[4] in pii.GIVEN["f", "cyrillic"]
    assert re.fullmatch(r"[А-я]+", p[5]) and p[2] != "Schmidt"
    assert out[3]["text"] == TEXTS[3] and out[4]["text"] == "" and out[5]["n_entities"] == 0
    assert out[0]["n_email"] == out[0]["n_phone"] == out[0]["n_card"] == 1 and out[2]["n_name"] == 3
    assert replaced(spark, TEXTS[:1], "other")[0]["text"] != out[0]["text"]


def test_collisions_are_resolved(spark):
    # 676 addresses of two letters: first attempts collide and hit real ones
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{a}{b}@x.org" for a in letters[:13] for b in letters[:13]]
    out = replaced(spark, texts)
    new = [out[i]["text"] for i in range(len(texts))]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)
    assert all(t.endswith(".org") and "@" in t for t in new)


def test_edges(spark):
    rows = pii.pii_report(edge_docs(spark), "k").collect()
    assert len(rows) == len(ROWS) and all(r["n_entities"] == 0 for r in rows)
    assert pii.pii_report(no_docs(spark), "k").count() == 0
    same = replaced(spark, ["a1.b2@c3.net"] * 3)
    assert len({r["text"] for r in same.values()}) == 1


FORMATS = {
    "phone": ["+1-555-123-4567", "+44 20 7946 0958", "+1 555 123 4567", "555 123 4567", "1-555-123-4567", "+49 (0)30 1234567",
              "+33 1 23 45 67 89", "(555) 123 4567", "020 7946 0958", "+1 (213) 555-0199"],
    "card": ["378282246310005", "3782 822463 10005", "30569309025904", "4222222222222", "4111 1111 1111 1111", "4111111111111111234"],
    "ip": ["2001:db8::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1", "::ffff:192.0.2.128", "10.1.2.3"],
    "name": ["Mr O'Brien", "Mrs Smith-Jones", "Mr John Paul Smith", "Dr Weber", "Prof. Ada Byron", "Mr J. Doe", "Dr. Ludwig van Beethoven"],
}


def test_formats(spark):
    cases = [(kind, e) for kind, es in FORMATS.items() for e in es]
    rest = ["at 12:30:45 std::vector", "1612345678901 ms", "Mr Smith's", "a: b :: c", "2001:db8::2 2001:0DB8:0:0:0:0:0:2"]
    out = replaced(spark, [f"see {e}, then" for _, e in cases] + rest)
    for i, (kind, e) in enumerate(cases):
        new = re.fullmatch(r"see (.+), then", out[i]["text"])[1]
        assert out[i]["n_entities"] == out[i]["n_" + kind] == 1 and new != e, (e, new)
        for word in re.findall(r"[A-Z][a-z]{3,}", e.replace("Prof", "")) if kind == "name" else []:
            assert word not in new, (e, new)
        if kind in ("phone", "card"):
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", e)
    *plain, same = [out[len(cases) + i] for i in range(len(rest))]
    assert [r["n_entities"] for r in plain] == [0, 0, 1, 0] and plain[2]["text"].endswith("'s")
    a, b = same["text"].split()
    assert a.lower() == b.lower() and same["n_ip"] == 2


def test_coreference_of_names_and_phones(spark):
    texts = ["Mr. Brown called. Mr Brown left; later Brown and Browning met Mr John Brown, then John. BROWN!",
             "Dr Brown, Mrs Ann Brown-Lee and Ann; Prof. J. van Brown. Lee stays",
             "+1 (213) 555-0199 or (213) 555-0199 or 213.555.0199 or 1-213-555-0199",
             "Mrs Smith saw Mr Peter Smith, Mr Paul Smith and Mr Mary Smith", "Brown bread"]
    out = replaced(spark, texts)
    m = re.fullmatch(r"Mr\. (\w+) called\. Mr (\w+) left; later (\w+) and Browning met Mr (\w+) (\w+), then (\w+)\. (\w+)!", out[0]["text"])
    brown, john = m[1], m[4]
    assert brown == m[2] == m[3] == m[5] != "Brown" and john == m[6] != "John"
    n = re.fullmatch(r"Dr (\w+), Mrs (\w+) (\w+-\w+) and (\w+); Prof\. ([A-Z])\. van (\w+)\. Lee stays", out[1]["text"])
    assert n[1] == n[6] == brown and n[2] == n[4] != "Ann" and n[2].endswith("a") and n[3] != "Brown-Lee"
    phones = re.fullmatch(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})\.(\d{3})\.(\d{4}) or 1-(\d{3})-(\d{3})-(\d{4})",
                          out[2]["text"]).groups()
    assert len({phones[k:k + 3] for k in (0, 3, 6, 9)}) == 1 and phones[:3] != ("213", "555", "0199")
    p = re.fullmatch(r"Mrs (\w+) saw Mr (\w+) (\w+), Mr (\w+) (\w+) and Mr (\w+) (\w+)", out[3]["text"])
    assert p[1] == p[3] == p[5] == p[7] != "Smith" and len({p[2], p[4], p[6]}) == 3    # distinct given names stay distinct
    assert out[4]["text"] == "Brown bread"                                   # no name is detected in that document
    assert [out[i]["n_name"] for i in range(5)] == [3, 3, 0, 4, 0]


def test_name_surrogates_equal_brute_force(spark):
    """Every part of a name is replaced by one injective mapping, in every document; the mapping hits no real part."""
    parts = [f"{a}{b}" for a in ("Bro", "Smi", "Tay", "Wil", "Joh") for b in ("wn", "th", "lor", "son", "ez", "ida")]
    texts = [f"Mr {parts[i % 30]} {parts[(i * 7 + 3) % 30]} wrote; {parts[i % 30]} was here." for i in range(60)]
    out, seen = replaced(spark, texts), {}
    for i, text in enumerate(texts):
        old, new = re.findall(r"[A-Z]\w{2,}", text), re.findall(r"[A-Z]\w{2,}", out[i]["text"])
        assert len(old) == len(new)
        for a, b in zip(old, new):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen) and not set(seen.values()) & set(parts)

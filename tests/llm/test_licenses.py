import pytest
from edge import ROWS, edge_docs, no_docs, words

from ledgerline.llm.licenses import BASE, Matcher, compile_template, scan_licenses


def accepts(markup, text):
    w = text.encode().split()
    hit = compile_template(markup).longest(w, 0)
    return hit is not None and hit[0] == len(w)


def test_template_markup():
    m = "released under [[ the ]] {{2}} (mit | isc) license"
    assert accepts(m, "released under mit license")
    assert accepts(m, "released under the big old isc license")
    assert not accepts(m, "released under the one two three mit license")
    assert not accepts(m, "released under the mit")
    assert not accepts(m, "released the mit license")
    assert accepts("a [[ b [[ c ]] ]] d", "a b c d") and accepts("a [[ b [[ c ]] ]] d", "a d")
    for bad in ("[[ a", "a ]]", "a )", "( a"):
        with pytest.raises(ValueError):
            compile_template(bad)
    for empty in ("{{3}}", "[[ a ]] {{2}}"):
        with pytest.raises(ValueError):
            Matcher([], [("x", empty)])


def test_a_leading_region_takes_no_words():
    n, found = Matcher([], [("x", "{{3}} is free software")]).scan(b"The Big Program is free software; is free beer")
    assert n == 9 and [(a, b, label) for a, b, label, *_ in found] == [(3, 6, "x")]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
         "derived from this software without specific prior written permission.\n")
GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as "
       "published by the Free Software Foundation, either version %s of the License, or (at your option) any later version.")


def test_whole_wordings():
    cases = {"mit": MIT, "bsd-2-clause": BSD % "", "bsd-3-clause": BSD % THIRD, "gpl-2": GNU % ("", "2"), "agpl-3": GNU % ("Affero ", "3"),
             "lgpl": GNU % ("Lesser ", "2.1"), "gpl-3": GNU % ("", "3"),
             "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
             "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
             "cc0": "To the extent possible under law, Ann Example has waived all copyright and related or neighboring rights to This Work."}
    for label, text in cases.items():
        assert {f[2] for f in Matcher().scan(text.encode())[1]} == {label}, label
    # a sentence is not the licence, nor is a text with a changed mandatory word
    assert Matcher().scan(MIT.split("\n\n")[0].encode())[1] == []
    assert Matcher().scan(MIT.replace("SHALL", "WILL").encode())[1] == []


def test_own_templates(spark):
    df = spark.createDataFrame([(1, "the beer licence of Bob: buy me a beer"), (2, "under the mit license")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(df, [("beer", "beer licence {{3}} buy me a (beer | wine)")]).collect()}
    assert got == {1: "beer", 2: "mit"}
    with pytest.raises(ValueError):
        scan_licenses(df, [("bad", "[[ open")])


def brute(text):
    w = words(text)
    found = [(k, label) for p, label in BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    return (len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None),
            ",".join(sorted({x for _, x in found})))


def test_places_equal_brute_force(spark):
    texts = ["Released under the MIT License.", "UNDER the mit-license under  the MIT license x",
             "Licensed under the Apache License, Version 2.0. Also CC BY-NC 4.0.", "cc by nd", "under the mitt license",
             "cc by nc cc by nc", None, "All rights reserved", "Licensed under CC BY 4.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert got[7]["labels"] == "all-rights-reserved" and got[8]["labels"] == "cc-by"


def test_no_text_with_a_match_misses_its_anchor():
    m = Matcher()
    for label, automaton, _ in m.rules:
        assert automaton.first_words()
    assert all(len(a) > 1 for a in m.anchors)


def test_edges(spark):
    rows = scan_licenses(edge_docs(spark)).collect()
    assert len(rows) == len(ROWS) and all(r["labels"] == "" and r["score"] == 0 for r in rows)
    assert scan_licenses(no_docs(spark)).count() == 0

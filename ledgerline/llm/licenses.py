"""Operator 1, license scans: template markup compiled to token automata.

A template is wording with two kinds of marked regions:

- ``[[ ... ]]``: optional words, which a text may leave out;
- ``{{n}}``: a replaceable region, at most ``n`` words of any wording (a name, a year); in front of a template it
  takes no words, so a match begins at the first word of the wording;
- ``( a | b )`` inside neither: one of several mandatory words.

:func:`compile_template` turns it into an automaton over words whose only free moves are the marked regions. A
text is accepted from a word on if it carries all mandatory wording exactly and in order. Matching starts
only at words that can begin a template, and only in texts that hold some template's anchor word, so the
work is one pass over the bytes for almost all texts. Callers may pass templates and base phrases of their own.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows get a row each;
other columns are ignored; very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import WORD_BYTES, id_and_text, map_arrow, texts_of

# The base phrases with their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Wording of common notices and licences, in the markup described above.
AS_IS = ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
         "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
         "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
         "or in connection with the software or the use or other dealings in the software")
BSD_CLAUSES = ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
               "following conditions are met [[ 1 ]] redistributions of source code must retain the above copyright notice this "
               "list of conditions and the following disclaimer [[ 2 ]] redistributions in binary form must reproduce the above "
               "copyright notice this list of conditions and the following disclaimer in the documentation and or other "
               "materials provided with the distribution")
NO_ENDORSEMENT = ("[[ 3 ]] neither the (name | names) of {{8}} nor the names of [[ its ]] [[ other ]] contributors may be used to endorse or "
                  "promote products derived from this software without specific prior written permission")
BSD_WARRANTY = ("this software is provided by the copyright holders and contributors as is and any express or implied warranties "
                "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed")
FREE_PROGRAM = "{{1}} is free software you can redistribute it and or modify it under the terms of the gnu"
PUBLISHED = "general public license as published by the free software foundation either version"
TEMPLATES = [
    ("mit", "(released | licensed | distributed | available) under the [[ terms of the ]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy "
            "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
            "software is furnished to do so subject to the following conditions the above copyright notice and this permission "
            "notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software "
            + AS_IS),
    ("isc", "permission to use copy modify and (or | and) [[ or ]] distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies the software is "
            "provided as is and {{6}} disclaims all warranties with regard to this software including all implied warranties of "
            "merchantability and fitness"),
    ("bsd-2-clause", f"{BSD_CLAUSES} {BSD_WARRANTY}"),
    ("bsd-3-clause", f"{BSD_CLAUSES} {NO_ENDORSEMENT} {BSD_WARRANTY}"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
                  "compile sell or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for "
             "any damages arising from the use of this software permission is granted to anyone to use this software for any "
             "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
             "restrictions"),
    ("apache-2", "licensed under the apache license version 2 [[ 0 ]]"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
                 "license you may obtain a copy of the license at {{10}} unless required by applicable law or agreed to in writing "
                 "software distributed under the license is distributed on an as is basis without warranties or conditions of any "
                 "kind either express or implied"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
              "distributed with this file you can obtain one at"),
    ("gpl-3", "under the [[ terms of the ]] gnu general public license [[ as published by the free software foundation ]] "
              "[[ either ]] (version | v) 3 [[ or any later version ]]"),
    ("gpl-2", f"{FREE_PROGRAM} {PUBLISHED} 2 of the license or [[ at your option ]] any later version"),
    ("gpl-3", f"{FREE_PROGRAM} {PUBLISHED} 3 of the license or [[ at your option ]] any later version"),
    ("lgpl", f"{FREE_PROGRAM} (lesser | library) {PUBLISHED} (2 | 3) [[ 1 ]] of the license or [[ at your option ]] any later version"),
    ("agpl-3", f"{FREE_PROGRAM} affero {PUBLISHED} 3 of the license or [[ at your option ]] any later version"),
    ("cc-by-nc", "licensed under [[ the ]] (cc | creative) [[ commons ]] by nc [[ {{1}} 0 ]]"),
    ("cc-by", "licensed under [[ the ]] cc by (1 | 2 | 3 | 4) 0"),
    ("cc-by", "licensed under [[ a ]] [[ the ]] creative commons attribution (1 | 2 | 3 | 4) (0 | 5) [[ international ]] license"),
    ("cc-by-sa", "licensed under [[ a ]] [[ the ]] creative commons attribution (sharealike | share) [[ alike ]] (1 | 2 | 3 | 4) (0 | 5) [[ international ]] license"),
    ("cc-by-sa", "licensed under [[ the ]] cc by sa (1 | 2 | 3 | 4) 0"),
    ("cc0", "to the extent possible under law {{8}} has waived all copyright and related or neighboring rights to"),
    ("all-rights-reserved", "[[ copyright [[ c ]] {{6}} ]] all rights reserved"),
]

ANY = b""  # edge taken by any word


@dataclass
class Automaton:
    """States 0..n-1; ``edges[s]`` maps a word to next states, ``free[s]`` are moves without a word."""

    edges: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    accept: int = 0

    def state(self) -> int:
        self.edges.append({})
        self.free.append([])
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def first_words(self) -> set[bytes]:
        """Words that can begin a match (a replaceable region in front takes none)."""
        return {w for s in self.closure({0}) for w in self.edges[s]} - {ANY}

    def longest(self, words: list[bytes], at: int) -> tuple[int, int] | None:
        """(end, words taken literally) of the longest accepted wording that starts at ``at``."""
        now, best = {s: 0 for s in self.closure({0})}, None
        for i in range(at, len(words) + 1):
            if self.accept in now:
                best = (i, now[self.accept])
            if i == len(words) or not now:
                break
            after: dict[int, int] = {}
            for s, literal in now.items():
                for key, gain in ((words[i], 1), (ANY, 0)):
                    for t in self.edges[s].get(key, ()):
                        for u in self.closure({t}):
                            after[u] = max(after.get(u, 0), literal + gain)
            now = after
        return best


def compile_template(markup: str) -> Automaton:
    """Template markup to an automaton; unbalanced marks raise ValueError."""
    a, now, opened = Automaton(), 0, []
    alternatives: list[str] | None = None
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[()|]|[^\s\[\]{}()|]+", markup):
        if part == "[[":
            opened.append(now)
        elif part == "]]":
            if not opened:
                raise ValueError(f"']]' without '[[' in {markup!r}")
            a.free[opened.pop()].append(now)
        elif part == "(":
            alternatives = []
        elif part == ")":
            if alternatives is None:
                raise ValueError(f"')' without '(' in {markup!r}")
            new = a.state()
            for w in alternatives:
                a.edges[now].setdefault(w.encode(), []).append(new)
            now, alternatives = new, None
        elif part == "|":
            continue
        elif part.startswith("{{"):
            end, states = a.state(), [now]
            for _ in range(int(part[2:-2])):
                states.append(a.state())
                a.edges[states[-2]].setdefault(ANY, []).append(states[-1])
            for s in states:
                a.free[s].append(end)
            now = end
        elif alternatives is not None:
            alternatives.append(part)
        else:
            new = a.state()
            a.edges[now].setdefault(part.encode(), []).append(new)
            now = new
    if opened or alternatives is not None:
        raise ValueError(f"open mark in {markup!r}")
    a.accept = now
    return a


class Matcher:
    """All templates, indexed by the words that can begin them."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.rules = [(label, compile_template(m), True) for m, label in base]
        self.rules += [(label, compile_template(m), False) for label, m in templates]
        self.starts: dict[bytes, list[int]] = {}
        for k, (_, automaton, _) in enumerate(self.rules):
            for w in automaton.first_words():
                self.starts.setdefault(w, []).append(k)
        # a text without any anchor cannot be accepted: each template has one mandatory word among them
        self.anchors = sorted({self._anchor(m) for m in [*(m for m, _ in base), *(m for _, m in templates)]})

    @staticmethod
    def _anchor(markup: str) -> bytes:
        """The longest mandatory word of a template."""
        depth, words = 0, []
        for part in re.findall(r"\[\[|\]\]|\([^)]*\)|\{\{\d+\}\}|[^\s\[\]{}()|]+", markup):
            depth += (part == "[[") - (part == "]]")
            if not depth and re.fullmatch(r"[^\[\](){}|]+", part):
                words.append(part)
        if not words:
            raise ValueError(f"no mandatory word in {markup!r}")
        return max(words, key=len).encode()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str, bool, float]]]:
        """(words, matches as (start, end, label, is a base phrase, score))."""
        plain = text.translate(WORD_BYTES)
        words = plain.split()
        found: list[tuple[int, int, str, bool, float]] = []
        if not any(x in plain for x in self.anchors):
            return len(words), found
        starts = self.starts
        for i in [i for i, w in enumerate(words) if w in starts]:
            for k in starts[words[i]]:
                label, automaton, base = self.rules[k]
                if hit := automaton.longest(words, i):
                    end, literal = hit
                    found.append((i, end, label, base, literal / (end - i) * min(1.0, literal / 4)))
        return len(words), found


@lru_cache(maxsize=8)
def matcher(base: tuple, templates: tuple) -> Matcher:
    """One matcher per worker process and set of templates."""
    return Matcher(base, templates)


SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<struct<start:bigint,end:bigint,label:string>>")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """One row per document: word counts, base phrases, all labels, score and spans (in words, end exclusive).

    ``templates``: (label, markup) pairs; ``base``: (phrase, label) pairs, which are counted besides.
    """
    own = tuple(map(tuple, base)), tuple(map(tuple, templates))
    Matcher(*own)                                                  # bad markup fails here, not in a task

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(*own)
        for batch in batches:
            rows = []
            for text in texts_of(batch.column("text")):
                n, found = m.scan(text)
                first = [f for f in found if f[3]]
                places = [f[0] for f in first]
                rows.append((n, len(first), min(places, default=None), max(places, default=None),
                             ",".join(sorted({f[2] for f in first})), ",".join(sorted({f[2] for f in found})),
                             max((f[4] for f in found), default=0.0),
                             [{"start": f[0], "end": f[1], "label": f[2]} for f in sorted(found)]))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return map_arrow(id_and_text(docs), scan, SCHEMA)

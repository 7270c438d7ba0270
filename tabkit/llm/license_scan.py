"""License scans by template markup.

Method: a template is wording with replaceable ``<<...>>`` and optional
``[[...]]`` regions.  It is compiled into a token automaton that accepts the
texts whose mandatory words are all there, in order and next to each other;
a replaceable region stands for words of any kind, as many as its markup says
(``<<wording;200>>``: 200 at most) or REGION.  Short base phrases
are the same without regions.

Defined results: a null or empty text has no words, no labels and score 0.
Score is 1 where a template accepts, 0.5 where only a base phrase occurs; ties
and repeated rows are scanned each; a very long text is one row, whose words a
task holds; an empty table gives an empty one; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .decontam import words_of
from .frames import texts
from .textbytes import texts_of

# Phrases and labels that results must have.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Longest replaceable region, in words, where its markup names no length.
REGION = 12

#: Wording of licenses and their notices, lower case, without punctuation.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of <<this software and associated documentation files the software;40>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _WARRANTY,
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of <<this software;200>> to deal in the software without restriction",
    "isc": "permission to use copy modify [[and]] [[and or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<the author;20>> disclaims all warranties with regard to this software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-2-clause": _BSD + " this software is provided by <<the copyright holders and contributors;30>> as is and any express or implied warranties",
    "bsd-3-clause": _BSD + " [[3]] neither the name of <<the copyright holder;20>> nor the names of [[its]] [[his]] [[their]] contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<http www apache org licenses license 2 0;12>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-2.0-notice": "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or [[at your option]] any later version",
    "gpl-3.0-or-later-notice": "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version",
    "lgpl-notice": "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [[either]] version <<2 1;2>> of the license",
    "agpl-notice": "free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation [[either]] version <<3;2>> of the license",
    "gpl-notice": "free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation",
    "gpl-3.0-notice": "licensed under the gnu general public license version 3",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by-nc-notice": "licensed under [[a]] [[the]] cc by nc",
    "cc-by-sa-notice": "licensed under [[a]] [[the]] cc by sa",
    "cc-by-4.0-notice": "licensed under [[a]] [[the]] cc by 4 0",
    "cc-by-full-notice": "this work is licensed under a creative commons attribution <<noncommercial sharealike;3>> 4 0 international license",
    "mit-notice": "released under the mit license",
    "public-domain": "dedicated to the public domain",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}


class Template:
    """A token automaton; states are places in ``items``: (kind, word, target or length)."""

    def __init__(self, markup: str):
        self.items: list[tuple[str, str, int]] = []
        for part in re.findall(r"<<.*?>>|\[\[.*?\]\]|\S+", markup):
            if part.startswith("<<"):
                self.items.append(("any", "", int(part[2:-2].partition(";")[2] or REGION)))
            elif part.startswith("[["):
                words = part[2:-2].split()
                self.items.append(("skip", "", len(self.items) + 1 + len(words)))
                self.items += [("word", w, 0) for w in words]
            else:
                self.items.append(("word", part, 0))
        self.end = len(self.items)
        lead = []
        for kind, word, _ in self.items:
            if kind != "word":
                break
            lead.append(word)
        self.lead = " ".join(lead).encode()
        self.items = [(k, w.encode(), n) for k, w, n in self.items]

    def _close(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """All (item, words taken by its region) reachable without a word."""
        out, todo = set(states), list(states)
        while todo:
            at, _ = todo.pop()
            if at < self.end:
                kind, _, n = self.items[at]
                for to in (at + 1, n) if kind == "skip" else (at + 1,) if kind == "any" else ():
                    if (to, 0) not in out:
                        out.add((to, 0))
                        todo.append((to, 0))
        return out

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether the wording stands from a place on."""
        states = self._close({(0, 0)})
        for i in range(start, len(words) + 1):
            if any(at == self.end for at, _ in states):
                return True
            if i == len(words):
                return False
            step = set()
            for at, taken in states:
                kind, word, n = self.items[at]
                if kind == "word" and word == words[i]:
                    step.add((at + 1, 0))
                elif kind == "any" and taken + 1 <= n:
                    step.add((at, taken + 1))
            states = self._close(step)
            if not states:
                return False
        return False


def _places(text: bytes, phrase: bytes):
    """Word places of a phrase in words that single spaces part, with one before and after."""
    at, last, words = text.find(phrase), 0, 0
    while at >= 0:
        words += text.count(b" ", last, at)
        last = at
        yield words
        at = text.find(phrase, at + 1)


def scan(text: bytes, base: dict[bytes, str], templates: dict[str, Template]):
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    places, base_labels, found = [], set(), set()
    for phrase, label in base.items():
        own = list(_places(line, phrase))
        if own:
            places += own
            base_labels.add(label)
    for label, t in templates.items():
        if any(t.accepts(words, i) for i in _places(line, b" " + t.lead + b" ")):
            found.add(label)
    return len(words), places, base_labels, found


def _scan(batches):
    base = {b" " + k.encode() + b" ": v for k, v in BASE.items()}
    templates = {k: Template(v) for k, v in TEMPLATES.items()}
    for b in batches:
        for t in texts_of(b.column("text")):
            rows = [scan(t.bytes(i), base, templates) for i in range(len(t))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").slice(t.first, len(t)),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                    pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                    pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                    pa.array([",".join(sorted(r[2] | r[3])) for r in rows], pa.string()),
                    pa.array([1.0 if r[3] else 0.5 if r[2] else 0.0 for r in rows], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def pattern(markup: str) -> str:
    """The regular expression of a template, for words with a space after each."""
    out = []
    for part in re.findall(r"<<.*?>>|\[\[.*?\]\]|\S+", markup):
        if part.startswith("<<"):
            out.append("([^ ]+ ){0,%d}" % int(part[2:-2].partition(";")[2] or REGION))
        elif part.startswith("[["):
            out.append(f"({part[2:-2].strip()} )?")
        else:
            out.append(f"{part} ")
    return "".join(out)


def scan_sql() -> str:
    """DuckDB SQL of the same scan: templates are regular."""
    base = ", ".join(f"case when contains(line, ' {k} ') then '{v}' end" for k, v in BASE.items())
    found = ", ".join(f"case when regexp_matches(line, ' {pattern(v)}') then '{k}' end" for k, v in TEMPLATES.items())
    places = " union all ".join(f"select doc_id, unnest(list_filter(range(1, len(w) - {k.count(' ') - 1}), lambda i: array_to_string(w[i:i + {k.count(' ')}], ' ') = '{k}')) as pos from d where contains(line, ' {k} ')" for k in BASE)
    return f"""with t as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
d as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as line from t),
p as (select doc_id, count(*) as n_base, min(pos) - 1 as first_word, max(pos) - 1 as last_word from ({places}) group by doc_id),
l as (select doc_id, len(w) as n_words, list_sort(list_distinct([{base}])) as b, list_distinct([{found}]) as f from d)
select l.doc_id, n_words, coalesce(n_base, 0) as n_base, first_word, last_word, array_to_string(b, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(b, f))), ',') as labels, case when len(f) > 0 then 1.0::double when len(b) > 0 then 0.5::double else 0.0::double end as score from l left join p on p.doc_id = l.doc_id"""


def license_scan(docs: DataFrame) -> DataFrame:
    return texts(docs).mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

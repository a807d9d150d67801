"""License scans by template-markup matching (operator 1).

A template is a list of mandatory words with marked regions: `<<opt>> ... <</opt>>` may be left out, `<<var:N>>` stands
for up to N words of any kind. All templates are compiled into one token automaton that is made deterministic while it
runs; a place matches when the automaton, started at a word, accepts, that is, when every mandatory word is there.

Defined cases: null or empty text has no words, no places, empty labels and score 0; places may overlap and all count;
repeated rows each give a row; other columns are ignored; texts of any length are scanned whole.
A template may begin with a free region; then a match may begin at any word. Score: 1 where a whole license text stands,
with all its mandatory wording, else 0.75 where a notice that names a license does, else 0.5 where only a base phrase
stands, else 0.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, in_batches, words_of

#: Base phrases and their labels (fixed values).
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
_SOFTWARE = "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_REDISTRIBUTION = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>> 1 <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>> 2 <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
#: Whole license texts (fixed values: wordings of public licenses; names and numbers of clauses are free or may be left out).
WHOLE = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <</opt>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2-text": f"{_REDISTRIBUTION} {_SOFTWARE}",
    "bsd-3-text": f"{_REDISTRIBUTION} <<opt>> 3 <</opt>> neither the name of <<var:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_SOFTWARE}",
    "isc-text": "permission to use copy modify <<opt>> and <</opt>> <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<opt>> http <</opt>> <<opt>> https <</opt>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
}
#: Notices that name a license (fixed values).
NOTICES = {
    "mit-notice": "<<opt>> this work is <</opt>> released under the <<opt>> terms of the <</opt>> mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>> the software <</opt>> to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license version 2 0 <<opt>> the license <</opt>>",
    "gpl-3.0": "licensed under the gnu general public license version 3 <<opt>> or later <</opt>>",
    "lgpl-3.0": "licensed under the gnu lesser general public license version 3 <<opt>> or later <</opt>>",
    "agpl-3.0": "licensed under the gnu affero general public license version 3 <<opt>> or later <</opt>>",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "cc-by-4.0": "licensed under <<opt>> the <</opt>> <<opt>> a <</opt>> <<opt>> creative commons <</opt>> cc by 4 0",
    "cc-by-sa-4.0": "licensed under <<opt>> the <</opt>> <<opt>> a <</opt>> <<opt>> creative commons <</opt>> cc by sa 4 0",
    "cc-by-nc-4.0": "licensed under <<opt>> the <</opt>> <<opt>> a <</opt>> <<opt>> creative commons <</opt>> cc by nc 4 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "all-rights": "copyright <<opt>> c <</opt>> <<var:8>> all rights reserved",
}
MARK = re.compile(r"<<opt>>|<</opt>>|<<var:(\d+)>>|[^\s<]+")
ANY = b""
MOST_STATES = 50_000


class Automaton:
    """Templates as a token NFA with lazily made deterministic states."""

    def __init__(self, templates: dict[str, str]):
        self.arcs: list[dict[bytes, list[int]]] = []
        self.free: list[list[int]] = []
        self.label: dict[int, str] = {}
        begin = self.node()
        for label, template in templates.items():
            here, opened = self.node(), []
            self.free[begin].append(here)
            for mark in MARK.finditer(template):
                if mark[0] == "<<opt>>":
                    opened.append(here)
                elif mark[0] == "<</opt>>":
                    after = self.node()
                    self.free[here].append(after)
                    self.free[opened.pop()].append(after)
                    here = after
                elif mark[1]:
                    after = self.node()
                    for _ in range(int(mark[1])):
                        self.free[here].append(after)
                        step = self.node()
                        self.arcs[here].setdefault(ANY, []).append(step)
                        here = step
                    self.free[here].append(after)
                    here = after
                else:
                    step = self.node()
                    self.arcs[here].setdefault(mark[0].encode(), []).append(step)
                    here = step
            self.label[here] = label
        self.vocabulary = {w for arcs in self.arcs for w in arcs}
        self.start = self.closed([begin])
        self.steps: dict[tuple[frozenset, bytes], frozenset] = {}
        self.found: dict[frozenset, tuple[str, ...]] = {}
        #: Words a match can begin with; with a free region in front, any.
        self.first = {w for n in self.start for w in self.arcs[n]}
        self.anywhere = ANY in self.first

    def node(self) -> int:
        self.arcs.append({})
        self.free.append([])
        return len(self.arcs) - 1

    def closed(self, nodes) -> frozenset:
        seen, todo = set(), list(nodes)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.free[n]
        return frozenset(seen)

    def step(self, state: frozenset, word: bytes) -> frozenset:
        word = word if word in self.vocabulary else ANY
        after = self.steps.get((state, word))
        if after is None:
            if len(self.steps) > MOST_STATES:
                self.steps.clear()
            to = [m for n in state for m in (*self.arcs[n].get(word, ()), *(self.arcs[n].get(ANY, ()) if word != ANY else ()))]
            after = self.steps[state, word] = self.closed(to)
        return after

    def labels(self, state: frozenset) -> tuple[str, ...]:
        if state not in self.found:
            self.found[state] = tuple(sorted(self.label[n] for n in state if n in self.label))
        return self.found[state]

    def places(self, words: list[bytes]):
        """(start, end, label) of every place; the shortest end of each label."""
        for i in range(len(words)) if self.anywhere else [i for i, w in enumerate(words) if w in self.first]:
            state, k, seen = self.start, i, set()
            while state and k < len(words):
                state = self.step(state, words[k])
                k += 1
                for label in self.labels(state):
                    if label not in seen:
                        seen.add(label)
                        yield i, k, label


@functools.cache
def automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(dict(templates))


def scan(df: DataFrame, whole: dict[str, str] = WHOLE, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (start, end, label)."""
    every = tuple((base | notices | whole).items())

    def run(batches):
        machine = automaton(every)
        for part in chunks(batches):
            out = []
            for text in part.column(1).to_pylist():
                words = words_of(text)
                places = list(machine.places(words))
                at = [i for i, _, label in places if label in base]
                labels = {label for _, _, label in places}
                out.append(
                    (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels & set(base))),
                     ",".join(sorted(labels)), 1.0 if labels & set(whole) else 0.75 if labels & set(notices) else 0.5 if labels else 0.0,
                     [{"start": i, "end": k, "label": label} for i, k, label in places])
                )
            place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), place]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(zip(*out), types))], [id_col, *NAMES])

    NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    return in_batches(df.select(id_col, text_col),
        run,
        f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, places array<struct<start:long,end:long,label:string>>",
    )


def as_regex(template: str) -> str:
    """A template as a pattern over blank-joined words, for the SQL check."""
    out = []
    for mark in MARK.finditer(template):
        out.append("(?:" if mark[0] == "<<opt>>" else ")?" if mark[0] == "<</opt>>" else rf"(?:[^ ]+ ){{0,{mark[1]}}}" if mark[1] else mark[0] + " ")
    return " " + "".join(out)


def oracle() -> str:
    """DuckDB SQL for the query."""
    place = " or ".join("(" + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(), 1)) + ")" for p in BASE.values())
    label = lambda d: ", ".join(f"case when regexp_matches(j, '{as_regex(t)}') then '{name}' end" for name, t in d.items())
    joined = lambda d: f"coalesce(array_to_string(list_sort(list_filter([{label(d)}], lambda x: x is not null)), ','), '')"
    return f"""
    with a as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    b as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as j, list_filter(range(len(w)), lambda i: coalesce({place}, false)) as pos from a),
    c as (select *, {joined(BASE)} as base_labels, {joined(BASE | NOTICES | WHOLE)} as labels, {joined(WHOLE)} as texts, {joined(NOTICES)} as notices from b)
    select doc_id, cast(len(w) as bigint) as n_words, cast(len(pos) as bigint) as n_base, list_min(pos) as first_word, list_max(pos) as last_word,
      base_labels, labels, cast(case when texts <> '' then 1 when notices <> '' then 0.75 when labels <> '' then 0.5 else 0 end as double) as score from c"""

"""License scans by template-markup matching.

A template is wording with two kinds of regions: [[words]] may be left out, and {low-high} stands for any low to high words
(a name, a year). It is compiled into an automaton over words; a text is accepted where the automaton
gets through, that is, where all mandatory words stand exactly and in order. Letters count without case, and punctuation
and spacing do not count.

A text's words are numbered over all templates' vocabulary. The automaton is started only where the two words at
hand can begin the template, which NumPy finds for all places at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.text import ALNUM, Words, buffers, chunks, columns

#: (phrase, label): the base, wording without markup.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Wording of the licences. Their full texts as published, and the notices by which works are put under them.
MIT_TEXT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including "
    "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the "
    "following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided "
    "as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
    "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
    "in the software"
)
BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_THIRD = "[[3]] [[c]] neither the name of [[the]] {1-12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_TAIL = (
    "this software is provided by {1-8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
    "event shall {1-8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if "
    "advised of the possibility of such damage"
)
APACHE_NOTICE = (
    "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at {1-8} unless required by applicable law or "
    "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
    "governing permissions and limitations under the license"
)
GPL_NOTICE = "[[this {1-3}]] is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"
LGPL_NOTICE = "[[this {1-3}]] is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version"
MPL_NOTICE = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {1-8}"

#: (label, template). Regions for any words stand for names, years and addresses, and optional ones for list marks and defined terms; all other
#: wording is mandatory.
TEMPLATES = (
    ("mit", MIT_TEXT),
    ("mit", "[[this {1-4}]] [[is]] [[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("apache-2", APACHE_NOTICE),
    ("apache-2", "licensed under the apache license [[version]] 2 0 [[the license]]"),
    ("apache-2", "licensed under the [[terms of the]] apache license version 2"),
    ("gpl-3", f"{GPL_NOTICE} 3 of the license"),
    ("gpl-3", "[[this {1-4} is]] licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2", f"{GPL_NOTICE} 2 of the license"),
    ("gpl-2", "[[this {1-4} is]] licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("lgpl-3", f"{LGPL_NOTICE} 3 of the license"),
    ("lgpl-2.1", f"{LGPL_NOTICE} 2 1 of the license"),
    ("mpl-2", MPL_NOTICE),
    ("bsd-3-clause", f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}"),
    ("bsd-2-clause", f"{BSD_HEAD} {BSD_TAIL}"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by nc [[{1-2}]]"),
    ("cc-by-nc", "licensed under [[a]] [[the]] creative commons attribution noncommercial [[{1-2}]] [[international]] license"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[{1-2}]] [[international]] license"),
    ("all-rights-reserved", "[[copyright [[c]] {1-8}]] all rights reserved"),
)

_PART = re.compile(r"\[\[|\]\]|\{\d+-\d+\}|[^\s\[\]{}]+")


class Automaton:
    """States are places in the template; `steps[s]` maps a word number, or None for any word, to the next states, and
    states that can be passed over for nothing are followed at once."""

    def __init__(self, template: str, number):
        self.steps: list[dict[int | None, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        opened: list[int] = []
        now = 0
        self.mandatory = 0
        for part in _PART.findall(template):
            if part == "[[":
                opened.append(now)
            elif part == "]]":
                self.free[opened.pop()].add(now)
                # what follows starts from a state of its own, so that a skipped region can't be entered again
                now = self._add(now, free=True)
            elif part[0] == "{":
                low, high = map(int, part[1:-1].split("-"))
                skips = []
                for i in range(high):
                    if i >= low:
                        skips.append(now)
                    now = self._add(now, None)
                for s in skips:
                    self.free[s].add(now)
            else:
                now = self._add(now, number(part))
                self.mandatory += not opened
        if opened or not self.mandatory:
            raise ValueError(f"template with an open region or without mandatory words: {template!r}")
        self.end = now
        self.first = self.closure({0})
        if self.end in self.first:
            raise ValueError(f"template that accepts nothing at all: {template!r}")

    def _add(self, before: int, word: int | None = None, free: bool = False) -> int:
        self.steps.append({})
        self.free.append(set())
        at = len(self.steps) - 1
        if free:
            self.free[before].add(at)
        else:
            self.steps[before].setdefault(word, set()).add(at)
        return at

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def after(self, states: frozenset[int], word: int) -> frozenset[int]:
        out: set[int] = set()
        for s in states:
            out |= self.steps[s].get(word, set()) | self.steps[s].get(None, set())
        return self.closure(out)

    def begins(self, n: int) -> np.ndarray:
        """[a, b]: the template can begin with words a, b (0: any other word, n: no word)."""
        out = np.zeros((n + 1, n + 1), dtype=bool)
        for a in range(n):
            if states := self.after(self.first, a):
                out[a] = self.end in states
                for b in range(n):
                    out[a, b] |= bool(self.after(states, b))
        return out

    def accepts(self, words: list[int]) -> int:
        """Words of the longest acceptance from the beginning, 0 if there is none."""
        states, longest = self.first, 0
        for i, word in enumerate(words, 1):
            if not (states := self.after(states, word)):
                break
            if self.end in states:
                longest = i
        return longest

    def longest(self) -> int:
        """Words that an acceptance can have at most."""
        return len(self.steps)


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda word: self.vocabulary.setdefault(word.lower().encode(), len(self.vocabulary) + 1)
        self.base = [(label, Automaton(phrase, number)) for phrase, label in phrases]
        self.more = [(label, Automaton(template, number)) for label, template in templates]
        n = len(self.vocabulary) + 1
        self.all = [(label, a, a.begins(n), base) for base, group in ((True, self.base), (False, self.more)) for label, a in group]

    def matches(self, words: Words) -> Iterator[tuple[str, bool, int, int]]:
        """(label, whether of the base, first word, words) of every place where a template is accepted."""
        codes, distinct = words.coded()
        symbol = np.fromiter((self.vocabulary.get(w, 0) for w in distinct), dtype=np.int64, count=len(distinct))[codes]
        none = len(self.vocabulary) + 1
        follows = np.concatenate((symbol[1:], [none])) if len(symbol) else symbol
        if len(symbol):
            follows[:-1][words.row[1:] != words.row[:-1]] = none
        known = np.flatnonzero(symbol)
        for label, automaton, begins, base in self.all:
            # a template that begins with a region for any word can start at a word that no template has
            at = np.arange(len(symbol)) if begins[0].any() else known
            for place in at[begins[symbol[at], follows[at]]].tolist():
                end = min(int(words.word_at[words.row[place] + 1]), place + automaton.longest())
                if n := automaton.accepts(symbol[place:end].tolist()):
                    yield label, base, place, n


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            for a, b in chunks(at):
                words = Words(raw[at[a] : at[b]], at[a : b + 1] - at[a], ALNUM)
                n = b - a
                count, first, last = np.zeros(n, dtype=np.int64), [None] * n, [None] * n
                base_labels, labels = [set() for _ in range(n)], [set() for _ in range(n)]
                score = np.zeros(n)
                spans: list[list[dict]] = [[] for _ in range(n)]
                for label, base, place, size in scanner.matches(words):
                    r = int(words.row[place])
                    begin = place - int(words.word_at[r])
                    labels[r].add(label)
                    if base:
                        count[r] += 1
                        first[r] = begin if first[r] is None else min(first[r], begin)
                        last[r] = begin if last[r] is None else max(last[r], begin)
                        base_labels[r].add(label)
                        score[r] = max(score[r], 0.5)
                    else:
                        score[r] = 1.0
                        spans[r].append({"label": label, "first": begin, "words": size})
                joined = [[",".join(sorted(s)) for s in group] for group in (base_labels, labels)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), pa.array(words.per_row), pa.array(count), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(joined[0], pa.string()), pa.array(joined[1], pa.string()), pa.array(score), pa.array(spans, _MATCHES)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    return run


_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for every row of docs.

    n_base: all places of base phrases; labels: distinct, sorted, comma-joined, the base's among them; score: 1
    where a template's mandatory wording is whole, 0.5 for base phrases alone, else 0; matches: the templates' places.
    Null and empty texts have no words and empty labels; texts of any length are scanned whole; an empty table gives no rows. Repeated rows and null ids are scanned row by row; other
    columns are not looked at."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,words:long>>"
    return columns(docs, (id_col, "doc_id"), (text_col, "text")).mapInArrow(_scan(Scanner(tuple(phrases), tuple(templates))), schema)

"""License scans by template-markup matching.

A template is license wording with marked regions: ``[[...]]`` is optional wording,
``<<a|b c>>`` one of several wordings, ``<<lo-hi>>`` that many words of any kind, and all
else is mandatory. Templates are compiled into one token automaton, whose states are made
as texts need them; a place is accepted if its mandatory wording stands there word for word.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z
lower-cased. An exact template reads them as they are. The others see through quotes,
dashes and signs: these are cut from a word's ends, and a word of nothing else is passed over.

Each text is scanned whole and on its own, with no shuffle; long ones in pieces that overlap
by the longest place. Null and empty texts have no words and no places. Repeated rows are
scanned one by one, and other columns pass through untouched under their names. Of the ends that a
template can have from one start the last is taken; places of several templates, and places from several
starts, may overlap, and all are returned, in order of start, template and end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import append_columns, fresh, word_pieces, words

#: Quotes, dashes and signs that are no part of license wording.
MARKS = "“”„‟‘’‚‛«»‹›–—―‐‑•·…©®™§¶"


@dataclass(frozen=True)
class Template:
    """``exact`` templates read words as they are; all others see through :data:`MARKS`."""

    name: str
    label: str
    text: str
    exact: bool = False


#: The phrases that name a license.
PHRASES = (
    Template("phrase-gpl", "gpl", "gnu general public license", True),
    Template("phrase-apache", "apache", "apache license", True),
    Template("phrase-cc-by", "cc-by", "cc by", True),
    Template("phrase-mit", "mit", "mit license", True),
)

_GNU = "[[as published by the free software foundation]] [[either]]"
_AS_IS = 'this software is provided [[by <<0-12>>]] "as is" and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage'
_CLAUSES = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"


def _gnu(name: str, title: str, versions: tuple[str, ...]) -> list[Template]:
    out = []
    for v in versions:
        major, _, minor = v.partition(".")
        number = f"<<version {major}|v{major}|v {major}>> {f'[[{minor}]]' if minor == '0' else minor}"
        out.append(Template(f"{name}-{v}", f"{name}-{v}", f"{title} {_GNU} {number}"))
        out.append(Template(f"{name}-{v}-or-later", f"{name}-{v}-or-later", f"{title} {_GNU} {number} [[of the license]] or [[at your option]] any later version"))
    return out


def _creative_commons() -> list[Template]:
    """Every kind of attribution license in every version, short and in full."""
    part = {"nc": "<<nc|noncommercial|non commercial>>", "sa": "<<sa|sharealike|share alike>>", "nd": "<<nd|noderivatives|noderivs|no derivatives>>"}
    out = []
    for kind in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = "-".join(("cc", "by", *kind, v))
            wording = " ".join(["<<cc|creative commons>>", "<<by|attribution>>", *(part[k] for k in kind), v.replace(".", " ")])
            out.append(Template(name, name, wording))
    return out


#: Wording of licenses and of the notices that apply them.
TEXTS = (
    Template("gpl-notice", "gpl", "<<licensed|distributed|released|published>> under the [[terms of the]] gnu general public license"),
    *_gnu("gpl", "gnu general public license", ("1.0", "2.0", "3.0")),
    *_gnu("lgpl", "gnu <<lesser|library>> general public license", ("2.0", "2.1", "3.0")),
    *_gnu("agpl", "gnu affero general public license", ("3.0",)),
    Template("apache-2.0", "apache-2.0", "apache license [[the license]] version 2 0"),
    Template("apache-2.0-notice", "apache-2.0", 'licensed under the apache license version 2 0 (the "license") you may not use this file except in compliance with the license you may obtain a copy of the license at <<http|https>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "as is" basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license'),
    Template("mit-notice", "mit", "<<released|licensed|distributed|available|published>> under the [[terms of the]] mit license"),
    Template("mit-text", "mit", 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the "software") to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided "as is" without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software'),
    Template("bsd-2-clause", "bsd-2-clause", f"{_CLAUSES} {_AS_IS}"),
    Template("bsd-3-clause", "bsd-3-clause", f"{_CLAUSES} [[3]] neither the name of <<1-16>> nor the names of <<its|his|her|their|the>> contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}"),
    Template("isc-text", "isc", 'permission to use copy modify <<and or|and>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided "as is" and <<1-8>> <<disclaims|disclaim>> all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software'),
    Template("zlib-text", "zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    Template("unlicense-text", "unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("mpl-2.0", "mpl-2.0", "mozilla public license [[<<version|v>>]] 2 0"),
    Template("mpl-2.0-notice", "mpl-2.0", "this source code form is subject to the terms of the mozilla public license [[<<version|v>>]] 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("boost-1.0", "bsl-1.0", "boost software license version 1 0"),
    Template("cc0-1.0", "cc0-1.0", "<<cc0|cc zero|creative commons zero>> [[v1|1]] [[0]] [[universal]] <<license|dedication|public domain dedication|waiver>>"),
    *_creative_commons(),
)
TEMPLATES = (*PHRASES, *TEXTS)


def parse(text: str) -> list[tuple]:
    """The markup as a tree: ("word", w), ("optional", nodes), ("any", lo, hi) and ("choice", [nodes, ...])."""
    stack: list[list] = [[]]
    for m in re.finditer(r"\[\[|\]\]|<<(.*?)>>|(?:(?!\[\[|\]\]|<<).)+", text, re.S):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            inside = stack.pop()
            if not stack:
                raise ValueError(f"a region ends that has not begun: {text[:60]}")
            stack[-1].append(("optional", inside))
        elif m[1] is None:
            stack[-1] += [("word", w) for w in words(m[0].encode())]
        elif size := re.fullmatch(r"(\d+)-(\d+)", m[1]):
            stack[-1].append(("any", int(size[1]), int(size[2])))
        else:
            stack[-1].append(("choice", [[("word", w) for w in words(x.encode())] for x in m[1].split("|")]))
    if len(stack) > 1:
        raise ValueError(f"a region does not end: {text[:60]}")
    return stack[0]


def span(nodes: list[tuple], longest: bool) -> int:
    """The fewest or most words that the nodes take."""
    total = 0
    for kind, *x in nodes:
        if kind == "word":
            total += 1
        elif kind == "any":
            total += x[longest]
        elif kind == "optional":
            total += span(x[0], True) if longest else 0
        else:
            total += (max if longest else min)(span(n, longest) for n in x[0])
    return total


@cache
def mandatory(template: Template) -> int:
    """How many words a place of the template has at least."""
    return span(parse(template.text), False)


class Automaton:
    """All templates of one sort as one automaton over words; sets of states get a number when a text first needs them."""

    #: Numbered sets at most; then numbering starts anew.
    MOST = 50_000

    def __init__(self, templates: tuple[Template, ...]) -> None:
        self.templates = templates
        self.words: list[dict[bytes, list[int]]] = [{}]
        self.any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        self.ends: dict[int, int] = {}
        longest = 0
        for t, template in enumerate(templates):
            nodes = parse(template.text)
            longest = max(longest, span(nodes, True))
            self.ends[self._build(nodes, 0)] = t
        start = self._closure({0})
        self.first = frozenset(w for s in start for w in self.words[s])
        self.vocabulary = frozenset(w for s in self.words for w in s)
        if any(self.any[s] or s in self.ends for s in start):
            raise ValueError("a template must begin with words of its own")
        #: Words from a place's start to its end at most, passed-over ones included.
        self.reach = 2 * longest + 16
        self._reset()

    def _state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.free.append([])
        return len(self.words) - 1

    def _build(self, nodes: list[tuple], at: int) -> int:
        for kind, *x in nodes:
            to = self._state()
            if kind == "word":
                self.words[at].setdefault(x[0], []).append(to)
            elif kind == "any":
                for i in range(x[1] + 1):
                    if i >= x[0]:
                        self.free[at].append(to)
                    if i < x[1]:
                        self.any[at].append(nxt := self._state())
                        at = nxt
            else:
                for way in x[0] if kind == "choice" else [x[0], []]:
                    self.free[self._build(way, at)].append(to)
            at = to
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[bytes, int]] = []
        self.found: list[tuple[int, ...]] = []
        self._number(self._closure({0}))

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.next.append({})
            self.found.append(tuple(sorted(self.ends[s] for s in states if s in self.ends)))
        return self.numbers[states]

    def step(self, at: int, word: bytes) -> int:
        """The set that a word leads to; -1 if none."""
        key = word if word in self.vocabulary else b""
        if (to := self.next[at].get(key)) is None:
            states = self._closure({t for s in self.sets[at] for t in (*self.words[s].get(key, ()), *self.any[s])})
            if len(self.sets) >= self.MOST and states not in self.numbers:
                self._reset()
                return self._number(states) if states else -1
            to = self.next[at][key] = self._number(states) if states else -1
        return to

    def places(self, text: list[bytes], upto: int) -> list[tuple[int, int, int]]:
        """(start, template, end) of all places that start before ``upto``; empty words are passed over."""
        out = []
        first = self.first
        for start in [i for i, w in enumerate(text[:upto]) if w in first]:
            at, ends = 0, {}
            for i in range(start, min(len(text), start + self.reach)):
                if text[i]:
                    at = self.step(at, text[i])
                    if at < 0:
                        break
                    for t in self.found[at]:
                        ends[t] = i + 1
            out += [(start, t, e) for t, e in sorted(ends.items())]
        return out


def plain(word: bytes) -> bytes:
    """The word without marks at its ends."""
    return word if b"\xe2" not in word and b"\xc2" not in word else word.decode("utf-8", "replace").strip(MARKS).encode()


class Scanner:
    """Places of templates in one text after the other."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES) -> None:
        if len({t.name for t in templates}) < len(templates):
            raise ValueError("two templates have the same name")
        self.sorts = [(exact, Automaton(chosen)) for exact in (True, False) if (chosen := tuple(t for t in templates if t.exact == exact))]
        self.overlap = max((a.reach for _, a in self.sorts), default=1)

    def scan(self, text: bytes | None, size: int = 1 << 20) -> tuple[int, list[tuple[int, Template, int]]]:
        """The number of words, and (start, template, end) of all places in order."""
        n, out = 0, []
        marked = text is not None and not text.isascii()
        for number, found, upto in word_pieces(text, self.overlap, size):
            seen = None
            for exact, automaton in self.sorts:
                if not exact and seen is None:
                    seen = [plain(w) for w in found] if marked else found
                out += [(number + s, automaton.templates[t], number + e) for s, t, e in automaton.places(found if exact else seen, upto)]
            n = number + upto
        return n, sorted(out, key=lambda x: (x[0], x[1].name, x[2]))


PLACE = T.StructType([T.StructField("template", T.StringType()), T.StructField("label", T.StringType()), T.StructField("exact", T.BooleanType()), T.StructField("mandatory", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ARROW = pa.struct([("template", pa.string()), ("label", pa.string()), ("exact", pa.bool_()), ("mandatory", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def names(docs: DataFrame) -> tuple[str, str]:
    """The columns that :func:`find_licenses` adds: number of words, places."""
    return fresh(docs, "license_words"), fresh(docs, "license_places")


def find_licenses(docs: DataFrame, *, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """All columns of ``docs`` and the two of :func:`names`; a place has words numbered from 0, end exclusive."""
    Scanner(templates)  # an error in a template shows here and not in a task

    def make():
        scanner = Scanner(templates)

        def work(values):
            each = [scanner.scan(v) for v in values]
            places = [[{"template": t.name, "label": t.label, "exact": t.exact, "mandatory": mandatory(t), "start": s, "end": e} for s, t, e in found] for _, found in each]
            return [pa.array([n for n, _ in each], pa.int64()), pa.array(places, pa.list_(_ARROW))]

        return work

    n_words, places = names(docs)
    return append_columns(docs, text, make, [T.StructField(n_words, T.LongType()), T.StructField(places, T.ArrayType(PLACE))])


def confidence(places: Column) -> Column:
    """m / (m + 4) of the accepted template with most mandatory words m; 0 without a place."""
    most = F.coalesce(F.array_max(F.transform(places, lambda p: p["mandatory"])), F.lit(0)).cast("double")
    return most / (most + 4)


def labels(places: Column) -> Column:
    """The distinct labels of places, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its number of words, the exact phrases and where they start, the labels, and the confidence."""
    kept = docs.select("doc_id", "text")
    n_words, places = names(kept)
    exact = F.filter(places, lambda p: p["exact"])
    starts = F.transform(exact, lambda p: p["start"])
    return find_licenses(kept).select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col(places)).alias("labels"),
        confidence(F.col(places)).alias("score"),
    )


def expression(nodes: list[tuple]) -> str:
    """The nodes as a regular expression over words that each follow a blank."""
    out = ""
    for kind, *x in nodes:
        if kind == "word":
            out += " " + x[0].decode()
        elif kind == "any":
            out += f"(?: [^ ]+){{{x[0]},{x[1]}}}"
        elif kind == "optional":
            out += f"(?:{expression(x[0])})?"
        else:
            out += f"(?:{'|'.join(expression(n) for n in x[0])})"
    return out


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """:func:`scan_documents` in SQL: phrases by comparing slices, templates as regular expressions."""
    seen = {t.name: f"regexp_matches(plain, '{expression(parse(t.text))} ')" for t in templates if not t.exact}
    phrases = [t for t in templates if t.exact]
    listed = [[w.decode() for _, w in parse(t.text)] for t in phrases]
    at = ", ".join(f"list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(v, 1))})" for v in listed)
    seen |= {t.name: f"len(hits[{i}]) > 0" for i, t in enumerate(phrases, 1)}
    every = ", ".join(f"{{'label': '{t.label}', 'm': {mandatory(t)}, 'exact': {t.exact}, 'seen': {seen[t.name]}}}" for t in templates)
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_transform({x}, lambda x: x.label))), ',')"
    return f"""
WITH found AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
placed AS (SELECT *, [{at}] AS hits, ' ' || array_to_string(list_filter(list_transform(w, lambda x: trim(x, '{MARKS}')), lambda x: x <> ''), ' ') || ' ' AS plain FROM found),
marked AS (SELECT *, flatten(hits) AS starts, list_filter([{every}], lambda x: x.seen) AS held FROM placed)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
  {joined("list_filter(held, lambda x: x.exact)")} AS base_labels, {joined("held")} AS labels,
  coalesce(list_max(list_transform(held, lambda x: x.m)), 0) / CAST(coalesce(list_max(list_transform(held, lambda x: x.m)), 0) + 4 AS DOUBLE) AS score
FROM marked"""

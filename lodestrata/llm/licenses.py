"""Licence scans by template-markup matching.

A template is licence wording with markup in the style of licence-list templates:
``<<beginOptional>> ... <<endOptional>>`` encloses wording that may be absent, and
``<<var;n>>`` stands for any n words at most (names, years, numbers of clauses). Wording and texts are compared as
words, so case, marks and line breaks don't count; all mandatory wording has to match exactly,
in order and without anything between. A template compiles to a token automaton: states are
places in the wording, words are the moves, optional parts and the ends of replaceable ones are
moves without a word. Automata run from places where one of their first words stands, over
texts that contain all the words which they can't do without.

Base phrases are templates without markup, whose places are all counted.

Cases: null and empty texts have no words, labels or places, and score 0; repeated rows each
get a row; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: How sure a kind of wording makes of a licence: a whole licence text, its standard notice, a
#: sentence that names it, and base phrases or claims alone.
SCORES = {"text": 1.0, "notice": 0.9, "mention": 0.75, "base": 0.6, "claim": 0.5}

_GPL = """<<beginOptional>>this program is free software you can<<endOptional>> redistribute it and or modify it under the terms of the
    gnu <<var;1>> general public license <<beginOptional>>as published by the free software foundation<<endOptional>>"""
_OPEN_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
    files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
    distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
    following conditions"""
_OPEN_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met"""
_OPEN_ISC = """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without
    fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"""

#: label -> (kind, template) of its wording. The wording of licences.
TEMPLATES = {
    "mit": [
        ("text", _OPEN_MIT + """ the above copyright notice and this permission notice <<beginOptional>>including the next paragraph
            <<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without
            warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
            purpose and noninfringement in no event shall <<var;10>> be liable for any claim damages or other liability whether in an action
            of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
        ("notice", _OPEN_MIT),
        ("mention", "<<beginOptional>>this <<var;1>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> mit license"),
        ("mention", "released under the <<beginOptional>>terms of the<<endOptional>> mit license"),
        ("notice", "spdx license identifier mit"),
    ],
    "apache-2": [
        ("text", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
            you may obtain a copy of the license at <<var;8>> unless required by applicable law or agreed to in writing software distributed
            under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the
            license for the specific language governing permissions and limitations under the license"""),
        ("mention", "licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>>"),
        ("notice", "spdx license identifier apache 2 0"),
        ("mention", "released under the apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ],
    "cc-by-nc": [
        ("mention", "<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> <<var;2>>"),
        ("notice", "creative commons attribution noncommercial <<beginOptional>>sharealike<<endOptional>> <<beginOptional>>noderivatives<<endOptional>> <<var;2>> <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license"),
        ("mention", "creative commons attribution non commercial"),
        ("mention", "creative commons attribution noncommercial"),
    ],
    "cc-by-sa": [
        ("notice", "creative commons attribution share alike <<var;2>> <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license"),
        ("notice", "creative commons attribution sharealike <<var;2>> <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license"),
        ("mention", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by sa <<var;2>>"),
    ],
    "cc-by": [
        ("notice", "creative commons attribution <<beginOptional>>4 0<<endOptional>> <<beginOptional>>3 0<<endOptional>> <<beginOptional>>2 <<var;1>><<endOptional>> <<beginOptional>>international<<endOptional>> <<beginOptional>>unported<<endOptional>> <<beginOptional>>generic<<endOptional>> <<beginOptional>>public<<endOptional>> license"),
    ],
    "gpl-2": [
        ("notice", _GPL + " <<beginOptional>>either<<endOptional>> version 2"),
        ("mention", "the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"),
        ("notice", "spdx license identifier gpl 2 0 <<beginOptional>>or later<<endOptional>> <<beginOptional>>only<<endOptional>>"),
    ],
    "gpl-3": [
        ("notice", _GPL + " <<beginOptional>>either<<endOptional>> version 3"),
        ("mention", "the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
        ("notice", "spdx license identifier gpl 3 0 <<beginOptional>>or later<<endOptional>> <<beginOptional>>only<<endOptional>>"),
    ],
    "bsd": [
        ("text", _OPEN_BSD + """ <<var;1>> redistributions of source code must retain the above copyright notice this list of conditions and the
            following disclaimer <<var;1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and
            the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>><<var;1>>
            neither the name of <<var;10>> nor the names of <<var;2>> contributors may be used to endorse or promote products derived from this
            software without specific prior written permission <<endOptional>> this software is provided by <<var;10>> as is and any express or
            implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
            disclaimed in no event shall <<var;10>> be liable for any direct indirect incidental special exemplary or consequential damages
            including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
            however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
            arising in any way out of the use of this software even if advised of the possibility of such damage"""),
        ("notice", _OPEN_BSD),
        ("mention", "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>2 clause<<endOptional>> <<beginOptional>>3 clause<<endOptional>> bsd license"),
        ("notice", "spdx license identifier bsd <<var;1>> clause"),
    ],
    "isc": [
        ("text", _OPEN_ISC + """ the software is provided as is and <<var;6>> disclaims all warranties with regard to this software including all
            implied warranties of merchantability and fitness in no event shall <<var;6>> be liable for any special direct indirect or
            consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
            negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
        ("notice", _OPEN_ISC),
    ],
    "zlib": [
        ("text", """this software is provided as is without any express or implied warranty in no event will <<var;6>> be held liable for any
            damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
            commercial applications and to alter it and redistribute it freely subject to the following restrictions <<var;1>> the origin of
            this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a
            product an acknowledgment in the product documentation would be appreciated but is not required <<var;1>> altered source versions
            must be plainly marked as such and must not be misrepresented as being the original software <<var;1>> this notice may not be
            removed or altered from any source distribution"""),
    ],
    "mpl-2": [
        ("text", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
            with this file you can obtain one at <<var;6>>"""),
        ("mention", "subject to the terms of the mozilla public license v 2 0"),
        ("notice", "spdx license identifier mpl 2 0"),
    ],
    "all-rights-reserved": [("claim", "<<beginOptional>>copyright <<var;6>><<endOptional>> all rights reserved")],
    "public-domain": [
        ("text", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell
            or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by
            any means"""),
        ("mention", "released into the public domain"),
        ("mention", "dedicated to the public domain"),
        ("notice", "spdx license identifier cc0 1 0"),
    ],
}

#: Word bytes of UTF-8 stay (A-Z in lower case), others become spaces. Words are made of
#: digits, letters a-z and everything beyond ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


MARKUP = re.compile(r"<<\s*(beginOptional|endOptional|var;\s*\d+)\s*>>|[^\s<>]+")


class Automaton:
    """Token automaton of a template."""

    def __init__(self, template: str):
        #: state -> {word: next states}; None: any word
        self.moves: list[dict[bytes | None, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.needed: set[bytes] = set()
        starts, at, depth = [], 0, 0
        for m in MARKUP.finditer(template):
            mark = m[1]
            if mark == "beginOptional":
                starts.append(at)
                depth += 1
            elif mark == "endOptional":
                self.free[starts.pop()].add(at)
                depth -= 1
            elif mark:
                ends, here = [at], at
                for _ in range(int(mark.split(";")[1])):
                    here = self._after(here, None)
                    ends.append(here)
                for e in ends[:-1]:
                    self.free[e].add(here)
                at = here
            else:
                for w in words(m[0]):
                    at = self._after(at, w)
                    if not depth:
                        self.needed.add(w)
        if starts or not self.needed:
            raise ValueError(f"unbalanced or empty template: {template}")
        self.end = at
        self.start = self._closure({0})
        self.first = {w for s in self.start for w in self.moves[s]}

    def _after(self, state: int, word: bytes | None) -> int:
        self.moves.append({})
        self.free.append(set())
        self.moves[state].setdefault(word, set()).add(len(self.moves) - 1)
        return len(self.moves) - 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return frozenset(out)

    def match(self, text: list[bytes], at: int) -> int | None:
        """The end of the longest match that begins at a word, or None."""
        states, found, i = self.start, None, at
        while states:
            if self.end in states:
                found = i
            if i == len(text):
                break
            w, after = text[i], set()
            for s in states:
                after |= self.moves[s].get(w, set()) | self.moves[s].get(None, set())
            states, i = self._closure(after), i + 1
        return found


def pattern(template: str) -> str:
    """A template as a regular expression over words with a space behind each."""
    part = lambda m: {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or (f"(?:[^ ]+ ){{0,{m[1].split(';')[1].strip()}}}" if m[1] else "".join(f"{w.decode()} " for w in words(m[0])))
    return "".join(map(part, MARKUP.finditer(template)))


class Scanner:
    """Base phrases and templates, compiled."""

    def __init__(self, templates: dict[str, list[tuple[str, str]]] | None = None):
        self.base = [(label, [w.encode() for w in phrase.split()]) for phrase, label in BASE_PHRASES.items()]
        self.automata = [(label, SCORES[kind], Automaton(t)) for label, ts in (templates or TEMPLATES).items() for kind, t in ts]

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], dict[str, tuple[int, int]], float]:
        """(number of words, base places as (first word, label), template spans by label, score)."""
        clean = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)
        all_words = clean.split()
        spaced, where = None, {}

        def places(word: bytes) -> list[int]:
            if word not in where:
                where[word] = [i for i, w in enumerate(all_words) if w == word]
            return where[word]

        found, spans = [], {}
        for label, phrase in self.base:
            # the phrase's words may have several spaces between them, so its words come first
            if all(w in clean for w in phrase):
                found += [(i, label) for i in places(phrase[0]) if all_words[i : i + len(phrase)] == phrase]
        score = SCORES["base"] if found else 0.0
        for label, sure, a in self.automata:
            if not all(w in clean for w in a.needed):
                continue
            if spaced is None:
                spaced = set(all_words)
            if not a.needed <= spaced:
                continue
            starts = range(len(all_words)) if None in a.first else sorted({i for w in a.first for i in places(w)})
            for i in starts:
                if (end := a.match(all_words, i)) is None:
                    continue
                score = max(score, sure)
                if end - i > spans.get(label, (0, 0))[1] - spans.get(label, (0, 0))[0]:
                    spans[label] = (i, end)
        return len(all_words), found, spans, score


def scan_documents(docs: DataFrame, templates: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (the
    longest match of each label's templates). score: the best of SCORES by what was found, or 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64())])
        for b in batches:
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for lo in range(0, b.num_rows, 500):
                for text in b.column(1).slice(lo, 500).to_pylist():
                    n, base, spans, score = scanner.scan(text)
                    at, of_base = [i for i, _ in base], {x for _, x in base}
                    row = (n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(of_base)), ",".join(sorted(of_base | spans.keys())), score, [{"label": k, "first": s, "after": e} for k, (s, e) in sorted(spans.items())])
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], ["doc_id", *out])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, after: long>>"
    return documents(docs).mapInArrow(run, schema)


def oracle_sql() -> str:
    """DuckDB SQL for the same rows: templates as regular expressions over the words."""
    places, base, found, score = [], [], [], []
    for phrase, label in BASE_PHRASES.items():
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    for label, ts in TEMPLATES.items():
        for kind, t in ts:
            one = f"regexp_matches(t, ' {pattern(t)}')"
            found.append(f"CASE WHEN {one} THEN '{label}' END")
            score.append(f"CASE WHEN {one} THEN {SCORES[kind]} ELSE 0 END")
    joined = lambda x: f"array_to_string(list_sort(list_distinct({x})), ',')"
    return f"""
        WITH d AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
          FROM documents),
        p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {' || '.join(places)} AS b FROM d),
        f AS (SELECT *, list_transform(b, lambda x: x.label) AS bl, list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS tl FROM p)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(list_transform(b, lambda x: x.at))::BIGINT AS first_word,
               list_max(list_transform(b, lambda x: x.at))::BIGINT AS last_word, {joined('bl')} AS base_labels, {joined('bl || tl')} AS labels,
               greatest(CASE WHEN len(b) > 0 THEN {SCORES['base']} ELSE 0 END, {', '.join(score)})::DOUBLE AS score
        FROM f"""

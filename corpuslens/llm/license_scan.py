"""Licence texts by templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.text import chunks

# Phrases that count as base labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Templates: words outside marks are mandatory, [[...]] may be left out, and
# {{n}} stands for one to n words of any kind, also inside [[...]].

# Wording of licences.
_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] "
    "to deal in the software without restriction"
)
_RIGHTS = (
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so"
)
_NOTICE = (
    "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in "
    "all copies or substantial portions of the software"
)
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability whether in an "
    "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_NO_ADVERTISING = (
    "except as contained in this notice the name of {{12}} shall not be used in advertising or otherwise to promote the sale use or other dealings in "
    "this software without prior written authorization from {{12}}"
)
_USE = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
_IN_COPIES = "provided that the above copyright notice and this permission notice appear in all copies"
_DISCLAIMED = (
    "the software is provided as is and {{12}} all warranties with regard to this software including all implied warranties of merchantability and "
    "fitness in no event shall {{12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
    "of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
    "performance of this software"
)
_FORMS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_SOURCE_AND_BINARY = (
    "[[{{1}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[{{1}}]] "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)
_ACKNOWLEDGED = (
    "[[{{1}}]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes "
    "software developed by {{20}}"
)
_NAMES = (
    "[[{{1}}]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission"
)
_DAMAGES = (
    "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will {{12}} be held liable for any damages arising from the "
    "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
    "redistribute it freely subject to the following restrictions [[{{1}}]] the origin of this software must not be misrepresented you must not claim "
    "that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated "
    "but is not required [[{{1}}]] altered source versions must be plainly marked as such and must not be misrepresented as being the original "
    "software [[{{1}}]] this notice may not be removed or altered from any source distribution"
)
_APACHE = (
    "licensed under the apache license version 2 0 [[the license]] you may not use {{3}} except in compliance with the license you may obtain a copy of "
    "the license at {{1}} www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
    "language governing permissions and limitations under the license"
)
_MPL = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
    "obtain one at {{1}} mozilla org mpl 2 0"
)
_GNU = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation "
    "[[either]] version {version} of the license [[or at your option any later version]] {{{{3}}}} is distributed in the hope that it will be useful but "
    "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details"
)
_GNU_LICENSES = (
    ("gpl-2.0", "general public license", "2", "june 1991"),
    ("gpl-3.0", "general public license", "3", "29 june 2007"),
    ("lgpl-2.1", "lesser general public license", "2 1", "february 1999"),
    ("lgpl-3.0", "lesser general public license", "3", "29 june 2007"),
    ("agpl-3.0", "affero general public license", "3", "19 november 2007"),
)
TEMPLATES = (
    ("mit-notice", "released under the [[terms of the]] mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-3.0-notice", "[[this work is]] licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3"),
    ("cc-by-nc-4.0-notice", "licensed under [[the]] [[creative commons]] cc by nc 4 0"),
    ("spdx-identifier", "spdx license identifier {{2}}"),
    ("all-rights", "copyright [[c]] {{8}} all rights reserved"),
    ("mit-opening", _GRANT),
    ("mit-text", f"{_GRANT} {_RIGHTS} {_NOTICE} {_AS_IS}"),
    ("mit-0-text", f"{_GRANT} {_RIGHTS} {_AS_IS}"),
    ("x11-text", f"{_GRANT} {_RIGHTS} {_NOTICE} {_AS_IS} {_NO_ADVERTISING}"),
    ("isc-text", f"{_USE} {_IN_COPIES} {_DISCLAIMED}"),
    ("0bsd-text", f"{_USE} {_DISCLAIMED}"),
    ("bsd-opening", _FORMS),
    ("bsd-2-text", f"{_FORMS} {_SOURCE_AND_BINARY} {_DAMAGES}"),
    ("bsd-3-text", f"{_FORMS} {_SOURCE_AND_BINARY} {_NAMES} {_DAMAGES}"),
    ("bsd-4-text", f"{_FORMS} {_SOURCE_AND_BINARY} {_ACKNOWLEDGED} {_NAMES} {_DAMAGES}"),
    ("zlib-text", _ZLIB),
    ("apache-2.0-text-notice", _APACHE),
    ("apache-2.0-heading", "apache license version 2 0 january 2004 [[{{1}} www apache org licenses]] terms and conditions for use reproduction and distribution"),
    ("mpl-2.0-text-notice", _MPL),
    *((f"{label}-text-notice", _GNU.format(name=name, version=version)) for label, name, version, _ in _GNU_LICENSES),
    *((f"{label}-heading", f"gnu {name} version {version} {date}") for label, name, version, date in _GNU_LICENSES),
)
# End of fixed values.

STATES = 20_000  # remembered sets of places; beyond, the memory starts anew
_QUOTES = re.compile("[\u2018\u2019\u201c\u201d]")

_LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are runs of ASCII letters, digits and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_WORDS).split()


@dataclass
class TokenAutomaton:
    """A non-deterministic automaton over words.

    ``edges[s]`` has (word, next state), with None for any word; ``skips[s]``
    are states reached without a word.  State ``len(edges) - 1`` accepts.
    """

    label: str
    edges: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    mandatory: list[bytes] = field(default_factory=list)

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match_at(self, words: Sequence[bytes], at: int) -> int | None:
        """The end of the shortest match that starts at word ``at``."""
        states, accept = self.closed({0}), len(self.edges) - 1
        while accept not in states:
            if at >= len(words) or not states:
                return None
            word = words[at]
            states = self.closed({t for s in states for w, t in self.edges[s] if w is None or w == word})
            at += 1
        return at

    def first_words(self) -> set[bytes | None]:
        return {w for s in self.closed({0}) for w, _ in self.edges[s]}


def compile_template(label: str, template: str) -> TokenAutomaton:
    """One state per place in the template; marks may not be nested."""
    out = TokenAutomaton(label, [[]], [[]])

    def add(word: bytes | None) -> None:
        out.edges.append([])
        out.skips.append([])
        out.edges[-2].append((word, len(out.edges) - 1))

    def skip(begin: int) -> None:
        out.skips[begin].append(len(out.edges) - 1)

    begin = None  # of the optional region
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}\s]+", template):
        if part == "[[":
            begin = len(out.edges) - 1
        elif part == "]]":
            skip(begin)
            begin = None
        elif part.startswith("{{"):
            places = []
            for _ in range(int(part[2:-2])):
                add(None)
                places.append(len(out.edges) - 1)
            for p in places[:-1]:
                skip(p)
        else:
            add(part.encode())
            if begin is None:
                out.mandatory.append(part.encode())
    if not out.mandatory:
        raise ValueError(f"{label}: a template needs mandatory words")
    return out


class CombinedAutomaton:
    """All templates at once: the sets of places they can be in are numbered as texts call for them.

    A word that no template names is one symbol, and every set holds the first
    places, so that a match may start at any word.
    """

    def __init__(self, automata: Sequence[TokenAutomaton]):
        self.automata = automata
        self.symbols = {w: i for i, w in enumerate(sorted({w for a in automata for row in a.edges for w, _ in row if w is not None}), 1)}
        self.words = [None, *self.symbols]
        self.start = frozenset((k, s) for k, a in enumerate(automata) for s in a.closed({0}))
        self.forget()

    def forget(self) -> None:
        self.number, self.sets, self.next, self.accepted = {}, [], [], []
        self.numbered(self.start)

    def numbered(self, places: frozenset) -> int:
        if places not in self.number:
            self.number[places] = len(self.sets)
            self.sets.append(places)
            self.next.append({})
            self.accepted.append(tuple(sorted({k for k, s in places if s == len(self.automata[k].edges) - 1})))
        return self.number[places]

    def grow(self, state: int, symbol: int) -> int:
        """The set after ``symbol``, remembered."""
        if len(self.sets) > STATES:
            places = self.sets[state]
            self.forget()
            state = self.numbered(places)
        word, reached = self.words[symbol], set(self.start)
        for k, s in self.sets[state]:
            a = self.automata[k]
            reached.update((k, t) for t in a.closed({t for w, t in a.edges[s] if w is None or w == word}))
        after = self.numbered(frozenset(reached))
        self.next[state][symbol] = after
        return after

    def found(self, words: Sequence[bytes]) -> set[int]:
        """The templates that match anywhere."""
        symbol, state, out = self.symbols.get, 0, set()
        for w in words:
            s = symbol(w, 0)
            after = self.next[state].get(s)
            state = self.grow(state, s) if after is None else after
            if self.accepted[state]:
                out.update(self.accepted[state])
        return out


class LicenseScanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        self.automata = [compile_template(*t) for t in templates]
        self.mandatory = [frozenset(a.mandatory) for a in self.automata]
        self.combined = CombinedAutomaton(self.automata)
        self.phrases = [(p.encode().split(), label) for p, label in phrases]

    def spans(self, words: Sequence[bytes]) -> list[tuple[int, int, str]]:
        """(begin, end, label) of the matches of each template, less those inside a longer match of another."""
        present, out = set(words), []
        # A text without all mandatory words of any template can't be accepted.
        if not any(present.issuperset(m) for m in self.mandatory):
            return out
        for k in self.combined.found(words):
            automaton, at = self.automata[k], 0
            first = automaton.first_words()
            while at < len(words):
                end = automaton.match_at(words, at) if None in first or words[at] in first else None
                if end is not None:
                    out.append((at, end, automaton.label))
                at = at + 1 if end is None else end
        # In order of begin, longest first, a match lies in an earlier one if that ends no sooner.
        kept, reach = [], (-1, -1)
        for begin, end, label in sorted(out, key=lambda m: (m[0], -m[1], m[2])):
            if end > reach[1] or (begin, end) == reach:
                kept.append((begin, end, label))
                reach = (begin, end)
        return kept

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)"""
        words = words_of(text)
        present, covered = set(words), bytearray(len(words))
        base, starts = set(), []
        for phrase, label in self.phrases:
            if present.issuperset(phrase):
                for i, w in enumerate(words[: len(words) - len(phrase) + 1]):
                    if w == phrase[0] and words[i : i + len(phrase)] == phrase:
                        starts.append(i)
                        base.add(label)
                        covered[i : i + len(phrase)] = b"\1" * len(phrase)
        plain, place = words, None
        if text and _QUOTES.search(text):
            # Typographic quotes stand in words by the rule above; templates read the words without them.
            bare = [_QUOTES.sub("", w.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass") for w in words]
            place = [i for i, w in enumerate(bare) if w]
            plain = [bare[i] for i in place]
        labels = set(base)
        for begin, end, label in self.spans(plain):
            labels.add(label)
            a, b = (begin, end) if place is None else (place[begin], place[end - 1] + 1)
            covered[a:b] = b"\1" * (b - a)
        score = sum(covered) / len(words) if words else 0.0
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score,
        )


_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per document.

    ``n_base`` counts all places of base phrases, ``first_word`` and
    ``last_word`` are the first and last of them, counted in words from 0.
    ``labels`` also has the templates that the combined automaton finds anywhere
    in the text: its mandatory words one after another, optional regions taken
    or not, replaceable regions filled by their number of words at most.  A
    match inside a longer one of another template gives no label; of equal
    matches all do.  ``-text`` labels stand for a whole licence, ``-opening`` for
    its first clause alone, ``-notice`` and ``-heading`` for what names a licence.
    ``score`` is the share of the words in matches and base phrases.  Null and empty
    texts have no words, no labels (empty strings) and score 0; repeated rows
    have a row each; other columns aren't read; an empty table gives no rows.
    """
    templates = list(templates)

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = LicenseScanner(templates)
        for frame in chunks(frames):
            rows = pd.DataFrame([scanner.scan(t) for t in frame["text"]], columns=_COLUMNS)
            for c in ("first_word", "last_word"):
                rows[c] = rows[c].astype("Int64")
            yield rows.assign(doc_id=frame["doc_id"].to_numpy())

    kinds = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, doc_id bigint"
    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(scanned, kinds)
    return out.select("doc_id", *_COLUMNS)

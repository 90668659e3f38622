"""License scans by matching marked-up templates.

A template is wording with regions marked up: ``<<optional>> ... <</optional>>``
may be absent, ``<<words:A-B>>`` stands for any A to B words, and
``<<any:x|y z>>`` for one of several phrases. Templates are compiled into one
automaton over words, which is made deterministic as far as texts need it. A
text is accepted at a place if all mandatory wording follows there exactly,
word for word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm._common import map_columns

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
#: Words of a lower-cased text as UTF-8: runs of digits, a-z and all that isn't ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, np.int8)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_MARKUP = re.compile(r"<<(optional|/optional|words:\d+-\d+|any:[^<>]+)>>")


@dataclass(frozen=True)
class Template:
    label: str
    wording: str
    base: bool = False


#: Base phrases: license names that count at every place where their words stand one after another.
BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

#: Notices and texts of widespread licenses.
NOTICES = (
    Template("mit-notice", "<<any:released|licensed|distributed|available|provided|published>> under <<optional>>the terms of<</optional>> the mit license"),
    Template("apache-2.0", "licensed under the apache license <<optional>>version<</optional>> 2.0"),
    Template("gpl-2.0", "<<any:licensed|released|distributed|covered>> under <<optional>>the terms of<</optional>> the gnu general public license <<any:version 2|v2|2.0|version 2.0>>"),
    Template("gpl-3.0", "<<any:licensed|released|distributed|covered>> under <<optional>>the terms of<</optional>> the gnu general public license <<any:version 3|v3|3.0|version 3.0>>"),
    Template("gpl-or-later", "gnu general public license as published by the free software foundation either version <<words:1-1>> of the license or <<optional>>at your option<</optional>> any later version"),
    Template("lgpl", "gnu <<any:lesser|library>> general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("cc-by", "<<any:licensed|released|published|available>> under <<optional>>a<</optional>> <<any:cc by|creative commons attribution>> <<optional>>international license<</optional>> 4.0"),
    Template("cc-by-sa", "<<any:licensed|released|published|available>> under <<optional>>a<</optional>> <<any:cc by sa|creative commons attribution sharealike|creative commons attribution share alike>> 4.0"),
    Template("cc-by-nc", "<<any:licensed|released|published|available>> under <<optional>>a<</optional>> <<any:cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial>> 4.0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license <<optional>>v. 2.0 <</optional>>"),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files <<optional>>the software<</optional>> to deal in the software without restriction including"
        " without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the"
        " software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>>"
        " shall be included in all copies or substantial portions of the software",
    ),
    Template(
        "isc-text",
        "permission to use copy modify and <<any:distribute|or distribute>> this software for any purpose with or without"
        " fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "bsd-text",
        "redistribution and use <<optional>>of this software<</optional>> in source and binary forms with or without"
        " modification are permitted provided that the following conditions are met <<words:0-1>> redistributions of"
        " source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    Template(
        "apache-2.0-header",
        "<<optional>>copyright <<words:1-8>><</optional>> licensed under the apache license version 2.0 <<optional>>the license<</optional>> you may not use"
        " this file except in compliance with the license you may obtain a copy of the license at",
    ),
)
TEMPLATES = BASE + NOTICES


def words_of(wording: str) -> list[bytes]:
    return _WORD.findall(wording.encode().translate(_LOWER))


class Automaton:
    """The templates as one automaton. A state of the lazy deterministic form is a set of places in templates."""

    ANY = None

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self._step: list[list[tuple[bytes | None, int]]] = []
        self._skip: list[list[int]] = []
        self._accepts: dict[int, int] = {}
        self.mandatory: list[int] = []
        starts, needs = [], []
        for number, template in enumerate(templates):
            first = self._state()
            end, mandatory, groups = self._compile(template.wording, first)
            if self._reach({first}) & {end}:
                raise ValueError(f"{template.label}: a template needs mandatory words")
            self._accepts[end] = number
            self.mandatory.append(len(mandatory))
            needs.append(groups)
            starts.append(first)
        self._ids: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._moves: list[dict[bytes, int]] = []
        self._known: list[frozenset[bytes]] = []
        self.accepting: list[tuple[int, ...]] = []
        self.start = self._deterministic(self._reach(set(starts)))
        #: Words that begin a match; ANY if any word may.
        self.firsts = {w for s in self._sets[self.start] for w, _ in self._step[s]}
        #: A text without any of these has no match; None if a template can match without words of its own. Of each template,
        #: its longest mandatory word, or a word of each of some alternatives.
        self.keys = None if not all(needs) else tuple({w for groups in needs for w in max(groups, key=lambda g: min(map(len, g)))})

    def _state(self) -> int:
        self._step.append([])
        self._skip.append([])
        return len(self._step) - 1

    def _chain(self, at: int, words: list[bytes | None]) -> int:
        for word in words:
            new = self._state()
            self._step[at].append((word, new))
            at = new
        return at

    def _compile(self, wording: str, at: int) -> tuple[int, list[bytes], list[frozenset[bytes]]]:
        """The end, the mandatory words, and groups of words of which a match has one each."""
        mandatory: list[bytes] = []
        groups: list[frozenset[bytes]] = []
        open_at: list[int] = []
        for i, part in enumerate(_MARKUP.split(wording)):
            if i % 2 == 0:
                words = words_of(part)
                at = self._chain(at, words)
                if not open_at:
                    mandatory += words
            elif part == "optional":
                open_at.append(at)
                new = self._state()
                self._skip[at].append(new)
                at = new
            elif part == "/optional":
                new = self._state()
                self._skip[at].append(new)
                self._skip[open_at.pop()].append(new)
                at = new
            elif part.startswith("words:"):
                low, high = map(int, part[6:].split("-"))
                at = self._chain(at, [self.ANY] * low)
                end = self._state()
                for _ in range(high - low):
                    self._skip[at].append(end)
                    at = self._chain(at, [self.ANY])
                self._skip[at].append(end)
                at = end
            else:
                end = self._state()
                phrases = [words_of(phrase) for phrase in part[4:].split("|")]
                for words in phrases:
                    self._skip[self._chain(at, words)].append(end)
                if not open_at and all(phrases):
                    groups.append(frozenset(max(words, key=len) for words in phrases))
                at = end
        if open_at:
            raise ValueError("an optional region isn't closed")
        return at, mandatory, [*groups, *(frozenset([w]) for w in mandatory)]

    def _reach(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self._skip[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def _deterministic(self, states: frozenset[int]) -> int:
        if states not in self._ids:
            self._ids[states] = len(self._sets)
            self._sets.append(states)
            self._moves.append({})
            self._known.append(frozenset(w for s in states for w, _ in self._step[s] if w is not self.ANY))
            self.accepting.append(tuple(sorted(self._accepts[s] for s in states if s in self._accepts)))
        return self._ids[states]

    def move(self, state: int, word: bytes) -> int:
        """The state after ``word``; -1 if none. Words that no template has here are one case, so the table stays bounded."""
        word = word if word in self._known[state] else b""
        new = self._moves[state].get(word)
        if new is None:
            to = {n for s in self._sets[state] for w, n in self._step[s] if w is self.ANY or w == word and word}
            new = self._moves[state][word] = self._deterministic(self._reach(to)) if to else -1
        return new

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) for every place and template that accepts there, the longest of each.

        Of matches of a template that end together, as a replaceable or optional beginning gives them, only the longest counts.
        """
        out, seen = [], set()
        anywhere = self.ANY in self.firsts
        for start, word in enumerate(words):
            if not anywhere and word not in self.firsts:
                continue
            state, at, found = self.start, start, {}
            while at < len(words) and (state := self.move(state, words[at])) >= 0:
                at += 1
                for t in self.accepting[state]:
                    found[t] = at
            out += ((t, start, end) for t, end in sorted(found.items()) if (t, end) not in seen)
            seen.update(found.items())
        return out


def count_words(lowered: bytes) -> int:
    inside = _IN_WORD[np.frombuffer(lowered, np.uint8)]
    return int(np.count_nonzero(np.diff(inside, prepend=0) == 1))


SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("stop", T.LongType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("mandatory", T.LongType()),
    ]
)
OUTPUTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("license_spans", T.ArrayType(SPAN))])


def scan_licenses(docs: DataFrame, *, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs``, with the text replaced by its number of words and the spans that templates accept.

    Spans have the label, the words from ``start`` to before ``stop`` (from 0),
    whether the template is a base phrase, and its number of mandatory words.
    Null and empty texts have no words and no spans. Input columns named
    n_words or license_spans are replaced.
    """

    def make():
        automaton = Automaton(templates)

        def scan(value: str | None) -> tuple[int, list[dict]]:
            lowered = value.encode().translate(_LOWER) if value else b""
            if automaton.keys is not None and not any(key in lowered for key in automaton.keys):
                return count_words(lowered), []
            words = _WORD.findall(lowered)
            spans = [
                {
                    "label": templates[t].label,
                    "start": start,
                    "stop": stop,
                    "base": templates[t].base,
                    "mandatory": automaton.mandatory[t],
                }
                for t, start, stop in automaton.matches(words)
            ]
            return len(words), spans

        def apply(columns: list[pa.Array]) -> list[pa.Array]:
            found = [scan(t) for t in columns[0].to_pylist()]
            kind = pa.list_(
                pa.struct(
                    [("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("mandatory", pa.int64())]
                )
            )
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], kind)]

        return apply

    return map_columns(docs, [text], OUTPUTS, make, drop=(text,))

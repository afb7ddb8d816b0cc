"""License scan by template markup compiled to token automata.

A template is wording with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>``
for text that may be missing and ``<<var;name=x;most=n>>`` for a replaceable region of
one to ``n`` words. Each template becomes a nondeterministic automaton over words; it
accepts a run of words when all mandatory wording stands there exactly.

A document's words are found for a whole batch at once; an automaton is started only
at words with which some template can begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sonagrid.llm import spans

#: The phrases asked for and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: A version of a Creative Commons licence and what may follow it.
_VERSION = " ".join(f"<<beginOptional>>{x}<<endOptional>>" for x in ("1", "2", "3", "4", "0", "5", "international", "unported", "generic", "united states", "public"))
#: The parts of these licences as they are spelt.
_PARTS = {"by": ("attribution",), "nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "no derivatives", "noderivs"), "sa": ("sharealike", "share alike")}


def _commons(*parts: str) -> tuple[str, ...]:
    """The full name of a Creative Commons licence in all spellings, and its short name. A
    short name that begins another one has to stand before a version."""
    short = f"cc {' '.join(parts)}"
    ends = [""] if parts[-1] in ("nd", "sa") else [" 1 0", " 2 0", " 2 5", " 3 0", " 4 0"]
    return (*(f"creative commons {' '.join(x)} {_VERSION} license" for x in product(*(_PARTS[p] for p in parts))), *(short + x for x in ends))


#: Further labels and their wording, in one or several forms.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "gpl": "gnu general public license",
    "lgpl": ("gnu lesser general public license", "gnu library general public license"),
    "agpl": "gnu affero general public license",
    "gfdl": "gnu free documentation license",
    "mpl": "mozilla public license",
    "epl": "eclipse public license",
    "cddl": "common development and distribution license",
    "eupl": ("european union public licence", "european union public license"),
    "ms-pl": "microsoft public license",
    "artistic": "artistic license",
    "psf": "python software foundation license",
    "ofl": "sil open font license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of <<var;name=what;most=8>> to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-3-clause": "neither the name of <<var;name=holder;most=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc": "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd": "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted the software is provided as is",
    "boost": ("boost software license", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    "zlib": "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "apache-2-notice": "licensed under the apache license version 2 <<beginOptional>>0<<endOptional>> <<beginOptional>>the license<<endOptional>> you may not use <<var;name=what;most=4>> except in compliance with the license",
    "cc0": ("cc0 1 0 universal", "creative commons zero"),
    "cc-by": _commons("by"),
    "cc-by-sa": _commons("by", "sa"),
    "cc-by-nd": _commons("by", "nd"),
    "cc-by-nc": _commons("by", "nc"),
    "cc-by-nc-sa": _commons("by", "nc", "sa"),
    "cc-by-nc-nd": _commons("by", "nc", "nd"),
    "spdx": "spdx license identifier <<var;name=id;most=1>>",
}


def _forms(template: str | tuple[str, ...]) -> tuple[str, ...]:
    return (template,) if isinstance(template, str) else template


_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def parse(template: str) -> list:
    """Words, ("optional", [...]) and ("var", most) in order."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*_MARK.finditer(template), None]:
        stack[-1] += _WORD.findall(template[at : mark.start() if mark else None].lower())
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            options = dict(x.split("=") for x in mark[1].split(";")[1:])
            stack[-1].append(("var", int(options["most"])))
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def as_regex(template: str) -> str:
    """The same language as a regular expression over words written as ' word '."""

    def of(parts: list) -> str:
        return "".join(f" {x} " if isinstance(x, str) else f"(?:{of(x[1])})?" if x[0] == "optional" else f"(?: [^ ]+ ){{1,{x[1]}}}" for x in parts)

    return of(parse(template))


class Automaton:
    """States 0..n; ``step[s]`` maps a word (None: any) to next states, ``free[s]``
    lists states reached without a word."""

    def __init__(self, template: str) -> None:
        self.step: list[dict[bytes | None, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.final = self._build(parse(template), 0)
        self.opening = {w for s in self._closed({0}) for w in self.step[s]}
        if None in self.opening:
            raise ValueError("a template has to begin with a word")

    def _state(self) -> int:
        self.step.append({})
        self.free.append(set())
        return len(self.step) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, str):
                to = self._state()
                self.step[at].setdefault(part.encode(), set()).add(to)
                at = to
            elif part[0] == "optional":
                end = self._build(part[1], at)
                self.free[at].add(end)
                at = end
            else:
                end = self._state()
                for _ in range(part[1]):
                    to = self._state()
                    self.step[at].setdefault(None, set()).add(to)
                    self.free[to].add(end)
                    at = to
                at = end
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def accepts(self, words, at: int, end: int) -> int:
        """The end of the longest accepted run that begins at ``at``; -1 if none."""
        states, best = self._closed({0}), -1
        while states:
            if self.final in states:
                best = at
            if at >= end:
                break
            word = words(at)
            at += 1
            states = self._closed({to for s in states for to in (*self.step[s].get(word, ()), *self.step[s].get(None, ()))})
        return best


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))])


def _scanned(base: Mapping[str, str], templates: Mapping[str, str | tuple[str, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(label, True, Automaton(phrase)) for phrase, label in base.items()] + [(label, False, Automaton(x)) for label, t in templates.items() for x in _forms(t)]
        by_word: dict[bytes, list] = {}
        for entry in automata:
            for word in entry[2].opening:
                by_word.setdefault(word, []).append(entry)
        opening = b"".join(by_word)
        ends = np.cumsum([len(w) for w in by_word])
        marks = np.sort(spans.span_hash(np.frombuffer(opening, np.uint8), ends - [len(w) for w in by_word], ends))
        for batch in batches:
            data, offsets = spans.column_bytes(batch.column(1))
            rows = []
            for lo, hi in spans.slices(offsets):
                low = spans.LOWER[data[offsets[lo] : offsets[hi]]]
                starts, stops, first = spans.word_spans(spans.ALNUM[low], offsets[lo : hi + 1] - offsets[lo])
                hashes = spans.span_hash(low, starts, stops)
                near = np.minimum(np.searchsorted(marks, hashes), len(marks) - 1)
                places = np.flatnonzero(marks[near] == hashes)
                of_row = np.searchsorted(places, first)
                word = lambda k, low=low, starts=starts, stops=stops: low[starts[k] : stops[k]].tobytes()
                for k in range(hi - lo):
                    a, b = int(first[k]), int(first[k + 1])
                    found = []
                    for p in places[of_row[k] : of_row[k + 1]].tolist():
                        for label, is_base, automaton in by_word.get(word(p), ()):
                            if (end := automaton.accepts(word, p, b)) >= 0:
                                found.append((label, is_base, p - a, end - a))
                    at = [x[2] for x in found if x[1]]
                    labels = sorted({x[0] for x in found})
                    rows.append((b - a, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x[0] for x in found if x[1]})), ",".join(labels), 1 - 0.5 ** len(labels), [{"label": x[0], "first": x[2], "end": x[3]} for x in found]))
            columns = list(zip(*rows, strict=True)) or [[] for _ in _OUT.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, _OUT.field(k + 1).type) for k, x in enumerate(columns))], schema=_OUT)

    return run


def scan(docs: DataFrame, base: Mapping[str, str] | None = None, templates: Mapping[str, str | tuple[str, ...]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and the matched ``spans`` (label, first word, end).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, after
    lower-casing A-Z. ``base`` maps plain phrases to labels; n_base counts all places
    where one stands. ``templates`` maps labels to one wording or several. The score is 1 - 2**-(number of distinct labels). A null or empty
    text has no words, empty labels and score 0; repeated rows stay, null ids pass
    through, other columns are not looked at."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long>>"
    return rows.mapInArrow(_scanned(base or BASE, TEMPLATES if templates is None else templates), kind)


def oracle() -> str:
    """DuckDB SQL for ``scan`` without its spans."""
    base = {p: "".join(f" {w} " for w in p.split()) for p in BASE}
    hits = " + ".join(f"(length(s) - length(replace(s, '{x}', ''))) // {len(x)}" for x in base.values())
    firsts = ", ".join(f"CASE WHEN contains(s, '{x}') THEN position('{x}' IN s) - 1 END" for x in base.values())
    lasts = ", ".join(f"CASE WHEN contains(s, '{x}') THEN length(s) - {len(x)} - (position('{x[::-1]}' IN reverse(s)) - 1) END" for x in base.values())
    count = "len(string_split(left(s, {0}), '  ')) - CASE WHEN {0} = 0 THEN 1 ELSE 0 END"
    named = lambda found: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(found) + "], lambda x: x IS NOT NULL))), ',')"
    plain = [f"CASE WHEN contains(s, '{x}') THEN '{BASE[p]}' END" for p, x in base.items()]
    more = [f"CASE WHEN regexp_matches(s, '{"|".join(map(as_regex, _forms(t)))}') THEN '{label}' END" for label, t in TEMPLATES.items()]
    return f"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
    ), t AS (
      SELECT doc_id, len(words) AS n_words, CASE WHEN len(words) = 0 THEN '' ELSE ' ' || array_to_string(words, '  ') || ' ' END AS s FROM w
    ), f AS (
      SELECT doc_id, n_words, s, {hits} AS n_base, least({firsts}) AS a, greatest({lasts}) AS z,
        {named(plain)} AS base_labels, {named(plain + more)} AS labels FROM t
    )
    SELECT doc_id, n_words::BIGINT AS n_words, n_base::BIGINT AS n_base,
      CASE WHEN a IS NOT NULL THEN ({count.format("a")})::BIGINT END AS first_word,
      CASE WHEN z IS NOT NULL THEN ({count.format("z")})::BIGINT END AS last_word,
      base_labels, labels, CASE WHEN labels = '' THEN 0.0 ELSE 1 - pow(0.5, len(string_split(labels, ','))) END AS score
    FROM f"""

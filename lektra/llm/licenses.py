"""Operator 10: license scans by fuzzy search for short notices.

A notice consists of words that tell its license (name, clauses, version: in braces), which have to stand exactly, and
of parts around them, of which a tenth of the characters may be wrong, so that no sibling license is taken for it.
A notice that may have k errors is cut into k + 1 pieces; k errors leave one piece whole, so the exact places of
pieces (found for all notices in one pass of an Aho-Corasick automaton) lead to every candidate window; windows that meet
are one. A window that lacks too many of the notice's pairs of neighbouring characters can't match; for the others the regex
library's bounded-error matching decides and tells the span and its errors. Base phrases, whole words that stand
consecutively, are counted beside it.

Texts are compared as their words, A-Z lower-cased, with one blank between words. Defined results: a null
text counts as empty (no words, no labels, score 0, null positions); equal ids are scanned row by row; an empty
table gives an empty table; extra columns stay behind. Texts are never cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.llm.common import per_text

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The phrases that every scan counts, and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices, as their words, and their labels. Words in braces have to stand as they are.
NOTICES = (
    ("licensed under the {apache} license version {2 0}", "apache-2.0"),
    ("licensed under the {apache} license version {1 1}", "apache-1.1"),
    ("this product includes software developed by the {apache} software foundation", "apache-1.1"),
    ("released under the {mit} license", "mit-notice"),
    ("licensed under the {mit} license", "mit-notice"),
    ("distributed under the {mit} license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-text"),
    ("released under the {isc} license", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("{gnu general} public license version {2}", "gpl-2.0"),
    ("{gnu general} public license version {3}", "gpl-3.0"),
    ("{gnu general} public license as published by the free software foundation either version {2}", "gpl-2.0"),
    ("{gnu general} public license as published by the free software foundation either version {3}", "gpl-3.0"),
    ("gnu {lesser general} public license", "lgpl"),
    ("gnu {lesser general} public license version {2 1}", "lgpl-2.1"),
    ("gnu {lesser general} public license version {3}", "lgpl-3.0"),
    ("gnu {affero general} public license", "agpl"),
    ("gnu {affero general} public license version {3}", "agpl-3.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("released under the {bsd} license", "bsd"),
    ("licensed under the {bsd 2 clause} license", "bsd-2-clause"),
    ("licensed under the {bsd 3 clause} license", "bsd-3-clause"),
    ("this source code form is subject to the terms of the {mozilla} public license", "mpl"),
    ("subject to the terms of the {mozilla} public license v {2 0}", "mpl-2.0"),
    ("made available under the terms of the {eclipse} public license", "epl"),
    ("made available under the terms of the {eclipse} public license {2 0}", "epl-2.0"),
    ("this is free and {unencumbered} software released into the public domain", "unlicense"),
    ("{boost} software license version {1 0}", "bsl-1.0"),
    ("licensed under {cc by 4 0}", "cc-by-4.0"),
    ("licensed under {cc by sa 4 0}", "cc-by-sa-4.0"),
    ("licensed under {cc by nc 4 0}", "cc-by-nc-4.0"),
    ("licensed under {cc by nd 4 0}", "cc-by-nd-4.0"),
    ("licensed under {cc by nc sa 4 0}", "cc-by-nc-sa-4.0"),
    ("licensed under {cc by nc nd 4 0}", "cc-by-nc-nd-4.0"),
    ("licensed under a creative commons {attribution 4 0} international license", "cc-by-4.0"),
    ("licensed under a creative commons {attribution 3 0}", "cc-by-3.0"),
    ("licensed under a creative commons {attribution sharealike 4 0} international license", "cc-by-sa-4.0"),
    ("licensed under a creative commons {attribution noncommercial 4 0} international license", "cc-by-nc-4.0"),
    ("dedicated to the public domain under {cc0}", "cc0-1.0"),
)


@dataclass(frozen=True)
class Found:
    """A notice in a text: words from ``start`` to ``end`` (exclusive), and how many characters differ."""

    label: str
    start: int
    end: int
    errors: int
    score: float


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.encode("utf-8", "replace").lower().decode())  # of bytes: A-Z only


def parts_of(notice: str) -> list[tuple[str, bool]]:
    """The parts of a notice, each with the blanks around it, and whether it has to stand exactly; in braces it has to."""
    found = [(x[1:-1] if x[0] == "{" else x, x[0] == "{") for x in re.findall(r"\{[^}]*\}|[^{}]+", notice)]
    return found


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int
    pattern: regex.Pattern
    best: regex.Pattern


def notice_of(notice: str, label: str, tolerance: float) -> Notice:
    """In each part that isn't in braces, a share ``tolerance`` of the characters, rounded up, may be wrong."""
    said, errors = "", 0
    for part, exact in parts_of(notice):
        if exact:
            said += rf"(?<![^ ]){regex.escape(part, literal_spaces=True)}(?![^ ])"
            continue
        left, core, right = " " * part.startswith(" "), part.strip(), " " * (part.endswith(" ") and part != " ")
        most = math.ceil(tolerance * len(core))
        errors += most
        said += f"{left}(?:{regex.escape(core, literal_spaces=True)}){{e<={most}}}{right}" if core else " "
    return Notice(notice.replace("{", "").replace("}", ""), label, errors, regex.compile("(?e)" + said), regex.compile("(?b)" + said))


class NoticeSearch:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, tolerance: float = 0.1):
        self.notices, self.pairs = [notice_of(*n, tolerance) for n in notices], []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            cuts = [len(notice.text) * i // (notice.errors + 1) for i in range(notice.errors + 2)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                pieces.setdefault(notice.text[a:b], []).append((n, a))
            self.pairs.append(Counter(map(str.__add__, notice.text, notice.text[1:])))
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def likely(self, n: int, window: str) -> bool:
        """Each error spoils two pairs of neighbouring characters of the notice at most; the others must be in the window."""
        left = self.pairs[n] - Counter(map(str.__add__, window, window[1:]))
        return left.total() <= 2 * self.notices[n].errors

    def search(self, words: list[str], joined: str) -> list[Found]:
        begins: dict[int, list[int]] = {}
        for last, (size, uses) in self.automaton.iter(joined):
            for n, offset in uses:
                begins.setdefault(n, []).append(last + 1 - size - offset - self.notices[n].errors)
        found = []
        for n, at in begins.items():
            notice = self.notices[n]
            reach = len(notice.text) + 2 * notice.errors + 1  # the character after a match is seen
            at.sort()
            spans: list[list[int]] = []
            for begin in at:
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = begin + reach
                else:
                    spans.append([max(begin, 0), begin + reach])
            for begin, end in spans:
                if not self.likely(n, joined[begin:end]):
                    continue
                for m in notice.pattern.finditer(joined, begin, end):
                    m = notice.best.search(joined, max(begin, m.start() - notice.errors), m.end() + notice.errors + 1) or m  # the first fit may take in too much
                    a, b = m.span()
                    first = joined.count(" ", 0, a + 1 if joined[a : a + 1] == " " else a)
                    wrong = sum(m.fuzzy_counts)
                    found.append(Found(notice.label, first, first + 1 + joined.count(" ", a + 1, b - 1), wrong, 1 - wrong / len(notice.text)))
        return sorted(set(found), key=lambda f: (f.start, f.end, f.label))


def base_places(words: list[str], joined: str) -> list[tuple[int, str]]:
    """(first word, label) of each place of a base phrase."""
    found = []
    if "license" in joined:
        cut = [(phrase.split(" "), label) for phrase, label in BASE_PHRASES]
        for i, word in enumerate(words):
            if word == "license":
                for phrase, label in cut:
                    if i + 1 >= len(phrase) and words[i + 1 - len(phrase) : i + 1] == phrase:
                        found.append((i + 1 - len(phrase), label))
    return found


_SEARCH: dict[tuple, NoticeSearch] = {}

_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64()), ("score", pa.float64())]))


def scanned(docs: DataFrame, *, notices: tuple[tuple[str, str], ...] = NOTICES, tolerance: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places of base phrases, notices with their spans in words and their errors) of each row."""

    def run(texts: list[str]) -> list[pa.Array]:
        key = (notices, tolerance)
        if key not in _SEARCH:
            _SEARCH[key] = NoticeSearch(notices, tolerance)
        numbers, places, found = [], [], []
        for text in texts:
            words = words_of(text)
            joined = " ".join(words)
            numbers.append(len(words))
            places.append([{"start": s, "label": label} for s, label in base_places(words, joined)])
            found.append([vars(f) for f in _SEARCH[key].search(words, joined)])
        return [pa.array(numbers, pa.int64()), pa.array(places, _PLACES), pa.array(found, _FOUND)]

    of = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {of}, n_words long, places array<struct<start:long,label:string>>, notices array<struct<label:string,start:long,end:long,errors:long,score:double>>"
    return per_text(docs, run, schema, ["n_words", "places", "notices"], id_col=id_col, text_col=text_col)


def digest(found: DataFrame) -> DataFrame:
    base, more = F.transform("places", lambda p: p["label"]), F.transform("notices", lambda n: n["label"])
    starts = F.transform("places", lambda p: p["start"])
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("notices", lambda n: n["score"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"), score.alias("score"), "notices",
    )

import math
import random
import re

import numpy as np

from lektra.llm import licenses
from lektra.llm.licenses import words_of
from tests.conftest import SF


def slow_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def slow_found(joined, notice, tolerance=0.1):
    """Does the notice stand anywhere in the text? Sellers' rows over all places, part by part."""
    data = np.array([ord(c) for c in joined] or [0])
    blank = np.concatenate(([True], data == 32, [True])) if joined else np.array([True, False, True])
    reached = np.ones(len(data) + 1, bool)
    for part in re.findall(r"\{[^}]*\}|[^{}]+", notice):
        core = part.strip("{} ")
        if part.startswith(" "):
            reached = np.append(False, reached[:-1] & (data == 32))
        if part[0] == "{":
            reached = reached & blank[:-1]
            for c in core:
                reached = np.append(False, reached[:-1] & (data == ord(c)))
            reached = reached & blank[1:]
        elif core:
            row = np.where(reached, 0, 10_000)
            places = np.arange(len(row))
            row = np.minimum.accumulate(row - places) + places
            for c in core:
                step = np.append(row[0] + 1, np.minimum(row[:-1] + (data != ord(c)), row[1:] + 1))
                row = np.minimum.accumulate(step - places) + places
            reached = row <= math.ceil(tolerance * len(core))
        if part.endswith(" ") and part != " ":
            reached = np.append(False, reached[:-1] & (data == 32))
    return bool(joined) and reached.any()


def slow_labels(text):
    joined = " ".join(words_of(text))
    return {label for notice, label in licenses.NOTICES if slow_found(joined, notice)}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in licenses.digest(licenses.scanned(docs)).collect()}
    labelled = 0
    for r in docs.collect():
        n, places = slow_base(r.text)
        got = rows[r.doc_id]
        assert (got.n_words, got.n_base) == (n, len(places))
        assert (got.first_word, got.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(got.labels.split(",")) and 0 <= got.score <= 1
        labelled += bool(got.labels)
    assert labelled


def test_labels_of_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(5)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for i, (notice, _) in enumerate(licenses.NOTICES * 4):
        spoilt = list(notice.replace("{", "").replace("}", ""))
        for _ in range(i % 7):
            at = rng.randrange(len(spoilt))
            spoilt[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e ", " "])
        before = texts[i % 150]
        texts[10_000 + i] = before[: len(before) // 2] + " " + "".join(spoilt) + " " + before[len(before) // 2 :]
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: {n.label for n in r.notices} for r in licenses.scanned(made).collect()}
    wanted = {d: slow_labels(t) for d, t in texts.items()}
    assert found == wanted
    assert sum(map(bool, wanted.values())) > 80 and not all(wanted.values())


def test_every_notice_is_found_with_its_label():
    search = licenses.NoticeSearch()
    for notice, label in licenses.NOTICES:
        text = "lorem ipsum " * 30 + notice.replace("{", "").replace("}", "").upper() + " dolor sit amet " * 30
        words = words_of(text)
        found = [f for f in search.search(words, " ".join(words)) if f.label == label]
        assert [(f.start, f.end, f.errors) for f in found if f.errors == 0 and f.start == 60], notice


def test_siblings_are_told_apart():
    search = licenses.NoticeSearch()

    def labels(text):
        words = words_of(text)
        return {f.label for f in search.search(words, " ".join(words))}

    assert labels("released under the BSD license") == {"bsd"} and labels("released under the ISC license") == {"isc"}
    assert not labels("released under the GPL license") and not labels("we commit to the summit license")
    assert labels("GNU General Public License version 2") == {"gpl-2.0"} and labels("GNU General Public Licence, version 3") == {"gpl-3.0"}
    assert labels("Licensed under the Apache License, Version 1.1") == {"apache-1.1"}
    assert labels("GNU Lesser General Public License") == {"lgpl"} and not labels("GNU Library General Public License version 2")
    assert labels("licensed under CC BY-SA 4.0") == {"cc-by-sa-4.0"} and labels("licensed under cc by nd 4 0") == {"cc-by-nd-4.0"}
    assert labels("licensed under a Creative Commons Attribution 3.0 International License") == {"cc-by-3.0"}
    assert labels("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License") == {"cc-by-nc-4.0"}


def test_many_places_of_one_notice():
    words = words_of("released under the mit license and " * 500 + "x " * 300 + "releasd under the mit license")
    found = [f for f in licenses.NoticeSearch().search(words, " ".join(words)) if f.label == "mit-notice" and f.errors <= 1]
    assert {f.start for f in found} == {*range(0, 3000, 6), 3300}


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "MIT License! apache\tlicense", "s"), (1, "Licensed under teh Apache Licence, Version 2.0", None), (None, None, "s"), (2, "", "s"), (3, "x " * 200_000 + "general public license", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted(licenses.digest(licenses.scanned(docs)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got] == [
        (4, 2, 0, 2, "apache,mit", "apache,mit"), (8, 0, None, None, "", "apache-2.0"), (0, 0, None, None, "", ""), (200_003, 1, 200_000, 200_000, "gpl", "gpl"), (0, 0, None, None, "", ""),
    ]
    assert got[1].score > 0.9 and got[0].score == 1
    assert licenses.scanned(spark.createDataFrame([], docs.schema)).count() == 0

import random

import numpy as np
import pytest

from lektra.llm import nearcopies as N
from tests.conftest import SF
from tests.llm.test_simhash import slow_components


def slow_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow(rows):
    """The least id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets = {d: slow_shingles(t) for d, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return set(slow_components(sets, near).values())


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = slow([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in N.deduplicated(docs).collect()} == wanted and len(wanted) < docs.count()


def at_similarity(rng, j, shingles=300):
    """Two texts whose shingle sets share about ``j`` of their union, by words replaced five apart or more."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(shingles + 4)]
    k = round(shingles * (1 - j) / (1 + j) / 5)
    copy = list(words)
    for at in range(4, 4 + 5 * k, 5):
        copy[at] = f"v{rng.randrange(10**9)}"
    return " ".join(words), " ".join(copy)


@pytest.mark.parametrize("j", [0.82, 0.85, 0.9, 0.95])
def test_recall(spark, j):
    rng, pairs = random.Random(5), 300
    texts = [t for _ in range(pairs) for t in at_similarity(rng, j)]
    got = N.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert pairs <= got <= 1.03 * pairs


def test_tiny_texts_are_all_found(spark):
    rng, texts = random.Random(15), []
    for n in range(8, 14):
        for _ in range(30):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(words), " ".join(words[:-1])]
    rows = list(enumerate(texts))
    left = {r.doc_id for r in N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == slow(rows) and len(left) < len(rows)


def test_unlike_texts_stay(spark):
    rng = random.Random(6)
    texts = [t for _ in range(100) for t in at_similarity(rng, 0.74)]
    assert N.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 200


def test_groups_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:at] + [f"x{i}"] + words[at:])) for i, at in enumerate(rng.choices(range(200), k=60))]
    assert [r.doc_id for r in N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_groups_of_unlike_nodes(spark, monkeypatch):
    """Chains, in which most nodes are unlike the least one, over many blocks and salts."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "STAR", 3)
    rng, rows = random.Random(17), []
    for group in range(4):
        words = [f"g{group}w{i}" for i in range(120)]
        for step in range(30):
            rows.append((100 * group + step, " ".join(words)))
            words[rng.randrange(120)] = f"new{rng.randrange(10**9)}"
    rng.shuffle(rows)
    left = {r.doc_id for r in N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == slow(rows) and len(left) < 20


def test_similar():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 12, 9)).astype(np.uint64) for _ in range(150)]
    near = [(a, b) for a in range(150) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert slow_components(range(150), list(zip(*N.similar(sets, 80)))) == slow_components(range(150), near)


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(5, "A b c d e f", 1), (3, "a B c d e f", 2), (None, "a b c d e f", 3), (8, None, 4), (9, "", 5), (2, "p q r s t u v", 6), (2, "p q r s t u v", 7), (None, "alone here now then", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    left = N.deduplicated(docs)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 8, 2, None], key=str)
    assert N.deduplicated(spark.createDataFrame([], docs.schema)).count() == 0


def test_many_rows_of_one_text(spark):
    """Rows that agree in id and text make one set of shingles, however many they are."""
    text = " ".join(f"word{i}" for i in range(100))
    docs = spark.createDataFrame([(None, text, "x")] * 3000 + [(1, text + " more", "y"), (2, "something else " * 5, "z")], "doc_id long, text string, a string").repartition(6)
    made = []
    keep = N.written
    N.written = lambda df, name: made.append(keep(df, name)) or made[-1]
    try:
        assert [(r.doc_id, r.a) for r in N.deduplicated(docs).orderBy("doc_id").collect()] == [(1, "y"), (2, "z")]
    finally:
        N.written = keep
    assert [df.count() for df in made] == [2]

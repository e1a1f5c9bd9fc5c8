"""The stored index against ranks that are counted out, before and after texts are indexed anew."""

import math
import random
import re

from lektra.operators.settling import fresh_path
from lektra.sources import index


def slow(texts, terms, limit, every):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    found = []
    for i, w in words.items():
        has = [t for t in terms if t in w]
        if len(has) == len(terms) if every else has:
            found.append((-sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in has), i))
    return [i for _, i in sorted((round(r, 14), i) for r, i in found)][:limit]


def test_same_ranks(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "SLICE_BYTES", 2000)
    rng = random.Random(2)
    word = lambda: f"w{int(rng.expovariate(0.2))}"
    texts = {i: " ".join(word() for _ in range(rng.randrange(1, 60))) for i in range(600)} | {700: None, 701: "", 702: "w0 " * 500}
    frame = lambda rows: spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, term string")
    path = fresh_path(spark, "index")
    index.write(frame(texts.items()), path)

    def same():
        for terms in (["w3", "w9"], ["w0", "w1", "w2"], ["nothing", "w5"]):
            for every in (True, False):
                for limit in (3, None):
                    rows = index.search(spark, path, terms, limit, every=every).collect()
                    assert [r.id for r in sorted(rows, key=lambda r: (round(r.rank, 14), r.id))] == slow(texts, terms, limit, every), (terms, every, limit)
        count = index.stats(spark, path).first()
        words = [re.findall(r"\w+", t or "") for t in texts.values()]
        assert (count.documents, count.terms, count.words) == (len(texts), len({x for w in words for x in w}), sum(map(len, words)))

    same()
    new = {i: " ".join(word() for _ in range(rng.randrange(1, 60))) for i in rng.sample(range(600), 80)} | {702: "w9", 900: "w0 w3 w9"}
    index.add(frame(new.items()), path)
    texts |= new
    same()
    index.add(frame([(900, "w7"), (901, "w3")]), path)
    texts |= {900: "w7", 901: "w3"}
    same()


def test_only_asked_terms_are_read(spark):
    path = fresh_path(spark, "index")
    index.write(spark.createDataFrame([(i, f"a{i} common") for i in range(50)], "id long, text string"), path)
    plan = index.postings(spark, path, ["a7"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,a7)]" in plan or "In(term, [a7])" in plan
    assert index.search(spark, path, ["zzz"]).count() == 0
    empty = fresh_path(spark, "index")
    index.write(spark.createDataFrame([], "id long, text string"), empty)
    assert index.search(spark, empty, ["a"]).count() == 0


def test_blocks_of_a_slice():
    """All blocks of a slice come from one pass, without a sort of its words by Spark."""
    import pyarrow as pa

    rows = pa.table({"slice": pa.array([3] * 5, pa.int32()), "id": pa.array([-2, 4, 4, 7, 9], pa.int64()), "terms": pa.array([["b", "a", "b"], ["a"], ["gone"], [], ["é", "a"]], pa.list_(pa.string()))})
    got = [tuple(r.values()) for r in index._blocks_of(rows, 2).to_pylist()]
    assert got == [
        (3, None, 0, [-2, 4], [0, 0], [3, 1], 2, 0, 0), (3, None, 1, [7, 9], [0, 0], [0, 2], 2, 0, 0),
        (3, "a", 0, [-2, 4], [1, 1], [3, 1], 2, 1, 1), (3, "a", 1, [9], [1], [2], 1, 1, 2), (3, "b", 0, [-2], [2], [3], 1, 2, 3), (3, "é", 0, [9], [1], [2], 1, 1, 2),
    ]
    none = index._blocks_of(rows.slice(3, 1), 2)
    assert [tuple(r.values()) for r in none.to_pylist()] == [(3, None, 0, [7], [0], [0], 1, 0, 0)]


def test_vector_leg_needs_no_index(spark, monkeypatch):
    from lektra.plans import registry
    from tests.conftest import SF

    monkeypatch.setattr(index, "search", lambda *_: 1 / 0)
    assert registry.queries()["a9_vector_leg"](spark, SF).count() > 0

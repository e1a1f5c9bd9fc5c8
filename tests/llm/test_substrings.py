import hashlib
import random
import re

import numpy as np

from lektra.llm import substrings
from tests.conftest import SF


def slow(rows, width=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    rank = lambda d: (d is None, d or 0)
    least = {}
    for d, ws in words:
        for i in range(len(ws) - width + 1):
            key = tuple(ws[i : i + width])
            least[key] = min(least.get(key, rank(d)), rank(d))
    out = []
    for d, ws in words:
        gone = {i + k for i in range(len(ws) - width + 1) if least[tuple(ws[i : i + width])] < rank(d) for k in range(width)}
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def got(docs, **more):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substrings.deduplicated(docs, **more).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = got(docs)
    assert rows == slow([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in rows) > 100


def test_many_slices_and_buckets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(substrings, "SLICE_BYTES", 5_000)
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", 500)
    monkeypatch.setattr(substrings, "TASK_BYTES", 40_000)
    assert got(docs) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_small_windows(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for _ in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), width=5) == slow(rows, 5)


def test_packing():
    rng = np.random.default_rng(1)
    for n in (1, 5, 3000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        docs = rng.integers(-(2**62), 2**62, len(hashes))
        again = substrings.unpack(**substrings.pack(hashes, docs))
        assert (again[0] == hashes).all() and (again[1] == docs).all()
        docs[:] = 2**63 - 1
        assert (substrings.unpack(**substrings.pack(hashes, docs))[1] == docs).all()


def test_nulls_ties_and_clashing_columns(spark):
    a, b = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, a), (1, a), (2, "x " + a + " y"), (None, a), (None, b), (None, b), (3, b), (4, None), (5, ""), (6, "w0\tw1\nw2"), (-7, "w0 w1 " + a)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, slice string")
    assert got(docs) == slow(rows)
    assert substrings.deduplicated(docs, keep_text=False).filter("kept is not null").count() == 0
    assert substrings.deduplicated(spark.createDataFrame([], docs.schema)).count() == 0


def test_texts_once(spark):
    plan = substrings.deduplicated(spark.read.parquet(f"{SF}/documents.parquet"))
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()

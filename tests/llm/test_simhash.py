import random
import re

import numpy as np
import xxhash

from lektra.llm import common, simhash
from lektra.llm.components import components


def slow_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow(rows, radius=4):
    fps = {d: slow_fingerprint(t or "") for d, t in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= radius]
    return {d: (f"{fps[d]:016x}", root) for d, root in slow_components(fps, links).items()}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == slow([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(d != c for d, (_, c) in got.items()) > 10


def test_links_around_centres(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(20):
            centre ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
            fps.add(centre & (2**64 - 1))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius in (4, 6):
        links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
        wanted = slow_components(signed, links)
        got = {r.fp: r.root for r in simhash.component_of(table, radius).collect()}
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
        assert groups(got) == groups(wanted)


def test_large_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_IN_CELL", 16)
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]
    roots = simhash.component_of(spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect()
    assert len(roots) == len(fps) and len({r.root for r in roots}) == 1


def test_manhattan_is_a_lower_bound(spark):
    rng = np.random.default_rng(0)
    fps = rng.integers(-(2**63), 2**63, 500)
    rows = spark.createDataFrame([(int(f),) for f in fps], "fp long").select("fp", simhash.embedded(simhash.F.col("fp")).alias("v")).collect()
    count = lambda f, s: (f >> 2 * s & 3).bit_count()
    assert (simhash.unary(np.array([r.fp for r in rows]).view(np.uint64)) == np.array([r.v for r in rows]).view(np.uint64)).all()
    for a, b in zip(rows[:-1], rows[1:]):
        manhattan = sum(abs(count(a.fp & (2**64 - 1), s) - count(b.fp & (2**64 - 1), s)) for s in range(32))
        assert ((a.v ^ b.v) & (2**64 - 1)).bit_count() == manhattan <= ((a.fp ^ b.fp) & (2**64 - 1)).bit_count()


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 220)] + [(300, 300 + i) for i in range(50)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(7, 7)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == slow_components(nodes, links[:-1])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(5, "A b c d e", 1), (3, "a B c d e", 2), (None, "a b c d e", 3), (8, None, 4), (9, "", 5), (2, long, 6), (2, long, 7), (7, long + " x", 8), (None, "alone here now then", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (8, 8), (9, 8), (2, 2), (2, 2), (7, 2), (None, None)], key=str)
    empty = spark.createDataFrame([], docs.schema)
    assert simhash.near_duplicates(empty).count() == 0


def test_cells_grow_rarer_with_the_fingerprints():
    groups = [simhash.intact_groups(4, n) for n in (0, 10**4, 10**6, 10**8, 10**10)]
    assert groups == sorted(groups) and groups[0] == 4 and groups[-1] > groups[1]
    rng = random.Random(9)
    for intact in (4, 5, 7):
        masks = [m & (2**64 - 1) for m in simhash.cells(4, intact)]
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << i for i in rng.sample(range(64), 4))
            u, v = (int(x) for x in simhash.unary(np.array([a, b], np.uint64)))
            assert any(u & m == v & m for m in masks)


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_KEYS", 10)
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(500)], "k long, x long")
    right = left.groupBy("k").agg(simhash.F.count("*").alias("n"))
    got = common.heavy_join(left, right, "k", 500, "n").collect()
    assert sorted((r.k, r.x) for r in got) == sorted((r.k, r.x) for r in left.collect())

"""Joins that must not compare all with all, against loops that do."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lektra.operators import geometry, nearest
from lektra.operators.knowledge import unsuppressed


def test_spans_and_values(spark):
    rng = random.Random(5)
    made = lambda n: [(i, rng.choice([1, 1, 1, 2, None]), rng.choice("abcdefghij"), s := rng.randrange(-50, 300), s + rng.choice([0, 1, 3, 10, 200])) for i in range(n)]
    rows, guards = made(300) + [(300, 1, None, None, 5)], [g[1:] for g in made(12)] * 2 + [(1, "a", None, 3)]
    known = [g for g in guards if None not in g]
    wanted = [r[0] for r in rows if not any(r[1] == g and (r[2] == v or r[3] is not None and r[3] < e and s < r[4]) for g, v, s, e in known) and not (r[1] == 1 and r[2] == "a")]
    for width in (None, 1, 1000):
        found = unsuppressed(spark.createDataFrame(rows, "id int, group int, value string, start int, end int"), spark.createDataFrame(guards, "group int, value string, start int, end int"), width=width)
        assert sorted(r.id for r in found.collect()) == wanted and found.columns == ["id", "group", "value", "start", "end"]


@pytest.mark.parametrize("many", [0, 256])
def test_regions(spark, many):
    rng = random.Random(3)
    size = lambda: rng.choice([0.0, 0.2, 3.0, 10.0, 10.0, 40.0, 300.0])
    boxes = lambda n: [(i % 3, i, i % 5, i % 4, (rng.uniform(-50, 400), rng.uniform(0, 400), size(), size())) for i in range(n)]
    blocks, regions = boxes(150), boxes(120)

    def score(a, b):
        i = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0) * max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)
        s, t = a[2] * a[3], b[2] * b[3]
        far = math.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2)
        return 0.6 * i / max(min(s, t), 1e-4) + 0.3 * i / max(s + t - i, 1e-4) + 0.1 * max(1 - far / max(math.hypot(*a[2:]), math.hypot(*b[2:]), 1), 0)

    def best(block):
        page, _, group, category, box = block
        found = [(tier, -s, r[1]) for r in regions if r[0] == page for s in [score(box, r[4])] for tier in [1 if group == r[2] and s >= 0.15 else 2 if category == r[3] and s >= 0.25 else 3 if s >= 0.4 else None] if tier]
        return min(found)[2] if found else None

    frame = lambda rows, name: spark.createDataFrame(rows, f"page int, {name} int, group_id int, category int, box struct<x:double,y:double,width:double,height:double>")
    got = {r.block: r.region for r in geometry.matched(frame(blocks, "block"), frame(regions, "region"), many=many).collect()}
    assert got == {b[1]: best(b) for b in blocks} and any(got.values())
    other = frame(regions, "region").select(F.col("page").alias("r_page"), "region", F.col("box").alias("r_box"))
    pairs = [(r.block, r.region) for r in geometry.meeting(frame(blocks, "block").select("page", "block", "box"), other).collect()]
    touch = lambda a, b: a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
    assert sorted(pairs) == sorted((a[1], b[1]) for a in blocks for b in regions if a[0] == b[0] and touch(a[4], b[4]))


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_nearest(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", most)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    monkeypatch.setattr(nearest, "VECTORS", 40)
    rng = np.random.default_rng(1)
    rows = {i: v for i, v in enumerate(rng.standard_normal((200, 5)).tolist())} | {200: rng.standard_normal(3).tolist(), 220: rng.standard_normal(3).tolist(), 240: [1.0, 2.0, 2.0]}
    rows |= {300: rows[20], 301: rows[20], 302: rows[20]}
    odd = [(400, None), (420, []), (440, [0.0] * 5), (460, [float("nan")] * 5), (480, [1.0, None, 2.0, 3.0, 4.0]), (None, [1.0] * 5)]
    frame = spark.createDataFrame([*rows.items(), *odd], "id long, vector array<double>").repartition(3)
    got = {}
    for r in nearest.nearest(frame, frame.filter("id % 20 = 0"), 6, least=0.1).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append((r.id, round(r.score, 9)))
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    wanted = {q: [(i, s) for s, i in sorted((-round(cos(a, b), 9), i) for i, b in rows.items() if i != q and len(a) == len(b) and cos(a, b) >= 0.1)][:6] for q, a in rows.items() if q % 20 == 0}
    assert got == {q: [(i, -s) for i, s in x] for q, x in wanted.items() if x}


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_counts_of_near_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", most)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    monkeypatch.setattr(nearest, "VECTORS", 40)
    rng = np.random.default_rng(2)
    rows = dict(enumerate(rng.standard_normal((200, 5)).tolist())) | {200: [1.0, 2.0, 2.0], 240: [0.0] * 5}
    frame = spark.createDataFrame([*rows.items(), (260, None)], "id long, vector array<double>").repartition(3)
    got = {r.query: (round(r.nearest, 9), r.above) for r in nearest.above(frame, frame.filter("id % 20 = 0"), 0.3).collect()}
    units = np.array([rows[i] for i in range(200)])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    score = units @ units.T - 9 * np.eye(200)
    assert got == {q: (round(float(score[q].max()), 9), int((score[q] >= 0.3).sum())) for q in range(0, 200, 20)}


def test_scores_are_made_in_pieces(monkeypatch):
    """A batch of many vectors against many queries never has all of its scores at once; copies come by id, wherever they stand."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    some = rng.standard_normal((1000, 8))
    vectors = np.concatenate([some] * 20)
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(vectors) + 1, 8), pa.int32()), pa.array(vectors.ravel()))
    asked = np.arange(10**6, 10**6 + 5000), nearest._units(column.slice(0, 5000))
    tracemalloc.start()
    best = nearest._Best(asked, 3, 0.0)
    best.add(np.arange(20_000)[::-1], column)
    found = pa.Table.from_batches(best.batches())
    assert tracemalloc.get_traced_memory()[1] < 200 << 20  # all scores take 800 MB
    tracemalloc.stop()
    # row i of the copies has the id 19,999 - i, so the three least ids of a vector lie in the last three of them
    ids = found.column("id").to_numpy().reshape(-1, 3)
    assert (ids == (999 - np.arange(5000) % 1000)[:, None] + [0, 1000, 2000]).all()


def test_a_pair_is_scored_once(spark):
    frame = lambda name: spark.range(50).selectExpr("id DIV 5 AS page", f"id AS {name}", "id AS group_id", "id AS category", "named_struct('x', 1.0D * id, 'y', 0.0D, 'width', 9.0D, 'height', 1.0D) AS box")
    found = geometry.matched(frame("block"), frame("region"))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().upper().split("\n") if "JOIN" in line]
    assert joins and not any("SQRT" in line or "HYPOT" in line for line in joins)
    assert {r.block: r.region for r in found.collect()} == {i: i for i in range(50)}

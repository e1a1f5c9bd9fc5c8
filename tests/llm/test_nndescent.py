import numpy as np
import pytest
from pyspark.sql import functions as F

from lektra.llm import nndescent
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, node string, w int"


def slow(rows, k=20):
    """{query: [(id, score)]} over all rows; rows (id, vector) with all vectors fit to take part."""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float32).astype(np.float64)
    found = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            near = x @ x[n]
            found[i] = sorted(((j, s) for j, s in zip(ids, near.tolist()) if j != i), key=lambda y: (-y[1], y[0]))[:k]
    return found


def got(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def recall(found, wanted):
    assert found.keys() == wanted.keys()
    for q, rows in found.items():
        assert len(rows) == len(wanted[q]) and rows == sorted(rows, key=lambda y: (-y[1], y[0])) and q not in [i for i, _ in rows]
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in rows}) / len(rows) for q, rows in wanted.items() if rows])


def run(spark, rows, **more):
    return nndescent.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0, **more)


def test_small_table_is_exact(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = got(nndescent.neighbours(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 20 == 0))
    wanted = slow(rows)
    assert recall(found, wanted) == 1
    assert all(abs(s - t) < 1e-12 for q in wanted for (_, s), (_, t) in zip(found[q], wanted[q]))


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths"])
def test_recall_over_many_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(nndescent, "CELL", 256)
    monkeypatch.setattr(nndescent, "SAMPLE", 1000)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 32))
    if kind == "clusters":  # a third of all are near copies of one vector
        x = x[rng.integers(0, 60, 4000)] + 0.3 * rng.standard_normal((4000, 32))
        x[:1300] = x[0] + 0.01 * rng.standard_normal((1300, 32))
    if kind == "lengths":
        x *= rng.lognormal(0, 0.5, 4000)[:, None]
    else:
        x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v, "x", 1) for i, v in enumerate(x.astype(np.float32).tolist())]
    assert recall(got(run(spark, rows)), slow([r[:2] for r in rows])) >= 0.95


def test_copies_odd_rows_and_few_rows(spark):
    rng = np.random.default_rng(3)
    fine = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(60)]
    copies = [(100 + i, fine[7][1]) for i in range(60)] + [(7, fine[7][1]), (20, fine[20][1])]
    odd = [(200, None), (220, []), (240, [0.0] * 6), (260, [1.0, None] * 3), (280, [1.0] * 5 + [float("nan")]), (300, [1.0] * 5 + [float("inf")]), (320, [1.0] * 4), (None, [1.0] * 6)]
    found = got(run(spark, [(i, v, None, None) for i, v in fine + copies + odd]))
    assert recall(found, slow([*dict(fine + copies).items()])) == 1
    assert [i for i, _ in got(run(spark, [(0, [1.0, 0.0], "", 1), (1, [1.0, 0.0], "", 1), (2, [0.5, 0.0], "", 1)]))[0]] == [1, 2]
    assert got(run(spark, [(0, [1.0], "", 1)])) == {}
    assert run(spark, [(0, None, "", 1)]).count() == 0
    assert nndescent.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0

"""Results that used to be cut or to be taken of other tables."""

from lektra.operators import relational as R
from lektra.operators import search as S


def test_all_texts_without_a_vector(spark):
    texts = spark.range(300).selectExpr("id", "if(id % 10 = 0, ' ', 'a text') AS text")
    vectors = spark.range(20).toDF("id")
    wanted = [i for i in range(20, 300) if i % 10]
    assert sorted(r.id for r in S.without_vector(texts, vectors).collect()) == wanted
    assert [r.id for r in S.without_vector(texts, vectors, 5).collect()] == wanted[:5]


def test_places_and_neighbours_of_a_group_over_many_ranges(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", i, i * 7 % 13) for i in range(2000)]
    got = {r.id: (r.place, r.before, r.after) for r in R.placed_in_groups(spark.createDataFrame(rows, "g string, id long, k long"), "g", "id", "k").collect()}
    wanted = {}
    for group in {g for g, _, _ in rows}:
        ids = [i for _, i in sorted((k, i) for g, i, k in rows if g == group)]
        wanted |= {i: (n + 1, ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None) for n, i in enumerate(ids)}
    assert got == wanted

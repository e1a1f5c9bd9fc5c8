"""Operator 11: approximate nearest neighbours by NN-descent, searched greedily along the graph.

The measure is the inner product, in the graph as in the search, so that long vectors, which are near to many, are listed by
many and found. Distinct vectors are the nodes, held as 16-bit whole numbers. The first lists of neighbours come from cells of random hyperplanes, within which all are compared. NN-descent then joins neighbours of
neighbours: around each node, those that it lists and some of those that list it are compared with each other, and what is
nearer than the worst of a list goes into it; this is repeated until few entries change. A query starts from its own node and from
some pivots, opens the lists of its best nodes, and goes on until none of them is unopened. What is found
is scored again from the original vectors in double precision.

Bounds, none of which drops a row or a result: cells and pivots are fitted on a sample of SAMPLE nodes; a list has NEIGHBOURS
entries; of the nodes that list a node as many meet around it; each of them learns the MOST_LEARNT nearest there. Every vector is
indexed, and recall is measured against all vectors in the tests.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do rows without an
id or with another number of components than most (the greater of two numbers alike); equal rows count once; vectors that
are equal are one node, of which the k + 1 smallest ids are kept, more than any query can return; one id with several
vectors is several candidates, and several queries; an empty table gives no rows; extra columns stay behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektra.llm.common import heavy_join, settled, written

#: Entries of a node's list, and of the nodes that list it how many meet around it.
NEIGHBOURS = 48
#: Nodes of a cell of the first lists, on average; a cell that is twice as large is worked off in parts. And how many such partings there are.
CELL, PARTINGS = 4096, 8
#: Neighbours that a node takes from a cell, and from one meeting.
MOST_TAKEN, MOST_LEARNT = 32, 8
#: Nodes that cells and pivots are fitted on.
SAMPLE = 20_000
#: Pivots of a search, and how many a query starts from.
PIVOTS, STARTS = 1024, 4
#: The descent ends when less than this share of all entries is new.
SETTLED_SHARE = 0.05
#: Nodes that a search holds, and of these the best whose lists it opens, over the number of results.
POOL, BEAM = 44, 4


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part, equal rows once."""
    vec = F.col("vec")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec")).filter(F.col("id").isNotNull() & vec.isNotNull())
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0))


def doubles(column: pa.ListArray) -> np.ndarray:
    """A column of vectors, which have one length, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def matrix(column: pa.BinaryArray) -> np.ndarray:
    """A column of 16-bit codes as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").astype(np.float32).reshape(len(column), -1)


@dataclass(frozen=True)
class Index:
    """``nodes`` (node, ids array, vec), ``codes`` (node, code binary) and ``graph`` (node, w array<long>, s array<float>, fresh array<boolean>)."""

    nodes: DataFrame
    codes: DataFrame
    graph: DataFrame
    pivots: tuple[np.ndarray, np.ndarray]
    size: int


def best_lists(most: int, u: np.ndarray, w: np.ndarray, s: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the entries (u lists w at s) the ``most`` nearest of each u, each w once, known if it was anywhere."""
    order = np.lexsort((~known, w, u))
    u, w, s, known = u[order], w[order], s[order], known[order]
    one = np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])) if len(u) else np.empty(0, bool)
    u, w, s, known = u[one], w[one], s[one], known[one]
    order = np.lexsort((w, -s, u))
    u, w, s, known = u[order], w[order], s[order], known[order]
    kept = np.arange(len(u)) - np.searchsorted(u, u) < most
    return u[kept], w[kept], s[kept], known[kept]


def lists(name: str, u: np.ndarray, w: np.ndarray, s: np.ndarray, marks: np.ndarray | None = None, mark: str = "") -> pa.RecordBatch:
    """Entries, ordered by u, as a row for each u."""
    nodes, begins = np.unique(u, return_index=True)
    offsets = pa.array(np.append(begins, len(u)).astype(np.int32))
    columns = [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(s, pa.float32()))]
    if marks is not None:
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(marks, pa.bool_())))
    return pa.RecordBatch.from_arrays(columns, names=[name, "w", "s", *([mark] if mark else [])])


def merged(rows: DataFrame, name: str, most: int, mark: str, negate: bool) -> DataFrame:
    """The ``most`` nearest entries of each ``name`` over its rows (name, w, s, known boolean), in one row, with marks.

    ``mark`` is an array: whether an entry was in a row that is known, or with ``negate`` whether it was in none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, bool))
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            new = (np.repeat(batch.column(0).to_numpy(), sizes), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(), np.repeat(batch.column(3).to_numpy(zero_copy_only=False), sizes))
            u, w, s, known = best_lists(most, *(np.concatenate(x) for x in zip(held, new)))
            whole = u != (u[-1] if len(u) else 0)  # the last one may go on in the next batch
            held = u[~whole], w[~whole], s[~whole], known[~whole]
            if whole.any():
                yield lists(name, u[whole], w[whole], s[whole], known[whole] != negate, mark)
        if len(held[0]):
            yield lists(name, *held[:3], held[3] != negate, mark)

    return rows.select(name, "w", "s", "known").repartition(name).sortWithinPartitions(name).mapInArrow(run, f"{name} long, w array<long>, s array<float>, {mark} array<boolean>")


def first_lists(codes: DataFrame, sample: np.ndarray, size: int, seed: int) -> DataFrame:
    """(node, w, s, known) from the cells of PARTINGS random partings: signs of random projections against their medians."""
    rng = np.random.default_rng(seed)
    depth = max(int(round(np.log2(max(size, 1) / CELL))), 0)
    planes = rng.standard_normal((PARTINGS, sample.shape[1], depth)).astype(np.float32)
    cuts = np.median(np.einsum("ij,tjk->tik", sample, planes), axis=1)
    weights = 1 << np.arange(depth, dtype=np.int64)

    def cells(rows: np.ndarray, t: int) -> np.ndarray:
        return ((rows @ planes[t] > cuts[t]) * weights).sum(axis=1, dtype=np.int64)

    shares = []  # cells that the sample shows to be large are dealt over several tasks
    for t in range(PARTINGS):
        at, n = np.unique(cells(sample, t), return_counts=True)
        parts = np.ceil(n / len(sample) * size / (2 * CELL)).astype(np.int64)
        shares.append((at[parts > 1], parts[parts > 1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, rows = batch.column(0).to_numpy(), matrix(batch.column(1))
            for t, (large, parts) in enumerate(shares):
                cell = cells(rows, t)
                at = np.minimum(np.searchsorted(large, cell), max(len(large) - 1, 0))
                of = np.where(large[at] == cell, parts[at], 1) if len(large) else np.ones(len(cell), np.int64)
                part = (nodes * 0x9E3779B1 >> 7) % of
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t, np.int32)), pa.array(cell), pa.array(part), batch.column(0), batch.column(1)], names=["parting", "cell", "part", "node", "code"])

    def compare(table: pa.Table) -> pa.Table:
        nodes, rows = table.column("node").to_numpy(), matrix(table.column("code").combine_chunks())
        order = np.random.default_rng(len(nodes)).permutation(len(nodes))
        found = []
        for some in np.array_split(order, max(-(-len(nodes) // (2 * CELL)), 1)):
            some = some[np.argsort(nodes[some])]
            most = min(MOST_TAKEN, len(some) - 1)
            if most < 1:
                continue
            for block in np.array_split(np.arange(len(some)), max(-(-len(some) // 1024), 1)):
                near = rows[some[block]] @ rows[some].T
                near[np.arange(len(block)), block] = -np.inf
                top = np.argpartition(near, len(some) - most, axis=1)[:, len(some) - most :]
                found.append(lists("node", np.repeat(nodes[some[block]], most), nodes[some[top]].ravel(), np.take_along_axis(near, top, 1).ravel()))
        empty = lists("node", np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        return pa.Table.from_batches(found or [empty])

    placed = codes.mapInArrow(place, "parting int, cell long, part long, node long, code binary")
    return placed.groupBy("parting", "cell", "part").applyInArrow(compare, "node long, w array<long>, s array<float>").withColumn("known", F.lit(False))


def meetings(graph: DataFrame) -> DataFrame:
    """(at, m, fresh): who meets around each node: its list, and of the nodes that list it NEIGHBOURS, those by fresh entries first."""
    entries = graph.select("node", F.explode(F.arrays_zip("w", "fresh")).alias("e")).select("node", F.col("e.w").alias("w"), F.col("e.fresh").alias("fresh"))
    some = Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("node", "w"))
    back = entries.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= NEIGHBOURS)
    both = entries.select(F.col("node").alias("at"), F.col("w").alias("m"), "fresh").unionByName(back.select(F.col("w").alias("at"), F.col("node").alias("m"), "fresh"))
    return both.groupBy("at", "m").agg(F.bool_or("fresh").alias("fresh"))


def learnt(codes: DataFrame, graph: DataFrame) -> DataFrame:
    """(node, w, s, known): what the nodes learn from the meetings, if it is nearer than the last of their lists.

    Codes are joined to who meets; nodes that very many list are split by AQE's skew join, and around one node a bounded number meets.
    """
    last = graph.select("node", F.when(F.size("s") < NEIGHBOURS, F.lit(float("-inf"))).otherwise(F.array_min("s")).cast("float").alias("last"))
    guests = meetings(graph).join(codes.join(last, "node").withColumnRenamed("node", "m"), "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            at = batch.column(0).to_numpy()
            end = int(np.searchsorted(at, at[-1])) if len(at) else 0
            yield from talk(batch.slice(0, end))
            rest = batch.slice(end)
        if rest is not None:
            yield from talk(rest)

    def talk(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        at, m, fresh, last, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), matrix(batch.column(4))
        cuts = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)).tolist()
        us, ws, ss = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            new = fresh[a:b]
            if b - a < 2 or not new.any():
                continue
            x = rows[a:b]
            near = x @ x.T
            near[(near <= last[a:b, None]) | ~(new[:, None] | new)] = -np.inf
            np.fill_diagonal(near, -np.inf)
            most = min(MOST_LEARNT, b - a - 1)
            top = np.argpartition(near, b - a - most, axis=1)[:, b - a - most :]
            value = np.take_along_axis(near, top, 1)
            i, j = np.nonzero(value > -np.inf)
            us.append(m[a:b][i])
            ws.append(m[a:b][top[i, j]])
            ss.append(value[i, j])
        if us:
            u, w, s = (np.concatenate(x) for x in (us, ws, ss))
            yield lists("node", *best_lists(NEIGHBOURS, u, w, s, np.zeros(len(u), bool))[:3])

    dealt = guests.select("at", "m", "fresh", "last", "code").repartition("at").sortWithinPartitions("at")
    return dealt.mapInArrow(run, "node long, w array<long>, s array<float>").withColumn("known", F.lit(False))


def build(vectors: DataFrame, most: int, *, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 5) -> Index | None:
    """The index of all vectors for results of up to ``most`` ids, in tables in the shared folder; None if no vector takes part."""
    rows = usable(vectors, id_col=id_col, vec_col=vec_col)
    kinds = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if kinds is None:
        return None
    by_id = Window.partitionBy("vec").orderBy("id")
    some = rows.filter(F.size("vec") == kinds.d).distinct().withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= most + 1)
    nodes = written(some.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    size, largest = nodes.select(F.array_max(F.transform("vec", F.abs)).cast("double").alias("x")).agg(F.count("*"), F.max("x")).first()
    scale = 32767 / largest

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.rint(doubles(batch.column(1)) * scale).astype("<i2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in code], pa.binary())], names=["node", "code"])

    codes = written(nodes.select("node", "vec").mapInArrow(encode, "node long, code binary"), "ann-codes")
    every = max(-(-size // SAMPLE), 1)
    sample = codes.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).orderBy(F.xxhash64("node", F.lit(1))).limit(2 * SAMPLE).toArrow()
    sample_rows = matrix(sample.column("code").combine_chunks())
    if not len(sample_rows):
        sample_rows = matrix(codes.limit(1).toArrow().column("code").combine_chunks())
    graph = written(merged(first_lists(codes, sample_rows, size, seed), "node", NEIGHBOURS, "fresh", True), "ann-graph")
    while True:
        entries, fresh = graph.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("fresh", lambda x: x))), F.lit(0))).first()
        if fresh <= SETTLED_SHARE * entries or size <= CELL:  # one cell has compared all
            break
        before = graph.select("node", "w", "s", F.lit(True).alias("known"))
        graph = written(merged(before.unionByName(learnt(codes, graph)), "node", NEIGHBOURS, "fresh", True), "ann-graph")
    longest = np.argsort(-(sample_rows * sample_rows).sum(axis=1), kind="stable")[: PIVOTS // 4]
    chosen = np.unique(np.concatenate((np.arange(min(PIVOTS - len(longest), len(sample_rows))), longest)))
    if sample.num_rows:
        pivots = sample.column("node").to_numpy()[chosen], sample_rows[chosen]
    else:
        pivots = np.empty(0, np.int64), sample_rows[:0]
    return Index(nodes, codes, graph, pivots, size)


def starts(queries: DataFrame, index: Index) -> DataFrame:
    """(q, w, s, known): a query's own node and its nearest pivots, unopened; the pivots go along with the function, a bounded number."""
    pivot_nodes, pivot_rows = index.pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, own, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), matrix(batch.column(2))
            near = x @ pivot_rows.T
            most = min(STARTS, len(pivot_nodes))
            top = np.argpartition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most :] if most else np.empty((len(q), 0), np.int64)
            has = own >= 0
            u = np.concatenate((q[has], np.repeat(q, most)))
            w = np.concatenate((own[has], pivot_nodes[top].ravel()))
            s = np.concatenate(((x[has] * x[has]).sum(axis=1), np.take_along_axis(near, top, 1).ravel()))
            yield lists("q", *best_lists(most + 1, u, w, s, np.zeros(len(u), bool))[:3])

    return queries.select("q", "own", "code").mapInArrow(run, "q long, w array<long>, s array<float>").withColumn("known", F.lit(False))


def search(queries: DataFrame, index: Index, most: int) -> DataFrame:
    """(q, w array<long>, s array<float>): the nodes that each query holds in the end, nearest first.

    ``queries``: q long, own long (its node in the index, or -1), code binary.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                s = np.einsum("ij,ij->i", matrix(batch.column(2)), matrix(batch.column(3)))
                yield lists("q", *best_lists(most + POOL, q, w, s, np.zeros(len(q), bool))[:3])

    pool = written(merged(starts(queries, index), "q", most + POOL, "opened", False), "ann-pool")
    while True:
        held = pool.select("q", F.posexplode(F.arrays_zip("w", "opened")).alias("place", "e")).select("q", "place", F.col("e.w").alias("w"), F.col("e.opened").alias("opened"))
        open_now = (F.col("place") < most + BEAM) & ~F.col("opened")
        front = settled(held.filter(open_now).select("q", F.col("w").alias("node")))
        n = front.count()
        if not n:
            return pool.select("q", "w", "s")
        wanted = settled(front.groupBy("node").agg(F.count("*").alias("n")).join(index.graph.select("node", "w"), "node"))
        reached = heavy_join(front, wanted, "node", n, "n").select("q", F.explode("w").alias("w")).distinct()
        new = reached.join(held.select("q", "w"), ["q", "w"], "left_anti")
        scored = new.join(index.codes.select(F.col("node").alias("w"), F.col("code").alias("code_w")), "w").join(queries.select("q", "code"), "q").select("q", "w", "code", "code_w").mapInArrow(score, "q long, w array<long>, s array<float>")
        opened = pool.withColumn("opened", F.expr(f"transform(opened, (x, i) -> x or i < {most + BEAM})"))
        marked = opened.select("q", F.explode(F.arrays_zip("w", "s", "opened")).alias("e")).select("q", F.array("e.w").alias("w"), F.array("e.s").alias("s"), F.col("e.opened").alias("known"))
        pool = written(merged(marked.unionByName(scored.withColumn("known", F.lit(False))), "q", most + POOL, "opened", False), "ann-pool")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vec_col: str = "embedding", index_of: Callable[..., Index | None] = build) -> DataFrame:
    """(query_id, rank int from 1, vec_id, score double) of the ``k`` nearest of each row for which ``is_query`` holds (a condition on ``vec_id``)."""
    kind = vectors.schema[id_col].dataType.simpleString()
    index = index_of(vectors, k, id_col=id_col, vec_col=vec_col)
    if index is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    asked = usable(vectors, id_col=id_col, vec_col=vec_col).withColumnRenamed("id", "vec_id").filter(is_query).distinct()
    of_node = written(asked.join(index.nodes.select("vec", "node"), "vec").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"), F.col("vec").alias("of_query")), "ann-queries")
    queries = settled(of_node.select("q").distinct().join(index.codes.withColumnRenamed("node", "q"), "q").select("q", F.col("q").alias("own"), "code"))
    found = search(queries, index, k).select("q", F.explode("w").alias("node")).join(index.nodes.select("node", "ids", "vec"), "node")
    vec_of = of_node.groupBy("q").agg(F.any_value("of_query").alias("of_query"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.einsum("ij,ij->i", doubles(batch.column(2)), doubles(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["q", "ids", "score"])

    scored = found.join(vec_of, "q").select("q", "ids", "vec", "of_query").mapInArrow(exact, f"q long, ids array<{kind}>, score double")
    nearest = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    named = scored.join(of_node.select("query_id", "q"), "q").select("query_id", "q", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    return named.withColumn("rank", F.row_number().over(nearest).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

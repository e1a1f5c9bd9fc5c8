"""Operator 6 on shingle sets: near copies by a Jaccard similarity of their five-word shingles, found by SimHash.

Texts with the same set of shingles are one node. A node has a SimHash fingerprint of 384 bits over its set. Two sets of a
similarity j differ in each bit with a chance of arccos(2j / (1 + j)) / pi, 0.15 at j = 0.8, which is too far for the
grid of ``simhash``, whose cells lose no pair within a few bits. So this grid has tables: a cell of a table
fixes the counts of some sampled segments (of one bit each; segments of two bits would need three times as many tables), of the last 320
bits. How many segments follows from the number of nodes, so that a node meets about eight others by chance, and how many
tables from the recall. In a cell the Manhattan distance of the first 64 bits, in two-bit segments, sifts, then their Hamming distance. Nodes that are
connected so are first compared with the least node among them, by their whole shingle sets, in as many tasks as their number
asks for. Those that aren't like it are then compared with all others, block by block. Only pairs of a similarity
of at least 0.8 link, so nothing is taken for a near copy that isn't linked by them. Components are found by alternating stars.

Defined results: texts without words are one node; a null text counts as empty; see ``deduplicated`` for ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektra.llm.common import heavy_join, settled, text_slices, written
from lektra.llm.components import components
from lektra.llm.simhash import hashes_of, linked, majorities
from lektra.llm.substrings import mixed

WIDTH = 5
#: 64-bit words of a fingerprint; the first sifts, the others are sampled by tables.
WORDS = 6
#: Recall that the tables are planned for, and standard deviations by which the sift exceeds the distance to be expected.
RECALL, SLACK = 0.97, 2.2
#: Sets of fewer shingles differ by one of them at most at a similarity of 0.8; they are brought together by all sets less one.
TINY = 10
#: Nodes of a block, of which two are compared at once; nodes that one task compares with the least one.
BLOCK, STAR = 256, 2048

_SALTS = np.random.default_rng(11).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def flips(percent: int) -> float:
    """The chance that a bit differs between two sets of this similarity; sets of unlike sizes differ less."""
    return acos(2 * percent / (100 + percent)) / pi


def radius_of(percent: int) -> int:
    """Bits of the first 64 that may differ."""
    p = flips(percent)
    return round(64 * p + SLACK * (64 * p * (1 - p)) ** 0.5)


def plan(nodes: int, percent: int) -> tuple[int, int]:
    """Sampled segments of a table and number of tables for so many nodes.

    A pair that differs in m of the bits is missed by a table unless it samples none of them; m is binomial.
    """
    bits, p = 64 * (WORDS - 1), flips(percent)
    sampled = max(12, ceil(log2(max(nodes, 1))) - 3)
    chances = [comb(bits, m) * p**m * (1 - p) ** (bits - m) for m in range(bits + 1)]
    met = [comb(bits - m, sampled) / comb(bits, sampled) for m in range(bits + 1)]
    tables = 1
    while sum(c * (1 - x) ** tables for c, x in zip(chances, met)) > 1 - RECALL:
        tables += 1 + tables // 16
    return sampled, tables


def table_matrix(sampled: int, tables: int) -> np.ndarray:
    """For each bit and table the power of two that the bit counts in the table's cell number, or zero; exact in doubles."""
    rng, bits = np.random.default_rng([13, sampled]), 64 * (WORDS - 1)
    found = np.zeros((bits, tables))
    for t in range(tables):
        found[rng.choice(bits, sampled, replace=False), t] = 2.0 ** np.arange(sampled)
    return found


def shingles_of(text: str | None) -> np.ndarray:
    """The sorted set of the hashes of all shingles."""
    return np.unique(np.array(hashes_of(text or "", WIDTH), np.uint64))


def fingerprints_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set its node and the WORDS words of its fingerprint."""
    nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate([*sets, np.empty(0, np.uint64)])
    return nodes, np.stack([majorities(mixed(hashes * salt), sizes) for salt in _SALTS], 1)


def tiny_cells(shingles: np.ndarray) -> list[int] | None:
    """Cells of a small set and of the set less each of its shingles."""
    if not 0 < len(shingles) < TINY:
        return None
    return [xxhash.xxh3_64_intdigest(x.tobytes(), 1) - 2**63 for x in (shingles, *(np.delete(shingles, i) for i in range(len(shingles))))]


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, node, fp, wide, near) of each row; a and b are checksums of the text, near has the cells of a tiny set."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 3):
            found = [shingles_of(x) for x in part.column(3).to_pylist()]
            nodes, words = fingerprints_of(found)
            near = pa.array([tiny_cells(x) for x in found], pa.list_(pa.int64()))
            wide = pa.array([x.tobytes() for x in np.ascontiguousarray(words[:, 1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(nodes.view(np.int64)), pa.array(words[:, 0].view(np.int64)), wide, near], names=["doc_id", "a", "b", "node", "fp", "wide", "near"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a long, b long, node long, fp long, wide binary, near array<long>")


def in_tables(nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(fp, cell) of each node in each table."""
    sampled, tables = plan(n, percent)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = table_matrix(sampled, tables)
        numbers = mixed(np.arange(tables, dtype=np.uint64))
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1, bitorder="little")
                cell = mixed((bits.astype(np.float64) @ matrix).astype(np.uint64) ^ numbers)
                fp = np.repeat(part.column(0).to_numpy(zero_copy_only=False), tables)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(cell.view(np.int64).ravel())], names=["fp", "cell"])

    return nodes.select("fp", "wide").repartition(parts, "fp").mapInArrow(run, "fp long, cell long")


def tiny_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links of tiny sets with the least fingerprint of each of their cells; too few bits of theirs stay for the sift."""
    keyed = settled(nodes.select("fp", F.explode("near").alias("cell")))
    least = settled(keyed.groupBy("cell").agg(F.min("fp").alias("b"), F.count("*").alias("rows")).filter("rows > 1"))
    return heavy_join(keyed, least, "cell", keyed.count(), "rows").select(F.col("fp").alias("a"), "b")


def similar(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Places (child, parent): a spanning forest of the pairs of sets whose Jaccard similarity is ``percent`` or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.append(0, np.cumsum(sizes))
    by_code = np.argsort(code, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(code))) if len(code) else np.zeros(1, np.int64)
    unseen, children, parents = np.ones(len(sets), bool), [], []
    for root in range(len(sets)):
        if not unseen[root]:
            continue
        unseen[root], front = False, [root]
        while front and unseen.any():
            at = front.pop()
            own = code[begins[at] : begins[at + 1]]
            counts = starts[own + 1] - starts[own]
            places = np.repeat(starts[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            both = np.bincount(owner[by_code[places]], minlength=len(sets))
            near = np.flatnonzero(unseen & (100 * both >= percent * (sizes[at] + sizes - both)) & (both > 0))
            unseen[near] = False
            children += near.tolist()
            parents += [at] * len(near)
            front += near.tolist()
    return children, parents


def stars(groups: DataFrame, percent: int) -> DataFrame:
    """(root, size, node, rep, like): is the node's set similar to that of the least node, rep, of its root? rep itself is left out."""
    salts = F.ceil(F.col("size") / STAR).cast("int")
    first = F.col("node") == F.col("rep")
    salt = F.when(first, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), salts).cast("int")))
    dealt = groups.withColumn("salt", F.explode(salt)).withColumn("cell", F.xxhash64("root", "salt")).withColumn("after", ~first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            ends, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy().view(np.uint64)
            keep, like = [], []
            for i, (root, node, rep) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist())):
                own = values[ends[i] : ends[i + 1]]
                if node == rep:
                    at, held = root, own.copy()
                    continue
                if root != at:
                    raise ValueError("a group without its least node")
                both = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(i)
                like.append(both > 0 and 100 * both >= percent * (len(own) + len(held) - both))
            took = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in (0, 1, 2, 4)), pa.array(like, pa.bool_())], names=["root", "size", "node", "rep", "like"])

    chosen = dealt.repartition("cell").sortWithinPartitions("cell", "root", "after").select("root", "size", "node", "shingles", "rep")
    return chosen.mapInArrow(run, "root long, size long, node long, rep long, like boolean")


def verified(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of nodes that are similar, from settled rows (root, size, node, rep, shingles); nodes of one root are compared."""
    told = settled(stars(groups, percent))
    unlike = told.filter("not like and size > 2")  # of two nodes nothing is left to compare
    left = settled(unlike.groupBy("root").agg(F.count("*").alias("unlike"), F.first("size").alias("size")))
    rest = heavy_join(groups.drop("size"), left, "root", groups.count(), "size")
    rest = rest.join(unlike.select("node", F.lit(True).alias("alone")), "node", "left")
    rows, columns = F.ceil(F.col("unlike") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
    row, column = (F.pmod(F.xxhash64("node"), n).cast("int") for n in (rows, columns))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # a node is in its column of all rows of blocks, and one that is unlike the first also in its row of all columns
    at_columns = F.transform(every(rows), lambda i: F.struct(i.alias("i"), column.alias("j")))
    at_rows = F.when(F.col("alone"), F.transform(every(columns), lambda j: F.struct(row.alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    dealt = rest.withColumn("at", F.explode(F.array_distinct(F.concat(at_columns, at_rows)))).select("node", F.xxhash64("root", "at.i", "at.j").alias("cell"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            children, parents = similar(sets, percent) if len(sets) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in children], pa.int64()), pa.array([nodes[i] for i in parents], pa.int64())], names=["a", "b"])

        for batch in batches:
            ends, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy().view(np.uint64)
            for i, (c, node) in enumerate(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())):
                if c != cell:
                    if len(sets) > 1:
                        yield links()
                    cell, nodes, sets = c, [], []
                nodes.append(node)
                sets.append(values[ends[i] : ends[i + 1]].copy())
        yield links()

    more = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")
    return told.filter("like").select(F.col("node").alias("a"), F.col("rep").alias("b")).union(more)


def deduplicated(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their component: least id (null last), then least text checksum.

    Of rows that agree in id and text one stays; extra columns stay as they are.
    """
    sketches = settled(sketched(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "a", "b")
    nodes = settled(sketches.groupBy("node").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("wide").alias("wide"), F.first("near").alias("near")))
    links = linked(in_tables(nodes, nodes.count(), percent), radius_of(percent)).union(tiny_links(nodes))
    near = components(settled(links)).withColumnRenamed("node", "fp")
    met = settled(nodes.select("node", "first", "fp").join(near, "fp", "left").select("node", "first", F.coalesce("root", "fp").alias("root")))
    sizes = settled(met.groupBy("root").agg(F.count("*").alias("size"), F.min("node").alias("rep")).filter("size > 1"))
    chosen = heavy_join(met, sizes, "root", met.count(), "size")
    chosen = chosen.select("root", "size", "rep", "node", F.col("first.id").alias("__id"), F.col("first.a").alias("__a"), F.col("first.b").alias("__b"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), "text")
    again = F.row_number().over(Window.partitionBy("node").orderBy("a"))  # rows that agree in id and text make one set; all but one of a task stay in it
    texts = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b"))).select("root", "size", "node", "text", "rep", "a").withColumn("again", again).filter("again <= 1").select("root", "size", "node", "text", "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 3):
            found = [shingles_of(x).view(np.int64) for x in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.list_(pa.int64())), part.column(4)], names=["root", "size", "node", "shingles", "rep"])

    groups = written(texts.mapInArrow(sets, "root long, size long, node long, shingles array<long>, rep long"), "shingle-sets")
    roots = components(settled(verified(groups, percent))).withColumnRenamed("node", "__node")
    rooted = nodes.join(roots, F.col("node") == F.col("__node"), "left").select("first", F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return only(docs, firsts.select("first.*"))


def only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``keep`` (id, a, b), one of those that agree in id and text.

    One exchange serves the join and the choice among equal rows: both go by the same three hashes.
    """
    own = [f"__own_{i}" for i in range(len(docs.columns))]
    moved = docs.toDF(*own)  # no name of a column can clash
    doc_id, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text"))
    keyed = moved.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(text, F.lit(1)), "__c": F.xxhash64(doc_id)})
    again = F.row_number().over(Window.partitionBy("__a", "__b", "__c").orderBy("__a"))
    once = keyed.withColumn("__copy", again).filter("__copy <= 1")  # a task sends one of its equal rows
    left = once.join(keep.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.xxhash64("id").alias("__c")), ["__a", "__b", "__c"], "left_semi")
    return left.select(*(F.col(x).alias(c) for x, c in zip(own, docs.columns)))

"""Operator 6: SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts, held in unary in
one long, so that the Manhattan distance of two vectors is one bit count. It never exceeds the Hamming distance.
The segments are dealt into groups, so many more than the radius that vectors in range have some groups in common; the cells of
a grid, which fix that many groups with their counts, thus bring together all pairs that are in range. In a cell the
Manhattan distance sifts and the Hamming distance decides.

A cell yields a spanning forest of its links instead of all pairs. Fingerprints are made distinct before, so exact
copies cost one row; a cell of more than MOST_IN_CELL rows is dealt out as pairs of blocks, which
cover every pair of rows. The more fingerprints there are, the more segments a cell fixes, so that cells
stay rare. Components are found by alternating stars.

Defined results: texts without words have the fingerprint zero and link like others; a null text counts as empty; rows
with equal ids are treated row by row; a null id never names a component unless all ids of it are null; an empty table
gives an empty table; extra columns stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektra.llm.common import heavy_join, settled, text_slices
from lektra.llm.components import components

SEGMENTS = 32
MOST_IN_CELL = 8192
SMALL_CELL = 64
#: Bits by which ranges of cells are counted.
RANGE_BITS = 20
#: Comparisons that a task holds at once.
_CELLS = 250_000

#: For each byte, its bits as eight counters of a byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def hashes_of(text: str, width: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of ``width`` words; fewer words are one shingle. A to Z are lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and blanks only
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(whole, 42)]
    lasts = np.cumsum([len(w) + 1 for w in words])
    begins = np.append(0, lasts[: len(words) - width]).tolist()
    ends = (lasts[width - 1 :] - 1).tolist()
    view, digest = memoryview(whole), xxhash.xxh64_intdigest
    return [digest(view[a:b], 42) for a, b in zip(begins, ends)]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes, the bits that are set in over half of them; zero where there are none."""
    out = np.zeros(len(sizes), np.uint64)
    if not sizes.sum():
        return out
    begins = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    cuts = np.concatenate([np.arange(b, b + n, 255) for b, n in zip(begins[some].tolist(), sizes[some].tolist())])  # counters of a byte hold 255
    owner = np.searchsorted(begins[some], cuts, side="right") - 1
    firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    result = np.zeros((len(some), 8), np.uint8)
    for k in range(8):
        counts = np.add.reduceat(_SPREAD[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts.astype(np.int64), firsts, axis=0)
        result[:, k] = np.packbits(2 * counts > sizes[some][:, None], axis=1, bitorder="little").ravel()
    out[some] = result.view("<u8").ravel()
    return out


def fingerprints_of(texts: list[str], width: int = 4) -> np.ndarray:
    """A bit is 1 where it is set in over half the hashes."""
    found = [hashes_of(t, width) for t in texts]
    return majorities(np.array([h for f in found for h in f], np.uint64), np.array([len(f) for f in found], np.int64))


def fingerprinted(docs: DataFrame, *, width: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """(id, fp long) of each row's whole text, with the columns in ``carry``."""
    rows = docs.select(F.col(f"`{id_col}`"), *carry, F.col(f"`{text_col}`").alias("__text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, len(kept)):
            texts = ["" if x is None else x for x in part.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fingerprints_of(texts, width).view(np.int64))], names=[*kept, "fp"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", fp long")


def embedded(fp: Column) -> Column:
    """The counts of all two-bit segments in unary: 00, 01 or 11."""
    low = fp.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def unary(fps: np.ndarray) -> np.ndarray:
    """The same as ``embedded``, within a task."""
    low, high = fps & np.uint64(0x5555555555555555), fps >> np.uint64(1) & np.uint64(0x5555555555555555)
    return low | high | (low & high) << np.uint64(1)


def intact_groups(radius: int, n: int) -> int:
    """How many groups a cell fixes, so that ``n`` random fingerprints have about one in a cell; more make cells rarer but more of them.

    Two random two-bit segments have the same count with a chance of 3/8.
    """
    intact = 4 if radius <= 4 else 3
    while log2(max(n, 1)) > SEGMENTS * intact // (radius + intact) * -log2(3 / 8) and radius + intact < SEGMENTS:
        intact += 1
    return intact


def cells(radius: int, intact: int) -> list[int]:
    """Masks, as signed longs: the groups of segments that a cell of the grid fixes."""
    groups = [sum(3 << 2 * s for s in range(g, SEGMENTS, radius + intact)) for g in range(radius + intact)]
    masks = [sum(c) for c in combinations(groups, intact)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def in_cells(fps: DataFrame, radius: int, n: int) -> DataFrame:
    """(fp, cell) of the grid in which any two of the ``n`` distinct fingerprints within the radius meet."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = fps.select("fp").repartition(parts, "fp").withColumn("vector", embedded(F.col("fp")))  # many tasks before rows multiply
    masks = cells(radius, intact_groups(radius, n))
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("vector").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    return vectors.select("fp", F.explode(keys).alias("cell"))


def forest(fps: np.ndarray, vectors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) that join all that are in range of each other, directly or over others."""
    children, parents = [], []
    unseen = np.arange(len(fps))
    while len(unseen) > 1:
        front, unseen = unseen[:1], unseen[1:]
        while len(front) and len(unseen):
            after, step, begin = [], max(1, _CELLS // len(unseen)), 0
            while begin < len(front) and len(unseen):
                part = front[begin : begin + step]
                begin += step
                rows, columns = np.nonzero(np.bitwise_count(vectors[part][:, None] ^ vectors[unseen][None, :]) <= radius)
                exact = np.bitwise_count(fps[part[rows]] ^ fps[unseen[columns]]) <= radius
                columns, at = np.unique(columns[exact], return_index=True)
                if len(columns):
                    children.append(fps[unseen[columns]])
                    parents.append(fps[part[rows[exact][at]]])
                    after.append(unseen[columns])
                    unseen = np.delete(unseen, columns)
            front = np.concatenate(after) if after else unseen[:0]
    none = fps[:0]
    return np.concatenate(children or [none]), np.concatenate(parents or [none])


def runs_with_links(rows: np.ndarray, cuts: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """Which cells of sorted rows (cell, fingerprint, vector) hold a link; those of more than SMALL_CELL rows are taken unseen.

    Rows are compared with the next, the one after it and so on, for all cells at once.
    """
    run = np.repeat(np.arange(len(cuts)), ends - cuts)
    found = ends - cuts > SMALL_CELL
    first = np.flatnonzero(~found[run])
    for step in range(1, SMALL_CELL):
        first = first[first + step < len(rows)]
        first = first[run[first + step] == run[first]]
        if not len(first):
            break
        near = first[np.bitwise_count(rows[first, 2] ^ rows[first + step, 2]) <= radius]
        found[run[near[np.bitwise_count(rows[near, 1] ^ rows[near + step, 1]) <= radius]]] = True
    return np.flatnonzero(found)


def linked(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of the links between the distinct rows (fp, cell).

    Rows are counted by ranges of cells, which partial aggregation makes few; only the rows of ranges with more than
    MOST_IN_CELL rows are counted by cell and dealt in blocks, as no cell of another range can be large.
    """
    ranged = keyed.withColumn("range", F.shiftrightunsigned("cell", 64 - RANGE_BITS))
    ranges = settled(ranged.groupBy("range").agg(F.count("*").alias("rows")).filter(F.col("rows") > MOST_IN_CELL).select("range"))  # 2 ** RANGE_BITS rows at most
    few = ranged.join(F.broadcast(ranges), "range", "left_anti").select("fp", "cell")
    if ranges.isEmpty():
        dealt = few
    else:
        many = settled(ranged.join(F.broadcast(ranges), "range", "left_semi").select("fp", "cell"))
        counts = settled(many.groupBy("cell").agg(F.count("*").alias("rows")).filter("rows > 1"))
        shared = heavy_join(many, counts, "cell", many.count(), "rows")
        blocks = F.ceil(F.col("rows") / MOST_IN_CELL).cast("int")
        own, other = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        blocked = shared.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
        dealt = few.union(blocked.select("fp", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            a, b = [rows[:0, 0]], [rows[:0, 0]]
            cuts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            ends = np.append(cuts[1:], len(rows))
            for run in runs_with_links(rows, cuts, ends, radius).tolist():
                child, parent = forest(rows[cuts[run] : ends[run], 1], rows[cuts[run] : ends[run], 2], radius)
                a.append(child)
                b.append(parent)
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1).view(np.int64), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, fp = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (1, 0))
            rows = np.stack([cell, fp, unary(fp)], 1)
            last = np.flatnonzero(rows[:, 0] != rows[-1, 0])
            whole = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
            if whole or (held and held[-1][-1, 0] != rows[0, 0]):
                yield links(np.concatenate([*held, rows[:whole]]))
                held = []
            held.append(rows[whole:])
        if held:
            yield links(np.concatenate(held))

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def component_of(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root): the component of each of the distinct fingerprints, named by one of its fingerprints."""
    fps = settled(fps.select("fp"))
    roots = components(settled(linked(in_cells(fps, radius, fps.count()), radius))).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that links reach."""
    fps = settled(fingerprinted(docs, width=width))
    firsts = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    rooted = settled(component_of(firsts, radius).join(firsts, "fp"))
    names = settled(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    named = settled(heavy_join(rooted, names, "root", rooted.count(), "members").select("fp", "copies", "component_id"))
    found = heavy_join(fps, named, "fp", fps.count(), "copies")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

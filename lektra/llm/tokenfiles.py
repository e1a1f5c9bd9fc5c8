"""Operator 5: token files with directly addressable codes.

The ids of all documents stand in ascending order of the document's id, an end id after each document. A file row
holds a segment of whole documents. The codes of a segment are split by bytes into levels: level k has the k-th byte
of each id that is long enough, a bitmap tells which of them go on to the next level, and a directory of counts
before each block of the bitmap finds an id's place there. So one id, or the ids of one document, are read with a few
look-ups, and nothing before or after them is decoded.

Defined results: a null text counts as empty and has the end id alone; null document ids come first; rows with equal
ids stand side by side; an empty table gives no segments and an empty table; extra columns stay behind. Ids are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektra.llm.bpe import piece_table, read_spec
from lektra.llm.common import text_slices

#: Bits of a bitmap between two counts of its directory, and ids of a segment before the next one begins.
BLOCK_BITS, SEGMENT_IDS = 512, 500_000

SEGMENT = "part int, segment int, ids_before long, n_ids long, docs array<long>, counts array<long>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


@dataclass(frozen=True)
class Codes:
    """The directly addressable codes of one segment."""

    levels: list[np.ndarray]
    bitmaps: list[np.ndarray]
    ranks: list[np.ndarray]

    @staticmethod
    def of(ids: np.ndarray) -> Codes:
        levels, bitmaps, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while True:
            levels.append((rest & 0xFF).astype(np.uint8))
            more = rest > 0xFF
            bitmap = np.packbits(more, bitorder="little")
            blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
            bitmaps.append(bitmap)
            ranks.append(np.append(0, np.cumsum(blocks)).astype("<u4"))
            if not more.any():
                return Codes(levels, bitmaps, ranks)
            rest = rest[more] >> np.uint32(8)

    @staticmethod
    def from_bytes(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> Codes:
        return Codes([np.frombuffer(x, np.uint8) for x in levels], [np.frombuffer(x, np.uint8) for x in bitmaps], [np.frombuffer(x, "<u4") for x in ranks])

    def __len__(self) -> int:
        return len(self.levels[0])

    def rank(self, level: int, i: int) -> int:
        """How many of the first ``i`` codes of a level go on: the directory's count and the bits of one block."""
        block = i // BLOCK_BITS
        bits = self.bitmaps[level][block * BLOCK_BITS >> 3 : (i + 7) >> 3]
        count = int(np.bitwise_count(bits).sum())
        if i & 7:
            count -= (int(bits[-1]) >> (i & 7)).bit_count()
        return int(self.ranks[level][block]) + count

    def __getitem__(self, i: int) -> int:
        """One id, without decoding others."""
        value = 0
        for level, (codes, bitmap) in enumerate(zip(self.levels, self.bitmaps)):
            value |= int(codes[i]) << 8 * level
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(level, i)
        return value

    def between(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end`` (exclusive), without decoding others: on each level they stand side by side."""
        found = np.zeros(end - start, np.uint32)
        at = slice(None)
        for level, (codes, bitmap) in enumerate(zip(self.levels, self.bitmaps)):
            found[at] |= codes[start:end].astype(np.uint32) << np.uint32(8 * level)
            first = start & ~7
            more = np.flatnonzero(np.unpackbits(bitmap[first >> 3 : (end + 7) >> 3], count=end - first, bitorder="little")[start - first :])
            if not len(more):
                break
            at = more if level == 0 else at[more]
            start = self.rank(level, start)
            end = start + len(more)
        return found


def write(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write the segments at ``path``."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))  # a fixed file
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("tie", F.crc32(F.col("text").cast("binary"))).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, part = piece_table(spec.value, by_bands=True), TaskContext.get().partitionId()
        segment, before, size, held, docs_held, counts = 0, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            codes = Codes.of(ids)
            columns = [[part], [segment], [before], [len(ids)], [docs_held], [counts], *([[x.tobytes() for x in xs]] for xs in (codes.levels, codes.bitmaps, codes.ranks))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
            names = ["part", "segment", "ids_before", "n_ids", "docs", "counts", "levels", "bitmaps", "ranks"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in text_slices(batches, 1):
            found = pieces.encode(batch.column(1).to_pylist())
            for doc, ids in zip(batch.column(0).to_pylist(), found):
                held.append(np.append(ids, np.uint32(end_id)))
                docs_held.append(doc)
                counts.append(len(ids) + 1)
                size += len(ids) + 1
                if size >= SEGMENT_IDS:
                    yield close()
                    segment, before, size, held, docs_held, counts = segment + 1, before + size, 0, [], [], []
        if held:
            yield close()

    ordered.mapInArrow(run, SEGMENT).write.mode("overwrite").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids in all segments before."""
    rows = spark.read.schema(SEGMENT).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("of_part"))  # as many rows as tasks that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("ids_before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; each document is read by the rank directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, counts, levels, bitmaps, ranks = (batch.column(c)[i].as_py() for c in range(6))
                codes = Codes.from_bytes(levels, bitmaps, ranks)
                ends = np.cumsum(np.array(counts, np.int64))
                starts = ends - counts
                sums = [zlib.crc32(codes.between(a, b).astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments(spark, path).select("start", "docs", "counts", "levels", "bitmaps", "ranks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at one position of the whole.

    Narrow columns tell which segment holds it; of the wide ones that segment alone is read, by filters that reach the scan.
    """
    at = segments(spark, path).select("part", "segment", "start", "n_ids").filter((F.col("start") <= position) & (F.col("start") + F.col("n_ids") > position)).first()
    if at is None:
        raise IndexError(position)
    row = spark.read.schema(SEGMENT).parquet(path).filter((F.col("part") == at.part) & (F.col("segment") == at.segment)).select("levels", "bitmaps", "ranks").first()
    return Codes.from_bytes(row.levels, row.bitmaps, row.ranks)[position - at.start]

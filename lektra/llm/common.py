"""What the operators share: reading tables, the shared folder, and Arrow slices of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.operators.settling import fresh_path, settled, shared_folder

__all__ = ["fresh_path", "heavy_join", "per_text", "settled", "shared_folder", "table", "text_slices", "written"]

#: Bytes of texts that are worked on together where more at once is faster.
SLICE_BYTES = 2_000_000

#: White space of all word contracts here: the blank and U+0009 to U+000D.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows, read from Parquet in the shared folder, so that columns that aren't asked for aren't read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Let the system have the memory that this process has freed, which the C library and Arrow keep otherwise: a Python worker outlives its stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts in a column have about ``most`` bytes together; a longer text stands alone.

    What was freed over a batch is given back before the next one is asked for.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // most
        starts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()] if batch.num_rows else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
        del batch, sizes, block
        give_back()


def per_text(docs: DataFrame, function: Callable[[list[str]], list[pa.Array]], schema: str, names: list[str], *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``function`` to lists of whole texts (null: empty); it returns one array for each of ``names``.

    The id and the columns in ``carry`` go with each row; all other columns of ``docs`` stay behind.
    ``schema`` is the DDL of the result.
    """
    columns = [id_col, *(c for c in carry if c != id_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, len(columns)):
            texts = ["" if x is None else x for x in part.column(len(columns)).to_pylist()]
            made = function(texts)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(columns))), *made], names=[*columns, *names])

    return docs.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


#: Keys that a join broadcasts at most.
HEAVY_KEYS = 100_000


def heavy_join(left: DataFrame, right: DataFrame, on: str, total: int, weight: str) -> DataFrame:
    """Inner join with ``right``, which has one narrow row for each key and in ``weight`` the rows that ``left`` has of it.

    Keys with more than ``total`` / HEAVY_KEYS of the ``total`` rows of ``left`` are fewer than HEAVY_KEYS: they are
    broadcast, and their rows stay where they are. All others are joined by a shuffle, where no key is large. Both sides
    are read more than once, so they are settled before. No more rows than HEAVY_KEYS in all have no other keys.
    """
    if total <= HEAVY_KEYS:
        return left.join(F.broadcast(right), on)
    hot, cold = right.filter(F.col(weight) * HEAVY_KEYS > total), right.filter(F.col(weight) * HEAVY_KEYS <= total)
    light = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return left.join(F.broadcast(hot), on).unionByName(light)

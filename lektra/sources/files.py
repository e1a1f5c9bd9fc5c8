"""Files as rows: a listing that reads no content, and digests that are made again for changed files only.

``digested`` keeps (path, modified, length, sha256) in a table. A file whose three first columns are there already isn't read again;
the others are read in slices of so many paths, so that the driver holds no more of them at a time.

SHA-256 is a chain over the bytes of a file. Small files are read whole; large ones are cut to pieces by as many tasks as they have
splits, and hashed in rounds: a task hashes ``ROUND_BYTES`` of a file and hands the state of the chain on, as a row, to the next round.

Defined results: an empty folder gives no rows; of a file that changed the newest row counts; files that are gone stay out of the result,
and so do empty ones, which Spark's source doesn't list. A large file whose length isn't the listed one any more is an error. Files with a name that
Hadoop would unpack are read whole, up to the 2 GB that Spark's source takes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
from collections.abc import Iterator

import _hashlib
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.operators.settling import fresh_path

SCHEMA = "path string, modified timestamp, length long, sha256 string"
#: Paths that are asked for at a time.
SLICE = 10_000
LARGE_SLICE = 250
#: Files of more bytes are hashed in rounds of so many bytes.
ROUND_BYTES = 128 << 20
#: Bytes of a piece, which is a row.
PIECE_BYTES = 256 << 10

PIECE = "start long, no long, size long, bytes binary"
#: Names that Hadoop's readers unpack.
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".zstd", ".passthrough")
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
#: OpenSSL's SHA256_CTX: eight words, two counts, a block and two numbers.
STATE_BYTES = 112


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of all files below a folder; the column with the content isn't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), "length")


def _known(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """A file as pieces that stand in the order of (start, no); a line end follows the last one if the file has none, and a byte order mark is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            starts = batch.column(0).to_pylist()
            at = 0
            while at < len(starts):  # a task may have several splits, one after another
                end = len(starts) if starts[-1] == starts[at] else next(i for i in range(at, len(starts)) if starts[i] != starts[at])
                whole = b"\n".join([*batch.column(1).slice(at, end - at).to_pylist(), b""])
                cut = [whole[i : i + PIECE_BYTES] for i in range(0, len(whole), PIECE_BYTES)]
                columns = [[starts[at]] * len(cut), range(no, no + len(cut)), map(len, cut), cut]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()])], names=["start", "no", "size", "bytes"])
                at, no = end, no + len(cut)

    lines = spark.read.option("lineSep", "\n").text(path)  # the bytes between line ends, as they are
    return lines.select(F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")).mapInArrow(run, PIECE)


def _go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take each file's state and the pieces that follow it; give its new state, and the digest of what was hashed until then.

    A state is the file's length, the bytes that are hashed and OpenSSL's state; a first one has the bytes in its place that come before all pieces.
    ``hashlib`` keeps that state to itself, so the functions of the library that it loads are called.
    """
    library = ctypes.CDLL(_hashlib.__file__)
    if not hasattr(library, "SHA256_Update"):
        library = ctypes.CDLL(ctypes.util.find_library("crypto"))
    now, length, hashed, state = None, 0, 0, ctypes.create_string_buffer(STATE_BYTES)

    def add(data: bytes) -> None:
        nonlocal hashed
        data = data[: length - hashed]  # without the line end that the file doesn't have
        library.SHA256_Update(state, data, ctypes.c_size_t(len(data)))
        hashed += len(data)

    def told() -> pa.RecordBatch:
        digest, copy = ctypes.create_string_buffer(32), ctypes.create_string_buffer(state.raw, STATE_BYTES)
        library.SHA256_Final(digest, copy)
        columns = [pa.array([now], pa.int32()), pa.array([struct.pack("<qq", length, hashed) + state.raw]), pa.array([hashed]), pa.array([digest.raw.hex()])]
        return pa.RecordBatch.from_arrays(columns, names=["file", "state", "hashed", "sha256"])

    for batch in batches:
        for file, start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if start < 0:
                if now is not None:
                    yield told()
                before = data.as_py()
                now, (length, hashed) = file, struct.unpack("<qq", before[:16])
                if len(before) == 16 + STATE_BYTES:
                    state.raw = before[16:]
                else:
                    library.SHA256_Init(state)
                    add(before[16:])
            else:
                add(data.as_py())
    if now is not None:
        yield told()


def _digested_in_rounds(spark: SparkSession, large: list[tuple[str, int, int]]) -> DataFrame:
    """(path, modified, length, sha256) of files given as (path, microseconds, length)."""
    folder = fresh_path(spark, "pieces")
    for file, (path, _, _) in enumerate(large):
        placed = _pieces(spark, path).withColumn("round", (F.col("start") / ROUND_BYTES).cast("int"))
        placed.write.partitionBy("round").parquet(f"{folder}/pieces/file={file}", compression="none")
    pieces = spark.read.schema(f"{PIECE}, file int, round int").parquet(f"{folder}/pieces")
    sizes = {r.file: r.size for r in pieces.groupBy("file").agg(F.sum("size").alias("size")).collect()}  # a row for each large file
    first = []
    for file, (path, _, length) in enumerate(large):
        lost = length - sizes.get(file, 0)
        if lost not in (0, -1, 3, 2):
            raise ValueError(f"{path} has changed")
        first.append((file, bytearray(struct.pack("<qq", length, 0) + (BYTE_ORDER_MARK if lost > 0 else b""))))
    states = spark.createDataFrame(first, "file int, state binary")
    for turn in range(max(length for _, _, length in large) // ROUND_BYTES + 1):
        rows = pieces.filter(F.col("round") == turn).select("file", "start", "no", "bytes")
        rows = rows.unionByName(states.select("file", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("no"), F.col("state").alias("bytes")))
        dealt = rows.repartition(4 * len(large), "file").sortWithinPartitions("file", "start", "no").select("file", "start", "bytes")
        dealt.mapInArrow(_go_on, "file int, state binary, hashed long, sha256 string").write.parquet(f"{folder}/states/{turn}")
        states = spark.read.parquet(f"{folder}/states/{turn}")
    names = spark.createDataFrame([(file, *row) for file, row in enumerate(large)], "file int, path string, micros long, length long")
    whole = F.when(F.col("hashed") == F.col("length"), F.col("sha256")).otherwise(F.raise_error(F.concat("path", F.lit(" has changed"))))
    return names.join(states, "file").select("path", F.timestamp_micros("micros").alias("modified"), "length", whole.alias("sha256"))


def digested(spark: SparkSession, folder: str, cache: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length, sha256) of all files below a folder; the cache is brought up to date."""
    now = listed(spark, folder, pattern)
    same = ["path", "modified", "length"]
    changed = now.join(_known(spark, cache), same, "left_anti").select("path", F.unix_micros("modified").alias("micros"), "length")
    paths: list[str] = []
    large: list[tuple[str, int, int]] = []

    def add_large() -> None:
        _digested_in_rounds(spark, large).write.mode("append").parquet(cache)
        large.clear()

    def add() -> None:
        rows = spark.read.format("binaryFile").load(paths).select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256"))
        rows.write.mode("append").parquet(cache)
        paths.clear()

    for row in changed.toLocalIterator():
        if row.length > ROUND_BYTES and not row.path.lower().endswith(PACKED):
            large.append((row.path, row.micros, row.length))
        else:
            paths.append(row.path)
        if len(paths) == SLICE:
            add()
        if len(large) == LARGE_SLICE:
            add_large()
    if paths:
        add()
    if large:
        add_large()
    return now.join(_known(spark, cache).dropDuplicates(same), same)

"""Operator 8: substring dedup with Rabin-Karp hashes of every window of words.

Documents are dealt by a hash of their id and text into slices of about SLICE_BYTES, and hashes into buckets of about
BUCKET_WINDOWS, so that what a task holds doesn't grow with the input; there are as many tasks as the bytes ask for. A slice hashes all its windows (a polynomial over 64-bit word
hashes, all windows at once), keeps each hash once with the least document that has it, and sends these, sorted, in one
block for each bucket of hashes. A bucket compares the blocks of all slices and answers each with one bit for
each hash: does a lesser document elsewhere have it? The slice then makes its hashes again, reads the answers in
the same order, and merges the windows that go into maximal intervals of words. A passage that a third of all documents
share costs one entry for each slice. Texts are shuffled once, hashes once, answers are bits.

Defined results: a null text has no words; texts shorter than a window stay whole; a null id is greater than any other and
equals itself; rows with equal ids don't remove each other; an empty table gives an empty table; extra
columns stay behind. Ids are integers. Texts are never cut; one longer than a slice is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Bytes of texts of a slice and windows of a bucket, each held by one task at a time; bytes that a task reads.
SLICE_BYTES, BUCKET_WINDOWS, TASK_BYTES = 8_000_000, 1_000_000, 16_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes that a Python worker remembers.
_MEMORY = 400_000
_NO_ID = np.int64(2**63 - 1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    total = codes[:n].copy()
    for k in range(1, width):
        total *= _BASE
        total += codes[k : k + n]
    return mixed(total)


class Slice:
    """All windows of some documents: which document and place, and the distinct hashes with their least document."""

    def __init__(self, docs: list[int | None], texts: list[str | None], width: int):
        self.words = [(t or "").encode("utf-8", "replace").split() for t in texts]
        hashes = [window_hashes(w, width) for w in self.words]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        ids = np.array([_NO_ID if d is None else d for d in docs], np.int64)
        self.owner = np.repeat(ids, self.sizes)
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        order = np.lexsort((self.owner, every))
        first = np.append(True, every[order][1:] != every[order][:-1])[: len(order)]
        self.hashes = every[order][first]
        self.least = self.owner[order][first]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """For each window: does a lesser document have it, here or (by entry) elsewhere?"""
        return elsewhere[self.entry] | (self.least[self.entry] < self.owner)


def pack(hashes: np.ndarray, docs: np.ndarray) -> dict[str, bytes]:
    """Sorted hashes of one bucket: low five bytes, steps of the rest, and documents as offsets of few bytes."""
    steps = np.diff(hashes >> np.uint64(40), prepend=np.uint64(0)).astype("<u4")
    least = int(docs.min())
    offsets = (docs - least).view(np.uint64)
    width = max(1, (int(offsets.max()).bit_length() + 7) // 8)
    return {"low": hashes.astype("<u4").tobytes(), "mid": (hashes >> np.uint64(32)).astype(np.uint8).tobytes(), "steps": steps.tobytes(), "docs": offsets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), "least": least}


def unpack(low: bytes, mid: bytes, steps: bytes, docs: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    rest = np.cumsum(np.frombuffer(steps, "<u4").astype(np.uint64))
    hashes = rest << np.uint64(40) | np.frombuffer(mid, np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, "<u4")
    wide = np.zeros((len(hashes), 8), np.uint8)
    if len(hashes):
        wide[:, : len(docs) // len(hashes)] = np.frombuffer(docs, np.uint8).reshape(len(hashes), -1)
    return hashes, wide.view("<i8").ravel() + least


_BLOCK = "slice int, bucket int, low binary, mid binary, steps binary, docs binary, least long"
_ANSWER = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def answers(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, bytes]]:
    """For the blocks of one bucket (slice, hashes, least documents): whose hashes have a lesser document elsewhere."""
    hashes = np.concatenate([b[1] for b in blocks])
    docs = np.concatenate([b[2] for b in blocks])
    order = np.lexsort((docs, hashes))
    first = np.append(True, hashes[order][1:] != hashes[order][:-1])[: len(order)]
    least = docs[order][first]
    flags = np.empty(len(order), bool)
    flags[order] = docs[order] > least[np.cumsum(first) - 1]
    out, at = [], 0
    for number, found, _ in blocks:
        mine = flags[at : at + len(found)]
        at += len(found)
        if mine.any():
            out.append((number, np.packbits(mine).tobytes()))
    return out


def deduplicated(docs: DataFrame, *, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of each row; ``kept`` is null unless ``keep_text``."""
    n_bytes = docs.agg(F.sum(F.octet_length(f"`{text_col}`"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, ceil(n_bytes / TASK_BYTES))
    slices = max(tasks, ceil(n_bytes / SLICE_BYTES))
    bits = ceil(log2(max(64, n_bytes / 2 / BUCKET_WINDOWS)))  # a word and a blank have two bytes at least
    shift = np.uint64(64 - bits)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int")).repartition(tasks, "slice")

    def send(batches: pa.Table) -> pa.Table:
        part = Slice(batches["doc_id"].to_pylist(), batches["text"].to_pylist(), width)
        number = batches["slice"][0].as_py()
        bucket = (part.hashes >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        made = [{"slice": number, "bucket": int(bucket[a])} | pack(part.hashes[a:b], part.least[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)])]
        kinds = [("slice", pa.int32()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("low", "mid", "steps", "docs")), ("least", pa.int64())]
        return pa.Table.from_pylist(made, schema=pa.schema(kinds))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def say() -> pa.RecordBatch:
            found = answers(held)
            return pa.RecordBatch.from_pydict({"slice": [x for x, _ in found], "bucket": [at] * len(found), "flags": [x for _, x in found]}, schema=_ANSWER)

        for batch in batches:
            for i in range(batch.num_rows):
                number, bucket, *packed = (batch.column(c)[i].as_py() for c in range(7))
                if bucket != at:
                    if held:
                        yield say()
                    held, at = [], bucket
                held.append((number, *unpack(*packed)))
        if held:
            yield say()

    def finish(_key, mine: pa.Table, flags: pa.Table) -> pa.Table:
        part = Slice(mine["doc_id"].to_pylist(), mine["text"].to_pylist(), width)
        bucket = (part.hashes >> shift).astype(np.int64)
        elsewhere = np.zeros(len(bucket), bool)
        for number, bits in zip(flags["bucket"].to_pylist(), flags["flags"].to_pylist()):
            a, b = np.searchsorted(bucket, [number, number + 1]).tolist()
            elsewhere[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        gone = part.removed(elsewhere) if len(part.entry) else np.zeros(0, bool)
        made: dict[str, list] = {n: [] for n in _RESULT.names}
        at = 0
        for doc, words, size in zip(mine["doc_id"].to_pylist(), part.words, part.sizes.tolist()):
            starts = np.flatnonzero(gone[at : at + size])
            at += size
            kept, n = words, 0
            if len(starts):
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + width, -1)
                stay = np.cumsum(steps)[:-1] == 0
                n = len(words) - int(np.count_nonzero(stay))
                kept = [*compress(words, stay.tolist())]
            text = b" ".join(kept)
            for name, value in zip(_RESULT.names, (doc, len(words), n, text.decode() if keep_text else None, hashlib.sha256(text).hexdigest())):
                made[name].append(value)
        return pa.Table.from_pydict(made, schema=_RESULT)

    blocks = rows.groupBy("slice").applyInArrow(send, _BLOCK)
    flags = blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "slice int, bucket int, flags binary")
    met = rows.groupBy("slice").cogroup(flags.repartition(tasks, "slice").groupBy("slice"))
    return met.applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")

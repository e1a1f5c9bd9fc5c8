"""Operator 12: alignment of the tokens of two tokenizers, over distinct segments.

A text, with a blank before it, is cut before runs of white space, at places where neither vocabulary can join across: the
first tokenizer's pieces begin anew there, and no piece of the second holds the white space after another character, which
is verified from its vocabulary. A segment alone then has the tokens that it has in its text. Texts become numbers of
segments, block by block; the distinct segments of all blocks meet, each is tokenized and aligned once, and its alignment
goes back to the blocks that hold it, where the counts of linked pairs are looked up and the documents composed.

Tokenizers: a ``tokenizers`` JSON file of the byte-level BPE kind without normaliser (A), and a sentencepiece BPE model with byte
fallback, a blank added in front and no normalisation (B); others are refused. Special tokens are ordinary text.

Defined results: null and empty texts have no tokens, nor have texts with a character that a tokenizer doesn't give back (for B
U+2581, its sign for the blank); they link nothing. Rows with equal or null ids are aligned row by row, an empty table gives an
empty table, extra columns stay behind. Texts are never cut short; one without white space is one segment.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from lektra.llm.bpe import read_spec
from lektra.llm.common import heavy_join, settled, text_slices, written

#: Bytes of texts in a block, within which each distinct segment is sent once.
BLOCK_BYTES = 16_000_000
#: Characters of groups that go out together.
OUTPUT_CHARS = 8_000_000
#: Segments that A gets as one text.
RUN = 500
#: Counts of linked pairs that are broadcast; more are joined block by block.
MOST_BROADCAST = 2_000_000
#: Texts of more characters are cut without a list of all their segments.
LONG_TEXT = 1_000_000
#: The blank as B's pieces write it.
MARK = "▁"

#: Whatever any library may take for white space; no cut is made after one of these.
_BLANK = r"\s\x1c-\x1f\x85\u180e\u200b-\u200f\u2000-\u200a\u2028-\u2029\u202f\u205f-\u2064\u3000\ufeff"

_BLANKS = regex.compile(rf"[{_BLANK}]").match


class Aligner:
    """Both tokenizers, where texts may be cut, and the alignment of one segment."""

    def __init__(self, spec_a: bytes, spec_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(spec_a.decode())
        if self.a.normalizer is not None or type(self.a.pre_tokenizer) is not ByteLevel or self.a.pre_tokenizer.add_prefix_space or not self.a.pre_tokenizer.use_regex or any(not t.special for t in self.a.get_added_tokens_decoder().values()):
            raise ValueError("A is not a plain byte-level BPE")
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte_of = {self.byte_mark(b): b for b in range(256)}
        self.bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in t)}
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(spec_b)
        norm, trained, kinds = model.normalizer_spec, model.trainer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        normal = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        if trained.model_type != trained.BPE or not trained.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces) or MARK not in normal:
            raise ValueError("B is not a plain sentencepiece BPE with byte fallback")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec_b)
        self.bytes_b = {i: bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() for i, p in enumerate(model.pieces)}
        self.sizes_a, self.sizes_b = (np.array([len(held.get(i, b"")) for i in range(max(held) + 1)]) for held in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id(MARK)
        inner = {c for p in normal for before, c in zip(p, p[1:]) if not before == c == MARK}
        #: White space that no piece of B holds after another character (blanks after blanks apart): cuts are made before these only.
        self.starts = "".join(c for c in " \t\n" if (MARK if c == " " else c) not in inner)
        if " " not in self.starts:
            raise ValueError("pieces of B reach over blanks")
        self.segment = regex.compile(rf"[\s\S][^{self.starts}]*+(?:(?<=[{_BLANK}])[{self.starts}][^{self.starts}]*+)*+")
        self.faithful_chars = {chr(i) for i in range(128) if self.gives_back(chr(i))}
        self.faithful_ascii = len(self.faithful_chars) == 128

    @staticmethod
    def byte_mark(b: int) -> str:
        """The character by which byte-level vocabularies write a byte: itself if it is printable, else the next one from U+0100."""
        shown = lambda x: 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
        return chr(b) if shown(b) else chr(256 + sum(not shown(x) for x in range(b)))

    def gives_back(self, c: str) -> bool:
        a, b = self.tokens([f" {c}"])
        raw = f" {c}".encode()
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, b.tolist()))

    def faithful(self, text: str) -> bool:
        """Neither tokenizer normalises, so a text is given back if its characters are."""
        if text.isascii() and self.faithful_ascii:
            return True
        new = set(text) - self.faithful_chars
        found = {c for c in new if self.gives_back(c)}
        self.faithful_chars |= found
        return len(found) == len(new)

    def segments(self, text: str) -> Iterator[str]:
        """The segments of a text with the blank before it; together they are all of it."""
        whole = f" {text}"
        return (m.group() for m in self.segment.finditer(whole)) if len(text) > LONG_TEXT else iter(self.segment.findall(whole))

    def tokens(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A and of B of all segments, one after the other.

        A gets runs of segments as one text, as its pieces begin anew with each, but after white space at a segment's end.
        B puts a blank before what it gets; where a segment has none, that blank's token stands alone and is taken off.
        """
        runs, held = [], []
        for s in segments:
            held.append(s)
            if not self.plain_end(s[-1]) or len(held) == RUN:
                runs.append("".join(held))
                held = []
        runs.append("".join(held))
        of_a = [np.array(x.ids, np.int32) for x in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        of_b = [i for s, y in zip(segments, found) for i in ((self.blank,) if s == " " else y if s[0] == " " else y[1:])]
        return np.concatenate(of_a), np.array(of_b, np.int32)

    def align(self, segments: list[str]) -> list[bytes]:
        """The alignment of each segment: ids of A plus one, ids of B plus one as negative numbers, 32-bit, group after group."""
        a, b = self.tokens(segments)
        raw = "".join(segments).encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            raise ValueError("segments aren't the bytes of their tokens")
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        ends = np.cumsum([len(s.encode()) for s in segments])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not np.isin(ends, both, assume_unique=True).all():
            raise ValueError("a token reaches over a cut")
        group = np.concatenate((np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)))
        codes = np.concatenate((a + 1, -(b + 1)))
        order = np.lexsort((np.arange(len(codes)), codes < 0, group))
        codes = codes[order].astype("<i4")
        cuts = np.append(0, np.cumsum(np.bincount(np.searchsorted(ends, both)[group], minlength=len(segments))))
        return [codes[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    @staticmethod
    def plain_end(c: str) -> bool:
        """Whether a segment may follow the character in one text: a letter, a figure or a sign, and no white space of any kind."""
        return _BLANKS(c) is None

    def said(self, codes: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The groups of alignments as text, ``a1,a2|b1;a3|b2,b3``; alignment k is codes[cuts[k]:cuts[k + 1]]."""
        if not hasattr(self, "written_ids"):
            self.written_ids = [f"{i}{mark}" for i in range(1 + max(*self.bytes_a, *self.bytes_b)) for mark in ("", ",", "|", ";")]
        following = np.append(codes[1:], 0)
        mark = np.where(codes > 0, np.where(following > 0, 1, 2), np.where(following > 0, 3, 1))
        mark[cuts[1:] - 1] = 0
        pieces = list(map(self.written_ids.__getitem__, ((np.abs(codes) - 1) * 4 + mark).tolist()))
        return ["".join(pieces[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def links_of(codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of alignments, A's id in the upper 32 bits, B's in the lower, and the alignment that each belongs to."""
    following = np.append(codes[1:], 0)
    following[cuts[1:] - 1] = 0
    last_a, last_b = np.flatnonzero((codes > 0) & (following < 0)), np.flatnonzero((codes < 0) & (following >= 0))
    return (codes[last_a].astype(np.int64) - 1) << 32 | (-codes[last_b].astype(np.int64) - 1), np.searchsorted(cuts, last_b, side="right") - 1


@lru_cache(1)
def aligner(spec_a: bytes, spec_b: bytes) -> Aligner:
    """One for each Python worker."""
    return Aligner(spec_a, spec_b)


class Numbers(dict):
    """Numbers things by first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def blocks(docs: DataFrame, specs: Broadcast, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of about BLOCK_BYTES of texts: block long, ids, of each row the numbers of its segments in order (binary,
    32-bit; null: without tokens), and the distinct segments with their counts.

    A block is named by task and place, so it has to be written before it is used.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tools, first = aligner(*specs.value), TaskContext.get().partitionId() << 32
        for place, part in enumerate(text_slices(batches, 1, BLOCK_BYTES)):
            numbers, orders = Numbers(), []
            for text in part.column(1).to_pylist():
                orders.append(array("i", map(numbers.__getitem__, tools.segments(text))).tobytes() if text and tools.faithful(text) else None)
            n = np.bincount(np.frombuffer(b"".join(x for x in orders if x), np.int32), minlength=len(numbers))
            columns = [pa.array([first + place], pa.int64()), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)), pa.array([orders], pa.list_(pa.binary())), pa.array([list(numbers)], pa.list_(pa.string())), pa.array([n.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "orders", "segments", "counts"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, orders array<binary>, segments array<string>, counts array<long>")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of alignments as all codes and the cuts between them."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i4"), np.append(0, np.cumsum([len(x) // 4 for x in raw])).astype(np.int64)


def aligned_parts(parts: DataFrame, specs: Broadcast) -> DataFrame:
    """The alignment of each row of ``parts`` (block, local, segment, n), as block, local, n, codes.

    Rows meet by segment, at most one of a block, so that each segment is tokenized and aligned once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, last, code = aligner(*specs.value), None, b""
        for batch in batches:
            for part in text_slices([batch], 3):
                runs = part.column(3).dictionary_encode()  # rows of a segment stand side by side
                segments = runs.dictionary.to_pylist()
                new = segments[1:] if segments[0] == last else segments
                codes = ([code] if len(new) < len(segments) else []) + (tools.align(new) if new else [])
                last, code = segments[-1], codes[-1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.DictionaryArray.from_arrays(runs.indices, pa.array(codes, pa.binary())).dictionary_decode()], names=["block", "local", "n", "codes"])

    dealt = parts.select("block", "local", "n", "segment").repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "block long, local int, n long, codes binary")


def link_counts(parts: DataFrame) -> DataFrame:
    """(link, n, best): how often each pair of ids is linked in the corpus, and whether this is the most of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, cuts = flat(batch.column(1))
            links, of = links_of(codes, cuts)
            each, at = np.unique(links, return_inverse=True)
            n = np.bincount(at, batch.column(0).to_numpy()[of], len(each))
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n.astype(np.int64))], names=["link", "n"])

    sums = parts.select("n", "codes").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("link").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))  # as many rows as A has tokens at most
    return sums.withColumn("best", F.col("n") == F.max("n").over(of_b))


def links_by_block(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, links, ns, bests) of the distinct links of each batch of a block's rows: for counts that are too many to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, cuts = flat(batch.column(1))
            links, of = links_of(codes, cuts)
            of_block = batch.column(0).to_numpy()[of]
            order = np.lexsort((links, of_block))
            links, of_block = links[order], of_block[order]
            new = np.append(True, (links[1:] != links[:-1]) | (of_block[1:] != of_block[:-1])) if len(links) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(of_block[new], pa.int64()), pa.array(links[new], pa.int64())], names=["block", "link"])

    pairs = written(parts.select("block", "codes").mapInArrow(run, "block long, link long").distinct(), "links-of-blocks")
    n = pairs.groupBy("link").agg(F.count("*").alias("n_rows"))
    return heavy_join(pairs, settled(counts.join(n, "link")), "link", pairs.count(), "n_rows").select("block", "link", F.col("n"), "best")


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def aligned(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", told: Callable[[str], str] = str) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups string) of each row; without tokens zeros, and null groups.

    ``groups`` is what ``told`` makes of ``a1,a2|b1;a3|b2,b3``, which may be ten times as long as the text: itself, or a digest.
    """
    spark = docs.sparkSession
    specs = spark.sparkContext.broadcast((read_spec(path_a), read_spec(path_b)))  # fixed files
    Aligner(*specs.value)  # refuses other kinds here rather than in a task
    kind = docs.schema[id_col].dataType.simpleString()
    held = written(blocks(docs, specs, id_col=id_col, text_col=text_col), "segment-blocks", "zstd")
    parts = held.select("block", F.posexplode(F.arrays_zip("segments", "counts")).alias("local", "part")).select("block", "local", F.col("part.segments").alias("segment"), F.col("part.counts").alias("n"))
    back = written(aligned_parts(parts, specs), "aligned-parts", "zstd")
    counts = written(link_counts(back), "link-counts")
    few = counts.count() <= MOST_BROADCAST
    known = None
    if few:
        all_counts = counts.orderBy("link").toArrow()
        known = spark.sparkContext.broadcast([all_counts.column(c).to_numpy() for c in ("link", "n", "best")])  # counted before
    # alignments, counts where they aren't broadcast, and documents of a block follow each other
    as_rows = lambda df, at, id_of, data, key, n, best: df.select("block", F.lit(at).alias("kind"), id_of.cast(kind).alias("id"), data.cast("binary").alias("data"), key.cast("long").alias("key"), n.cast("long").alias("n"), best.cast("boolean").alias("best"))
    none = F.lit(None)
    rows = as_rows(back, 0, none, F.col("codes"), F.col("local"), none, none)
    if not few:
        rows = rows.unionByName(as_rows(links_by_block(back, counts), 1, none, none, F.col("link"), F.col("n"), F.col("best")))
    of_docs = held.select("block", F.inline(F.arrays_zip("ids", "orders")))
    rows = rows.unionByName(as_rows(of_docs, 2, F.col("ids"), F.col("orders"), none, none, none))

    def scored(parts: list[pa.RecordBatch]) -> tuple[list[np.ndarray], list[str]]:
        """By the number of a segment in its block: its counts, and its groups as text."""
        tail = pa.Table.from_batches(parts)
        kinds = tail.column("kind").to_numpy()
        mine = tail.filter(pa.array(kinds == 0)).sort_by("key")  # numbers from 0 on
        codes, cuts = flat(mine.column("data").combine_chunks())
        links, of_part = links_of(codes, cuts)
        if known is not None:
            keys, ns, bests = known.value
        else:
            by_link = tail.filter(pa.array(kinds == 1)).select(["key", "n", "best"]).sort_by("key")
            keys, ns, bests = (by_link.column(c).to_numpy() for c in ("key", "n", "best"))
        at = np.searchsorted(keys, links)
        n, of_code = mine.num_rows, np.repeat(np.arange(mine.num_rows), np.diff(cuts))
        total = lambda of, w=None: np.bincount(of, w, n).astype(np.int64)
        n_links = total(of_part)
        found = [total(of_code[codes > 0]), total(of_code[codes < 0]), n_links, n_links, total(of_part, bests[at]), np.zeros(n, np.int64)]
        np.add.at(found[5], of_part, ns[at])  # whole numbers throughout
        return found, aligner(*specs.value).said(codes, cuts)

    def compose(docs_of: pa.RecordBatch, by_part: list[np.ndarray], said: list[str]) -> Iterator[pa.RecordBatch]:
        """Some documents of a block at a time: sums over the segments of each, and their groups in order."""
        orders = [None if x is None else np.frombuffer(x, np.int32) for x in docs_of.column("data").to_pylist()]
        begin, held_chars, sums, texts = 0, 0, [], []
        for i, of in enumerate(orders):
            sums.append([0] * len(COUNTS) if of is None else [int(x[of].sum()) for x in by_part])
            text = None if of is None else ";".join(map(said.__getitem__, of.tolist()))
            texts.append(text if text is None else told(text))
            held_chars += len(texts[-1] or "")
            if held_chars > OUTPUT_CHARS or i + 1 == len(orders):
                yield pa.RecordBatch.from_arrays([docs_of.column("id").slice(begin, i + 1 - begin), *(pa.array(x, pa.int64()) for x in zip(*sums)), pa.array(texts, pa.string())], names=[id_col, *COUNTS, "groups"])
                begin, held_chars, sums, texts = i + 1, 0, [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ready = None, [], None
        for batch in batches:
            names, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy() == 2
            borders = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1]))).tolist() if len(names) else []
            for a, b in zip(borders, [*borders[1:], len(names)]):
                if names[a] != block:
                    block, parts, ready = names[a], [], None
                if not kinds[a]:
                    parts.append(batch.slice(a, b - a))
                    continue
                if ready is None:
                    ready, parts = scored(parts) if parts else ([np.zeros(0, np.int64)] * len(COUNTS), []), []
                yield from compose(batch.slice(a, b - a), *ready)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups string"
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)

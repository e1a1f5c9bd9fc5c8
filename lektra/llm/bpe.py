"""Operator 1: BPE encoding and decoding over a pair occurrence index.

The chunks that a slice of a partition has not met before are laid out in one array of symbols. An index maps each pair, by
its rank, to all positions where it stands. The ranks that have positions are applied in ascending order, each at all its positions at once,
and the pairs that a merge makes or breaks are entered in or struck from the lists of their ranks. Texts are then gathered from the
encoded chunks, so the cost of merging follows the vocabulary of a partition and not its length. ``merge_by_bands`` makes the
same ids faster by taking many ranks together, piece by piece; token files use it.

The tokenizer is any ``tokenizers`` JSON file of the byte-level BPE kind with an end-of-word suffix, white
space dropped, and NFC and lower case as its only other normalisation; others are refused.

Defined results: a null text counts as empty and has no ids; rows with equal or null ids are encoded row by
row; an empty table gives an empty table; extra columns stay behind. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lektra.llm.common import give_back, text_slices

#: Distinct chunks, and their characters, that a Python worker remembers before it starts afresh.
MEMORY = (250_000, 8_000_000)
#: Characters of new chunks that are laid out together, as the index takes more room than the bands.
LEARN_CHARS = 300_000
#: The same where ranks are merged by bands.
BAND_MEMORY, BAND_LEARN_CHARS = (600_000, 20_000_000), 2_000_000

#: str.split() also cuts at these, which Unicode doesn't count as white space.
_NOT_BLANK = regex.compile(r"[\x1c-\x1f]")
_BLANK = regex.compile(r"[\t\n\x0b\f\r \x85\xa0  -     　]+")

#: Chunks of ASCII and Latin letters, which the tests compare with the library one character at a time.
_SIMPLE = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]*").fullmatch
#: By character: 0 for letters of such chunks, 1 for their other characters, 2 for all others, whose last entry stands for what lies beyond.
_KINDS = np.array([2 if not _SIMPLE(c) else 0 if c.isalpha() else 1 for c in map(chr, range(0x180))] + [2], np.uint8)


class Numbers(dict[str, int]):
    """The number of each chunk or piece, by first look-up; ``new`` has those that aren't learnt yet."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__(known or {})
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class PieceTable:
    """Encodes texts by their white-space chunks, each of which is encoded once and then looked up.

    Pieces never reach over white space and no normalisation joins characters over it, so a chunk alone has the
    ids that it has in its text. The library normalises and cuts the new chunks; merging is done here.
    """

    def __init__(self, spec: bytes, by_bands: bool = False):
        self.by_bands = by_bands
        config = json.loads(spec)
        model, steps = config["model"], config["normalizer"]["normalizers"]
        splits = config["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or not model["end_of_word_suffix"]:
            raise ValueError("not a byte-level BPE with lower case and an end-of-word suffix")
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_str(spec.decode())
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.piece = regex.compile(splits[0]["pattern"]["Regex"] + "| ")
        self.byte_marks = np.array([ord(self.cut(chr(b))[0][0]) if 33 <= b < 127 else 0 for b in range(256)], np.uint16)
        for c in map(chr, range(0xA1, 0x180)):  # all leading and following bytes of two
            self.byte_marks[list(c.encode())] = [ord(x) for p, _ in self.cut(c) for x in p]
        #: The ids of single byte-level characters, within a piece and at its end.
        self.inner = np.array([vocab.get(chr(c), -1) for c in range(0x200)], np.int32)
        self.final = np.array([vocab.get(chr(c) + suffix, -1) for c in range(0x200)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        codes = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.never = len(pairs)
        self._hash_pairs(codes)
        edges = [0, 16]
        while edges[-1] < self.never:
            edges.append(min(int(edges[-1] * 1.25) + 1, self.never))
        self.bands = np.array(edges, np.int64)
        self.forget()

    def _hash_pairs(self, codes: np.ndarray) -> None:
        """Rank by pair, in a table with open addresses that numpy can search for many pairs at once."""
        bits = max(int(np.ceil(np.log2(4 * len(codes) + 4))), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.slot_ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.never, np.int64)
        self.probes = 1
        for rank, (code, at) in enumerate(zip(codes.tolist(), self._home(codes).tolist())):
            step = 1
            while self.slots[at] >= 0:
                at, step = (at + 1) & self.mask, step + 1
            self.slots[at], self.slot_ranks[at] = code, rank
            self.probes = max(self.probes, step)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        codes = first.astype(np.int64) << 20 | second
        at = self._home(codes)
        found = np.where(self.slots[at] == codes, self.slot_ranks[at], self.never)
        left = np.flatnonzero((self.slots[at] != codes) & (self.slots[at] >= 0))
        for step in range(1, self.probes):
            if not len(left):
                break
            here = (at[left] + step) & self.mask
            held = self.slots[here]
            hit = held == codes[left]
            found[left[hit]] = self.slot_ranks[here[hit]]
            left = left[~hit & (held >= 0)]
        return found

    def forget(self) -> None:
        self.rows, self.chars = Numbers(), 0
        #: The ids of all chunks, and by the number of a chunk where they start and how many they are.
        self.flat, self.starts, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        #: The same of pieces, where ranks are merged by bands; their ids stand in ``flat`` too. The blank between chunks is the first and has none.
        self.pieces, self.piece_starts, self.piece_counts = Numbers({" ": 0}), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def laid_out(self, symbol: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each symbol the next and the last one of its piece, or -1, and the rank of the pair that begins with it."""
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.flatnonzero(np.append(piece[1:] != piece[:-1], True))
        after[ends] = -1
        before[np.append(0, ends[:-1] + 1)] = -1
        rank = np.full(n, self.never, np.int32)
        pairs = np.flatnonzero(after >= 0)
        rank[pairs] = self.rank_of(symbol[pairs], symbol[pairs + 1])
        return after, before, rank

    def merge(self, symbol: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Merge the symbols of all pieces (``piece`` has the number of each symbol's); a symbol that is used up becomes -1.

        ``places`` is the index of pairs: for each rank the positions where its pair was entered. A position whose pair has changed since is
        known by its rank and left out. A merge makes pairs of higher rank only, so each rank is applied once.
        """
        after, before, rank = self.laid_out(symbol, piece)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[rank[at] < self.never]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for r, a, b in zip(ranks[begins].tolist(), begins, [*begins[1:], len(at)]):
                if r in places:
                    places[r].append(at[a:b])
                else:
                    places[r] = [at[a:b]]
                    heappush(active, r)

        enter(np.flatnonzero(rank < self.never).astype(np.int32))
        while active:
            lowest = heappop(active)
            lists = places.pop(lowest)
            i = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
            i = i[rank[i] == lowest]
            if not len(i):
                continue
            touching = after[i[:-1]] == i[1:]
            if touching.any():  # runs of one symbol: every other pair
                place = np.arange(len(i))
                i = i[(place - np.maximum.accumulate(np.where(np.append(False, touching), 0, place))) % 2 == 0]
            j = after[i]
            k = after[j]
            symbol[i], symbol[j], rank[j], after[i] = self.made[lowest], -1, self.never, k
            follows = k >= 0
            before[k[follows]] = i[follows]
            rank[i] = self.never
            h = before[i]
            changed = np.concatenate((i[follows], h[h >= 0]))
            rank[changed] = self.rank_of(symbol[changed], symbol[after[changed]])
            enter(distinct(changed))
        return symbol

    def merge_by_bands(self, symbol: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """What ``merge`` does, with fewer steps.

        The index lists the positions of all pairs by band of ranks, and bands are applied in ascending order.
        Within a band each piece takes its lowest rank at all its places, leftmost first, until none is left.
        A merge makes pairs of higher rank only, so what it adds belongs to this band or a later one.
        """
        never = self.never
        after, before, rank = self.laid_out(symbol, piece)
        index: list[list[np.ndarray]] = [[] for _ in self.bands]

        def enter(at: np.ndarray) -> None:
            band = np.searchsorted(self.bands, rank[at], side="right") - 1
            order = np.argsort(band, kind="stable")
            at, band = at[order], band[order]
            cuts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                index[band[a]].append(at[a:b])

        pairs = np.flatnonzero(rank < never)
        if len(pairs):
            enter(pairs)
        for band, top in enumerate(self.bands[1:].tolist()):
            if not index[band]:
                continue
            at = distinct(np.concatenate(index[band]))
            index[band] = []
            while len(at := at[rank[at] < top]):
                here, of = rank[at], piece[at]
                cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                lowest = np.minimum.reduceat(here, cuts)
                chosen = here == np.repeat(lowest, np.diff(np.append(cuts, len(at))))
                i, low = at[chosen], here[chosen]
                touching = np.append(False, after[i[:-1]] == i[1:])
                if touching.any():  # runs of one symbol: every other pair
                    place = np.arange(len(i))
                    odd = (place - np.maximum.accumulate(np.where(touching, 0, place))) % 2 == 1
                    i, low = i[~odd], low[~odd]
                j = after[i]
                k = after[j]
                symbol[i], symbol[j], rank[j], after[i] = self.made[low], -1, never, k
                follows = k >= 0
                before[k[follows]] = i[follows]
                h = before[i]
                changed = distinct(np.concatenate((i, h[h >= 0])))
                rank[changed] = never
                whole = changed[after[changed] >= 0]
                rank[whole] = self.rank_of(symbol[whole], symbol[after[whole]])
                at = distinct(np.concatenate((at, whole[rank[whole] < top])))
                later = whole[(rank[whole] >= top) & (rank[whole] < never)]
                if len(later):
                    enter(later)
        return symbol

    def _learn(self) -> None:
        """Learn the new chunks, of which some are laid out together, so that the layout stays small."""
        chunks, self.rows.new = self.rows.new, []
        numbers = np.arange(len(self.starts), len(self.rows))  # in the order in which they were met
        room = np.zeros(len(chunks), np.int64)
        self.starts, self.counts = np.append(self.starts, room), np.append(self.counts, room)
        self.chars += sum(map(len, chunks))
        if marks := [c for c in chunks if c[0] == " "]:  # special tokens
            special = np.array([c[0] == " " for c in chunks])
            self._keep(numbers[special], np.array([self.special[c[1:]] for c in marks], np.uint32), np.ones(len(marks), np.int64))
            chunks, numbers = [c for c in chunks if c[0] != " "], numbers[~special]
        if not chunks:
            return
        sizes = np.cumsum([len(c) for c in chunks]) // (BAND_LEARN_CHARS if self.by_bands else LEARN_CHARS)
        cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(chunks)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            self._learn_together(chunks[a:b], numbers[a:b])

    def _learn_together(self, chunks: list[str], numbers: np.ndarray) -> None:
        if self.by_bands:
            self._learn_by_pieces(chunks, numbers)
            return
        simple = np.array([c.isascii() and c.isprintable() or _SIMPLE(c) is not None for c in chunks])
        for kind, cut in ((simple, self._cut_simple), (~simple, self._cut_by_library)):
            if some := list(compress(chunks, kind.tolist())):
                self._learn_cut(numbers[kind], *cut(some))

    def _learn_by_pieces(self, chunks: list[str], numbers: np.ndarray) -> None:
        """The pieces of simple chunks are remembered too: many chunks differ by case and punctuation alone, and letters alone are one piece."""
        codes = np.frombuffer(" ".join(chunks).encode("utf-32-le"), np.uint32)
        kinds = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
        blanks = np.flatnonzero(codes == 32)
        kinds[blanks] = 0
        kinds = np.maximum.reduceat(kinds, np.append(0, blanks + 1))
        words, mixed, others = (list(compress(chunks, (kinds == kind).tolist())) for kind in range(3))
        number = self.pieces.__getitem__
        of_words = np.fromiter(map(number, " ".join(words).lower().split(" ") if words else ()), np.int64, len(words))
        found = self.piece.findall(" ".join(mixed).lower()) if mixed else []
        of_mixed = np.fromiter(map(number, found), np.int64, len(found))
        if new := self.pieces.new:
            self.pieces.new = []
            raw = np.frombuffer("".join(new).encode(), np.uint8)
            letters = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            ends = letters[np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))]
            ids, counts = self._merged(self.byte_marks[raw], np.diff(ends, prepend=0))
            self.piece_starts = np.append(self.piece_starts, len(self.flat) + np.cumsum(counts) - counts)
            self.piece_counts = np.append(self.piece_counts, counts)
            self.flat = np.append(self.flat, ids)
        letters_alone = numbers[kinds == 0]
        self.starts[letters_alone], self.counts[letters_alone] = self.piece_starts[of_words], self.piece_counts[of_words]
        if mixed:
            counts = np.bincount(np.cumsum(of_mixed == 0), self.piece_counts[of_mixed], len(mixed)).astype(np.int64)
            self._keep(numbers[kinds == 1], gathered(self.flat, self.piece_starts[of_mixed], self.piece_counts[of_mixed]), counts)
        if others:
            self._learn_cut(numbers[kinds == 2], *self._cut_by_library(others))

    def _cut_simple(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without combining marks NFC changes nothing, and what is a letter or a number is beyond doubt."""
        pieces = self.piece.findall(" ".join(chunks).lower())  # with the blanks between chunks
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        letters = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        ends = letters[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
        sizes = np.diff(ends, prepend=0)
        blank = raw[ends - sizes] == 32
        owner = np.cumsum(blank)[~blank]
        return self.byte_marks[raw[np.repeat(~blank, sizes)]], sizes[~blank], owner

    def _cut_by_library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = self.normalize(" ".join(chunks))
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        if len(blanks) != len(chunks) - 1:
            raise ValueError("a chunk changed its white space")
        cut = self.cut(text)
        owner = np.searchsorted(blanks, np.array([a for _, (a, _) in cut], np.int64))
        marks = np.frombuffer("".join([p for p, _ in cut]).encode("utf-16-le"), np.uint16)
        return marks, np.array([len(p) for p, _ in cut], np.int64), owner

    def _learn_cut(self, numbers: np.ndarray, marks: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> None:
        """``marks``: byte-level characters of all pieces; ``sizes`` and ``owner``: of each piece."""
        ids, counts = self._merged(marks, sizes)
        self._keep(numbers, ids, np.bincount(owner, counts, len(numbers)).astype(np.int64))

    def _merged(self, marks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        symbol, piece = self.inner[marks], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.final[marks[ends]]
        if len(symbol):
            symbol = (self.merge_by_bands if self.by_bands else self.merge)(symbol, piece)
        left = symbol >= 0
        return symbol[left].astype(np.uint32), np.bincount(piece[left], minlength=len(sizes))

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts[numbers] = len(self.flat) + np.cumsum(counts) - counts
        self.counts[numbers] = counts
        self.flat = np.append(self.flat, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as arrays of unsigned 32-bit integers."""
        most_chunks, most_chars = BAND_MEMORY if self.by_bands else MEMORY
        if len(self.rows) > most_chunks or self.chars > most_chars:
            self.forget()
        number, rows, ends = self.rows.__getitem__, array("i"), [0]  # the chunks of one text at a time are Python objects
        for text in texts:
            if self.special_cut is not None and "<" in text and self.special_cut.search(text):
                for part in self.special_cut.split(text):
                    if part in self.special:
                        rows.append(number(f" {part}"))  # no chunk holds a blank
                    else:
                        rows.extend(map(number, cut_at_blanks(part)))
            else:
                rows.extend(map(number, cut_at_blanks(text)))
            ends.append(len(rows))
        if self.rows.new:
            try:
                self._learn()
            except BaseException:
                self.forget()  # numbered, but not learnt
                raise
        numbers = np.array(rows, np.int32)
        return [self.ids_of(numbers[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks, by their numbers."""
        return gathered(self.flat, self.starts[numbers], self.counts[numbers])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with blanks between them: what a file without a decoder says."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many entries from each start on, one after another."""
    last = np.cumsum(counts)
    return flat[np.repeat(starts - last + counts, counts) + np.arange(last[-1] if len(last) else 0)]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def cut_at_blanks(text: str) -> list[str]:
    return [c for c in _BLANK.split(text) if c] if _NOT_BLANK.search(text) else text.split()


_TABLES: dict[tuple[int, str, bool], PieceTable] = {}


def piece_table(spec: bytes, by_bands: bool = False) -> PieceTable:
    """One for each Python worker and vocabulary, so that what it has learnt lasts over tasks."""
    key = (len(spec), hashlib.sha256(spec).hexdigest(), by_bands)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PieceTable(spec, by_bands)
        give_back()  # what parsing the file took
    return _TABLES[key]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary: little-endian unsigned 32-bit integers) of each row's whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))  # a fixed file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(spec.value)
        for part in text_slices(batches, 1):
            found = pieces.encode(["" if x is None else x for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string) of each row's ids; null ids count as none."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(spec.value)
        for part in text_slices(batches, 1):
            texts = [pieces.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, ids_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` binary, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode, decode the ids again, and digest both."""
    back = decode(encode(docs, tokenizer_path), tokenizer_path)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

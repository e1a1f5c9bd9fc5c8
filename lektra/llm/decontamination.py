"""Operator 7: benchmark decontamination by CGK embeddings and bit sampling.

Texts and items are compared as words (letters and digits of any script, lower-cased). The CGK random walk
reads a window: at each step it emits the word under it, and the word and the step together decide whether it moves
on; two windows at a small edit distance thus emit sequences at a small Hamming distance. Each of many tables samples
a few steps of a walk; a window of the size of an item that agrees with it in one table is a candidate, and the edit
distance between the item and the text from there is then computed exactly. What a walk emits depends on all before it, so
edits near its beginning cost most; therefore half of the tables walk from the first word on, and half from the last one
backwards. Sampled steps, walks and tables follow from the target recall for each window size, by the rate at which windows at the
distance limit agree for the worst kind and place of edits: substitutions, insertions or deletions alone, over
the whole window or in its first half (its second half is the same the other way round). A target that no plan reaches is an error.

An item of fewer than LONG words is one window of its own size. A longer one is cut into blocks that cover all its words; if it
stands in a text within its limit, wherever the edits lie, one of its blocks does so within the limit of the block. So blocks are searched like
short items, and around each place of one the whole item is aligned with the text.

A window within the limit of d edits has all but d of its words from the benchmark's vocabulary, starts with one of
them at its best place, and holds one of d + 1 pieces of the item unchanged. This screen is exact; it leaves few
starts for the walks. Vocabulary, pieces and table keys of the items reach the tasks as bitmaps of a fixed size,
which let more through when the benchmark grows but lose nothing.

Defined results: null and blank texts match nothing; items without words are left out; items with the same words match
apart; rows with equal ids are searched row by row and reported once; empty tables give an empty table; extra
columns stay behind. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.llm.common import heavy_join, settled, text_slices
from lektra.llm.substrings import mixed

_LETTERS = regex.compile(r"[^\p{L}\p{N}]+")
#: Items of so many words or more are cut into blocks of BLOCK words or more, of fewer than twice as many.
LONG, BLOCK = 48, 24
#: What a window size may need more than the settings: (steps sampled less, times as many walks), the cheaper first.
PLANS = ((0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4), (3, 4))
MOST_TABLES = 64
#: By so much the recall measured for a plan has to be above the target, as it is an estimate.
MARGIN = 0.02
WORD_BITS, PIECE_BITS = 20, 22
#: Bits of the bitmap of table keys: one in 1024 of them is set, as far as the most goes.
LEAST_KEY_BITS, MOST_KEY_BITS = 22, 26
#: Bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 16_000_000
#: Cells of the tables of edit distances that a task computes at once.
CELLS = 4_000_000


@dataclass(frozen=True)
class Settings:
    """``tolerance``: edits for each word of an item. ``sampled``: steps that a table samples. ``walks`` share tables.

    Sizes that miss the recall with these sample fewer steps of more walks.
    """

    tolerance: float = 0.2
    recall: float = 0.95
    sampled: int = 4
    walks: int = 4
    seed: int = 7

    def edits(self, words: int) -> int:
        return int(self.tolerance * words + 1e-9)

    def piece(self, words: int) -> int:
        """Words of each of the pieces of an item, one more than edits, so that edits leave one of them whole."""
        return words // (self.edits(words) + 1)


class _WordCodes(dict):
    """The code of a word as it stands in a text; 0 for one without letters and digits."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        plain = word.lower() if word.isalnum() else _LETTERS.sub("", word.lower())
        value = self[word] = (xxhash.xxh3_64_intdigest(plain) | 1) if plain else 0
        return value


_CODES = _WordCodes()


def codes_of(text: str | None) -> np.ndarray:
    words = (text or "").split()
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    return codes[codes != 0]


def cuts_of(words: int) -> list[int]:
    """Where the blocks of an item begin, and its end."""
    blocks = words // BLOCK if words >= LONG else 1
    return [words * i // blocks for i in range(blocks + 1)]


class Walks:
    """The random functions of all walks, and the steps that each table samples, for one window size."""

    def __init__(self, size: int, settings: Settings, tables: int, back: bool = False):
        rng = np.random.default_rng([settings.seed, size, back])
        self.size, self.steps = size, max(2 * size, 1)
        self.turns = rng.integers(0, 2**64, (settings.walks, self.steps), dtype=np.uint64) | np.uint64(1)
        self.tables = []
        for table in range(tables):
            sampled = min(settings.sampled, self.size)
            # from the first steps, which read a third of the window: what a walk emits late depends on all before it, and the other tables come from its other end
            self.tables.append((table % settings.walks, np.sort(rng.choice(max(self.size * 2 // 3, sampled), sampled, replace=False)), rng.integers(0, 2**64, dtype=np.uint64)))

        at_step: dict[int, list[tuple[int, int]]] = {}
        for table, (walk, steps, _) in enumerate(self.tables):
            for step in steps.tolist():
                at_step.setdefault(step, []).append((table, walk))
        self.sampling = {step: tuple(np.array(x) for x in zip(*uses)) for step, uses in at_step.items()}
        self.last = max(self.sampling, default=-1)

    def keys(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each start, the key of each table; ``codes`` goes on for a window's size after each start."""
        salts = np.array([salt for _, _, salt in self.tables], np.uint64) + np.uint64(self.size)
        out = np.repeat(salts[:, None], len(starts), axis=1)
        at, ends = np.repeat(starts[None, :], len(self.turns), axis=0), starts + self.size
        for step in range(self.last + 1):  # all walks at once
            inside = at < ends
            here = np.where(inside, codes[np.minimum(at, len(codes) - 1)], np.uint64(0))
            if step in self.sampling:
                tables, walks = self.sampling[step]
                out[tables] = mixed(out[tables] ^ here[walks])
            at += (mixed(here * self.turns[:, step : step + 1]) >> np.uint64(63)).astype(np.int64) & inside
        return out.T


def worst_copies(size: int, edits: int, trials: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind and place of edits: random items, and windows of texts that hold a copy, from its first word on and from its last one back."""
    fresh = lambda n: rng.integers(2**63, 2**64, n, dtype=np.uint64).tolist()
    for kind in ("substitution", "insertion", "deletion"):
        for reach in {size, max((size + 1) // 2, min(edits, size))}:
            items, ahead, behind = [], [], []
            for _ in range(trials):
                item = rng.integers(1, 2**63, size, dtype=np.uint64)
                copy = item.tolist()
                places = np.sort(rng.choice(reach, edits, replace=kind == "insertion"))[::-1].tolist()
                for at in places:
                    copy[at : at + (kind != "insertion")] = [] if kind == "deletion" else fresh(1)
                own = np.flatnonzero(np.array(copy, np.uint64) < 2**63)
                copy = copy[own[0] : own[-1] + 1] if len(own) else []  # a window starts, and ends, with a word of the item
                items.append(item)
                ahead.append(np.array([*copy, *fresh(size)], np.uint64)[:size])
                behind.append(np.array([*copy[::-1], *fresh(size)], np.uint64)[:size])
            yield np.stack(items), np.stack(ahead), np.stack(behind)


@cache
def plan_for(settings: Settings, size: int, trials: int = 250) -> tuple[Settings, int]:
    """The settings, and tables in each direction, that reach the recall for random windows of ``size`` words at the distance limit."""
    rng = np.random.default_rng([settings.seed, size])
    cells = list(worst_copies(size, settings.edits(size), trials, rng))
    starts = np.arange(trials * len(cells)) * size
    items, ahead, behind = (np.concatenate([c[k].ravel() for c in cells]) for k in range(3))
    reversed_items = np.concatenate([c[0][:, ::-1].ravel() for c in cells])
    goal = min(settings.recall + MARGIN, (1 + settings.recall) / 2)
    for fewer, times in PLANS:
        plan = replace(settings, sampled=max(1, settings.sampled - fewer), walks=settings.walks * times)
        forth, back = Walks(size, plan, MOST_TABLES), Walks(size, plan, MOST_TABLES, back=True)
        same = (forth.keys(items, starts) == forth.keys(ahead, starts)) | (back.keys(reversed_items, starts) == back.keys(behind, starts))
        found = np.logical_or.accumulate(same, 1).reshape(len(cells), trials, -1).mean(1).min(0)  # of the worst cell, by tables
        reached = np.flatnonzero(found >= goal)
        if len(reached):
            return plan, max(3, int(reached[0]) + 1)
    raise ValueError(f"no plan reaches a recall of {settings.recall} for windows of {size} words and {settings.edits(size)} edits")


def edit_distances(items: list[np.ndarray], texts: list[np.ndarray], limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair: the least edit distance between the item and a beginning of the text, and its length.

    All pairs at once, by rows of the usual table; a value beyond the limit is only known to be beyond it.
    """
    n, rows, columns = len(items), max(map(len, items)), max(map(len, texts))
    item, text = np.zeros((n, rows), np.uint64), np.full((n, columns), 1 << 1, np.uint64)  # 2 is no word's code
    sizes, lengths = np.array([len(x) for x in items]), np.array([len(x) for x in texts])
    for i, (a, b) in enumerate(zip(items, texts)):
        item[i, : len(a)], text[i, : len(b)] = a, b
    places = np.arange(columns + 1)
    row = np.tile(places, (n, 1)).astype(np.int32)
    final = np.where((sizes == 0)[:, None], row, 0).astype(np.int32)
    for r in range(rows):
        step = np.minimum(row[:, :-1] + (text != item[:, r : r + 1]), row[:, 1:] + 1)
        step = np.concatenate((row[:, :1] + 1, step), 1)
        row = (np.minimum.accumulate(step - places, axis=1) + places).astype(np.int32)  # insertions
        ended = sizes == r + 1
        final[ended] = row[ended]
    final[places[None, :] > lengths[:, None]] = np.iinfo(np.int32).max
    best = final.argmin(1)
    return final[np.arange(n), best], best


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, words) of the place in a text where the item costs fewest edits; of equal ones the first to start, then the shortest."""
    places, big = np.arange(len(text) + 1, dtype=np.int64), np.int64(1 << 32)
    row = places.copy()  # edits times big plus start
    for code in item:
        step = np.append(row[0] + big, np.minimum(row[:-1] + (text != code) * big, row[1:] + big))
        row = np.minimum.accumulate(step - places * big) + places * big
    at = int(row.argmin())
    edits, start = divmod(int(row[at]), int(big))
    return edits, start, at - start


def pieces_of(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each place on; as long as ``codes``, whose end is padded."""
    total = np.full(len(codes), width, np.uint64)
    padded = np.append(codes, np.zeros(width, np.uint64))
    for k in range(width):
        total = mixed(total ^ padded[k : k + len(codes)])
    return total


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """From the longs of a column ``x``: which values of their first ``bits`` bits occur, in 2 ** bits bits of bytes. The driver gets as many bits at most."""
    first = F.shiftrightunsigned("x", 64 - bits)
    words = values.groupBy(F.shiftrightunsigned(first, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(x, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes' first bits a bitmap has."""
    bits = int(np.log2(len(known))) + 3
    at = codes >> np.uint64(64 - bits)
    return known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def item_codes(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, codes) of each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            found = [codes_of(x) for x in part.column(1).to_pylist()]
            some = [i for i, c in enumerate(found) if len(c)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some, pa.int64())), pa.array([found[i].view(np.int64) for i in some], pa.list_(pa.int64()))], names=["item_id", "codes"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    return benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`")).mapInArrow(run, f"item_id {kind}, codes array<long>")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A settled table, marked for broadcast if its rows of about ``row_bytes`` are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def batches_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes make up ``most`` at most, or are one row."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def words_as(column: pa.Array) -> list[np.ndarray]:
    """The lists of longs of a column as arrays of codes."""
    return [np.array(x, np.int64).view(np.uint64) for x in column.to_pylist()]


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_a, text_b, item_id, start, words, edits, item_words): the best place of each item in each text.

    ``start`` counts the words that have letters or digits, from 0; ``text_a`` and ``text_b`` are xxhash64 of the text
    with no and with one more argument, by which rows can be told apart where ids can't.
    """
    spark = docs.sparkSession
    items = settled(item_codes(benchmark))
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, len(c), c[a:b]) for i, c in enumerate(words_as(batch.column(1))) for a, b in zip(cuts_of(len(c))[:-1], cuts_of(len(c))[1:])]
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
            hashes = pa.array([xxhash.xxh3_64_intdigest(r[3].tobytes()) - 2**63 for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *numbers, hashes, pa.array([r[3].view(np.int64) for r in rows], pa.list_(pa.int64()))], names=["item_id", "offset", "item_words", "block", "codes"])

    uses = settled(items.mapInArrow(cut, f"item_id {kind}, offset long, item_words long, block long, codes array<long>"))
    blocks = settled(uses.groupBy("block").agg(F.first("codes").alias("codes")))
    sizes = sorted(r.n for r in blocks.select(F.size("codes").alias("n")).distinct().collect())  # fewer than LONG
    reach = max(sizes, default=1) + settings.edits(max(sizes, default=1))
    plans = {n: plan_for(settings, n) for n in sizes}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[int, tuple[Walks, Walks]] = {}
        for batch in batches:
            keys, pieces = [], []
            for codes in words_as(batch.column(1)):
                n = len(codes)
                walks[n] = walks.get(n) or (Walks(n, *plans[n]), Walks(n, *plans[n], back=True))
                keys.append(np.unique(np.concatenate([w.keys(c, np.zeros(1, np.int64))[0].view(np.int64) for w, c in zip(walks[n], (codes, codes[::-1].copy()))])))
                width = settings.piece(n)
                pieces.append(pieces_of(codes, width)[: (settings.edits(n) + 1) * width : width].view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64())), pa.array(pieces, pa.list_(pa.int64()))], names=["block", "codes", "keys", "pieces"])

    signed = settled(blocks.mapInArrow(sign, "block long, codes array<long>, keys array<long>, pieces array<long>"))
    keys = settled(signed.select("block", F.explode("keys").alias("key")))
    key_bits = min(max(int(np.ceil(np.log2(1024 * keys.count() + 1))), LEAST_KEY_BITS), MOST_KEY_BITS)
    maps = [bitmap(signed.select(F.explode(c).alias("x")), n) for c, n in (("codes", WORD_BITS), ("pieces", PIECE_BITS))]
    shared = spark.sparkContext.broadcast([*maps, bitmap(keys.select(F.col("key").alias("x")), key_bits)])  # of bounded sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known_pieces, known = shared.value
        walks = {(n, back): Walks(n, *plans[n], back=back) for n in sizes for back in (False, True)}
        gap = np.zeros(reach, np.uint64)
        for part in text_slices(batches, 3):
            found = [codes_of(x) for x in part.column(3).to_pylist()]
            codes = np.concatenate([gap, *(x for f in found for x in (f, gap))])
            begins = reach + np.cumsum([0, *(len(f) + reach for f in found)])[:-1]
            met = among(codes, vocabulary) & (codes != 0)
            pieces = {width: among(pieces_of(codes, width), known_pieces) for width in {settings.piece(n) for n in sizes}}
            hits: dict[tuple[int, bool], list[int]] = {}
            for back in (False, True):
                way = slice(None, None, -1 if back else 1)
                said, count, first = codes[way].copy(), np.append(0, np.cumsum(met[way])), np.flatnonzero(met[way])
                # a piece from p on ends at p + width - 1, where it begins the other way round
                flags = {width: np.append(known_at[: len(known_at) - width + 1][::-1], np.zeros(width - 1, bool)) if back else known_at for width, known_at in pieces.items()}
                whole = {width: np.append(0, np.cumsum(here)) for width, here in flags.items()}
                some = np.append(0, np.cumsum(np.logical_or.reduce([*flags.values(), np.zeros(len(codes), bool)])))
                first = first[some[np.minimum(first + reach, len(codes))] > some[first]]  # a piece of any width before the largest window ends
                for n in sizes:
                    off, width = settings.edits(n), settings.piece(n)
                    ends = np.minimum(first + n + off, len(codes))
                    near = whole[width][np.maximum(ends - width + 1, first)] > whole[width][first]
                    starts = first[near][count[ends[near]] - count[first[near]] >= n - off]
                    for begin in range(0, len(starts), 100_000):
                        some = starts[begin : begin + 100_000]
                        made = walks[n, back].keys(said, some)
                        at, table = np.nonzero(among(made, known))
                        for start, key in zip((len(codes) - 1 - some[at] if back else some[at]).tolist(), made[at, table].view(np.int64).tolist()):
                            hits.setdefault((start, back), []).append(key)
            order = sorted(hits)
            places = np.array([p for p, _ in order], np.int64)
            doc = np.searchsorted(begins, places, side="right") - 1
            took = pa.array(doc, pa.int64())
            windows = [codes[p - reach + 1 : p + 1][::-1] if back else codes[p : p + reach] for p, back in order]  # a gap is as long
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(took), part.column(1).take(took), part.column(2).take(took), pa.array(places - begins[doc] if order else [], pa.int64()), pa.array([back for _, back in order], pa.bool_()),
                 pa.array([w[w != 0].view(np.int64) for w in windows], pa.list_(pa.int64())), pa.array([sorted(set(hits[s])) for s in order], pa.list_(pa.int64()))],
                names=["doc_id", "text_a", "text_b", "start", "back", "window", "keys"],
            )

    of = docs.schema[id_col].dataType.simpleString()
    text = ("doc_id", "text_a", "text_b")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("text_a"), F.xxhash64(f"`{text_col}`", F.lit(1)).alias("text_b"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(run, f"doc_id {of}, text_a long, text_b long, start long, back boolean, window array<long>, keys array<long>")
    # windows of the same words are compared once; one that is read backwards starts at its last word
    starts = settled(found.withColumn("words", F.xxhash64("window", "back")))
    met = starts.select("words", F.explode("keys").alias("key")).distinct().join(small(keys, 24), "key").select("words", "block").distinct()
    windows = settled(starts.groupBy("words").agg(F.first("window").alias("window"), F.first("back").alias("back"), F.count("*").alias("places")))
    candidates = met.join(windows.drop("places"), "words").join(small(blocks, 16 + 8 * LONG), "block")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // (reach * LONG))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                wanted = [c[::-1] if back else c for c, back in zip(words_as(part.column("codes")), part.column("back").to_pylist())]
                texts = [x[: len(w) + settings.edits(len(w))] for x, w in zip(words_as(part.column("window")), wanted)]
                limits = np.array([settings.edits(len(w)) for w in wanted])
                edits, words = edit_distances(wanted, texts, limits)
                good = np.flatnonzero(edits <= limits)
                took = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("words").take(took), part.column("block").take(took), pa.array(words[good].astype(np.int64)), pa.array(edits[good].astype(np.int64))], names=["words", "block", "n", "edits"])

    sure = candidates.mapInArrow(verify, "words long, block long, n long, edits long")
    sure = settled(sure.join(windows.select("words", "places"), "words"))  # a row for each block that a window matches, of which there are few
    met_places = heavy_join(starts.select(*text, "start", "back", "words"), sure, "words", starts.count(), "places")
    met_places = met_places.withColumn("start", F.when(F.col("back"), F.greatest(F.col("start") - F.col("n") + 1, F.lit(0))).otherwise(F.col("start")))
    placed = settled(met_places.join(small(uses.drop("codes"), 64), "block"))
    short = placed.filter(F.col("item_words") < LONG).select(*text, "item_id", "start", F.col("n").alias("words"), "edits", "item_words")

    # long items: around the diagonals of their blocks, as many as the edits that they may have are one region
    limit = F.floor(F.col("item_words") * settings.tolerance + 1e-9)
    regions = placed.filter(F.col("item_words") >= LONG).withColumn("region", F.floor((F.col("start") - F.col("offset")) / (limit + 1))).select(*text, "item_id", "item_words", "region").distinct()
    regions = regions.select(*text, "item_id", F.greatest(F.col("region") * (limit + 1) - limit, F.lit(0)).alias("begin"), ((F.col("region") + 1) * (limit + 1) + F.col("item_words") + limit).alias("end"))
    asked = regions.groupBy(*text).agg(F.collect_set(F.struct("item_id", "begin", "end")).alias("asked"))  # of one text

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = codes_of(batch.column(3)[i].as_py())
                for want in batch.column(4)[i]:
                    here = codes[want["begin"].as_py() : want["end"].as_py()]
                    head = [batch.column(c).slice(i, 1) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array([want["item_id"].as_py()], want["item_id"].type), pa.array([want["begin"].as_py()], pa.int64()), pa.array([here.view(np.int64)], pa.list_(pa.int64()))], names=[*text, "item_id", "begin", "here"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (item,), (here,) = (words_as(batch.column(c).slice(i, 1)) for c in ("codes", "here"))
                edits, start, words = best_place(item, here)
                if edits <= settings.edits(len(item)):
                    values = [start + batch.column("begin")[i].as_py(), words, edits, len(item)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in (*text, "item_id")), *(pa.array([v], pa.int64()) for v in values)], names=[*text, "item_id", "start", "words", "edits", "item_words"])

    same = [rows[c].eqNullSafe(asked[c]) for c in text]
    there = rows.join(asked, same[0] & same[1] & same[2]).select(*(rows[c] for c in text), "text", "asked").dropDuplicates(text)
    pieces = there.mapInArrow(cut_out, f"doc_id {of}, text_a long, text_b long, item_id {kind}, begin long, here array<long>")
    whole = pieces.join(items.withColumnRenamed("item_id", "own_id"), F.col("item_id").eqNullSafe(F.col("own_id")))
    schema = f"doc_id {of}, text_a long, text_b long, item_id {kind}, start long, words long, edits long, item_words long"
    long = whole.mapInArrow(align, schema) if placed.filter(F.col("item_words") >= LONG).limit(1).count() else spark.createDataFrame([], schema)
    best = F.min(F.struct("edits", "start", "words", "item_words")).alias("best")
    return short.union(long).groupBy(*text, "item_id").agg(best).select(*text, "item_id", "best.start", "best.words", "best.edits", "best.item_words")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose text matches no item; columns of any names stay as they are."""
    own = [f"__own_{i}" for i in range(len(docs.columns))]
    moved, text = docs.toDF(*own), own[docs.columns.index("text")]
    found = matches(docs, benchmark, settings).select("text_a", "text_b").distinct()
    keys = moved.withColumns({"text_a": F.xxhash64(text), "text_b": F.xxhash64(text, F.lit(1))})
    return keys.join(found, ["text_a", "text_b"], "left_anti").select(*(F.col(x).alias(c) for x, c in zip(own, docs.columns)))

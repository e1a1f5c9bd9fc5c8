"""Operator 13: what each filter removes under every order of the filters, by first-failure lookup.

Each document has a mask of the filters that it fails. A table says, for each mask and each order of the filters, at which
step the document goes first. ``mapInArrow`` looks up the masks of its rows, ``np.bincount`` adds them up by part, order and
step, for all documents and for those with a label, and the arrays of the tasks are summed in Spark. Four filters look at
the text alone; the fifth fails a text that stands under a smaller id. Of each distinct text only the rows of its least
id pass the fifth, so all rows count as failing it at first, and one corrective row for each distinct text follows: no
group of copies meets in one task, and none is joined. Texts are compared by 128 bits of BLAKE2b; at 10^11 documents two
different ones meet with a chance below 10^-16.

Defined results: a null text is the empty text, a null part the empty string; rows with equal ids and texts are copies of one
document and pass or fail together; null ids stand after all others and equal each other; a document has a label if any of its
rows in ``labels`` has it, null ids have none; no documents give no rows; extra columns stay behind. Texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektra.llm.common import text_slices, written

_CAPITALS, _SYMBOLS, _FOLLOWING = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def few_words(raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def few_distinct(raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def many_capitals(raw: bytes, words: list[bytes]) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 2 * len(raw.translate(None, _FOLLOWING))


def has_symbol(raw: bytes, words: list[bytes]) -> bool:
    return len(raw.translate(None, _SYMBOLS)) < len(raw)


#: The filters of single texts, by letter; each gets the UTF-8 bytes and their words (white space U+0009 to U+000D and the blank).
FILTERS = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": has_symbol}
#: The filter of later copies, which comes last in a mask.
COPIES = "E"
#: Parts that a task keeps arrays for before it passes them on.
PARTS_HELD = 500


def orders_of(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def first_failures(letters: str) -> np.ndarray:
    """For each mask (bit i: the filter ``letters[i]`` fails) and order, the step of the first failure, from 0; none: the number of filters."""
    n = len(letters)
    table = np.full((1 << n, len(orders_of(letters))), n, np.int64)
    for column, order in enumerate(orders_of(letters)):
        for step in reversed(range(n)):
            fails = np.arange(1 << n) >> letters.index(order[step]) & 1 == 1
            table[fails, column] = step
    return table


def facts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict = FILTERS) -> DataFrame:
    """(id, part, text_key binary, mask int) of each row: bits of the filters that its text alone fails, in the order of ``filters``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2):
            masks, keys = [], []
            for raw in part.column(2).cast(pa.binary()).to_pylist():
                words = raw.split()  # bytes are cut at ASCII white space only
                masks.append(sum(fails(raw, words) << i for i, fails in enumerate(filters.values())))
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())], names=["id", "part", "text_key", "mask"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, text_key binary, mask int")


def labelled(rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """The rows of ``facts`` with booleans good and toxic. Rows without an id have no label and are dealt by their text instead."""
    good, toxic = (F.col("quality") == 1 if good is None else good), (F.col("toxic") == 1 if toxic is None else toxic)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("good"), F.coalesce(F.bool_or(toxic), F.lit(False)).alias("toxic"))
    deal = F.when(F.col("id").isNull(), F.xxhash64("text_key").bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    joined = rows.join(known.withColumn("no_deal", F.lit(0).cast("long")), F.col("id").eqNullSafe(F.col("label_id")) & (deal == F.col("no_deal")), "left")
    return joined.select("id", "part", "text_key", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def masked(rows: DataFrame, copies: int) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): how many rows fail the filters of ``mask``, ``copies`` (a bit) among them for all but the least id of a text.

    Rows may repeat a part and mask, and those that correct others have negative counts. ``rows`` are read twice, so they are settled before.
    """
    counts = lambda n: (n.alias("n"), F.when(F.col("good"), n).otherwise(0).alias("n_good"), F.when(F.col("toxic"), n).otherwise(0).alias("n_toxic"))
    later = rows.select("part", F.col("mask").bitwiseOR(copies).alias("mask"), *counts(F.lit(1).cast("long")))
    same = rows.groupBy("text_key", "mask", "id", "good", "toxic", "part").agg(F.count("*").alias("n"))
    of_id = same.groupBy("text_key", "mask", "id").agg(F.collect_list(F.struct("part", "good", "toxic", "n")).alias("held"))  # rows of one id and text
    first = of_id.groupBy("text_key", "mask").agg(F.min_by("held", F.struct(F.col("id").isNull(), "id")).alias("held")).select("mask", F.inline("held"))
    right, wrong = first.select("part", "mask", *counts(F.col("n"))), first.select("part", F.col("mask").bitwiseOR(copies).alias("mask"), *counts(-F.col("n")))
    return later.unionByName(right).unionByName(wrong)


def removals(rows: DataFrame, letters: str) -> DataFrame:
    """(part, place int, and sums by part, order and step) from rows of ``masked``.

    ``place`` is the number of the order times the number of steps, plus the step, both from 0. Sums: removed, good_lost and toxic_lost at this
    step; fails and unique_fails of its filter, and documents, of the part.
    """
    table, orders, n = first_failures(letters), orders_of(letters), len(letters)
    filter_at = np.array([[letters.index(x) for x in order] for order in orders])
    bit = 1 << filter_at
    masks = np.arange(1 << n)
    names = ["removed", "good_lost", "toxic_lost", "fails", "unique_fails", "documents"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def passed() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string())]
            for i in range(len(names)):
                columns.append(pa.array([x[i].ravel().tolist() for x in held.values()], pa.list_(pa.int64())))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", *names])

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            of, mask = parts.indices.to_numpy(), batch.column(1).to_numpy()
            pairs, at = np.unique(of * len(masks) + mask, return_inverse=True)
            weights = [np.bincount(at, batch.column(2 + i).to_numpy()) for i in range(3)]  # all, good, toxic
            of, mask = np.divmod(pairs, len(masks))
            step = table[mask]  # a row for each part and mask of the batch, a column for each order
            code = ((of[:, None] * len(orders) + np.arange(len(orders))) * (n + 1) + step).ravel()
            size = len(parts.dictionary) * len(orders) * (n + 1)
            lost = [np.bincount(code, np.repeat(w, len(orders)), size).reshape(-1, len(orders), n + 1)[:, :, :n] for w in weights]
            by_mask = np.bincount(pairs, weights[0], len(parts.dictionary) * len(masks)).reshape(-1, len(masks))
            for i, name in enumerate(parts.dictionary.to_pylist()):
                fails = np.array([by_mask[i][masks >> f & 1 == 1].sum() for f in range(n)])
                here = np.stack([*(x[i] for x in lost), fails[filter_at], by_mask[i][bit], np.full(bit.shape, by_mask[i].sum())]).astype(np.int64)
                held[name] = held[name] + here if name in held else here
            if len(held) >= PARTS_HELD:
                yield passed()
        if held:
            yield passed()

    partial = rows.select("part", "mask", "n", "n_good", "n_toxic").mapInArrow(run, "part string, " + ", ".join(f"{x} array<long>" for x in names))
    opened = partial.select("part", F.posexplode(F.arrays_zip(*names)).alias("place", "sums"))
    return opened.groupBy("part", "place").agg(*(F.sum(f"sums.{x}").alias(x) for x in names))


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, as the contract of operator 13 has it."""
    letters = "".join(filters) + COPIES
    n, orders = len(letters), orders_of(letters)
    rows = written(labelled(facts(docs, id_col=id_col, text_col=text_col, part_col=part_col, filters=filters), labels, id_col=id_col), "filter-masks")
    sums = removals(masked(rows, 1 << len(filters)), letters)
    order = F.element_at(F.array(*map(F.lit, orders)), (F.floor(F.col("place") / n) + 1).cast("int"))
    step = (F.col("place") % n + 1).cast("int")
    named = sums.select("part", order.alias("filter_order"), step.alias("step"), *sums.columns[2:]).withColumn("letter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    before = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as filters
    of_filter = Window.partitionBy("part", "letter")  # as many rows as orders
    return named.select(
        "part", "filter_order", "step", (F.col("documents") - F.sum("removed").over(before)).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(of_filter).alias("shapley"),
    )

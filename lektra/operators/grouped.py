"""Operators that go through a group in order, one group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batches(changes: DataFrame, *, most_rows: int = 500, most_bytes: int = 8 << 20) -> DataFrame:
    """(device, seq, batch): greedy batches of a device's changes in order; one that is too large alone gets batch -1.

    A device's changes come through one task in Arrow batches, of which only the open batch's number, rows and bytes are carried.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = batch = n = size = None
        for part in parts:
            out = []
            for device, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if batch is None or device != at:
                    at, batch, n, size = device, 0, 0, 0
                if own > most_bytes:
                    out.append(-1)
                    continue
                if n and (n >= most_rows or size + own > most_bytes):
                    batch, n, size = batch + 1, 0, 0
                n, size = n + 1, size + own
                out.append(batch)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int32())], names=["device", "seq", "batch"])

    ordered = changes.select("device", "seq", "bytes").repartition("device").sortWithinPartitions("device", "seq")
    return ordered.mapInArrow(run, "device long, seq long, batch int")


def columns_of(lines: list[tuple], reach: float) -> list[list[tuple]]:
    """Lines (x, y, line) in columns from the left, each from the top; a column's place is the upper median of its lines' left edges.

    A line joins the nearest column within reach. Columns nearer than four fifths of it are one. Columns of fewer than four
    lines, or of a twelfth of all, are noise and go to the nearest other one, if there is any. Lines come by their left edge, so the
    newest column is always the nearest, and the lines of each stay in order.
    """
    place = lambda column: column[len(column) // 2][0]
    found: list[list[tuple]] = []
    for line in sorted(lines):
        if found and line[0] - place(found[-1]) <= reach:
            found[-1].append(line)
        else:
            found.append([line])
    joined: list[list[tuple]] = []
    for column in found:
        if joined and place(column) - place(joined[-1]) <= 0.8 * reach:
            joined[-1] += column
        else:
            joined.append(column)
    least = max(4, -(-8 * len(lines) // 100))
    large = [c for c in joined if len(c) >= least]
    if large:
        places = [place(c) for c in large]
        for column in joined:
            if len(column) < least:
                at = place(column)
                large[min(range(len(large)), key=lambda i: abs(places[i] - at))].extend(column)
        joined = sorted((sorted(c) for c in large), key=place)
    return [sorted(c, key=lambda line: (line[1], line[0], line[2])) for c in joined]


def order_of(page: pd.DataFrame) -> list[int]:
    """The reading order of a page's lines: wide lines near the top, then columns from the left, each downwards."""
    return order_of_lines(list(zip(*(page[c].tolist() for c in ("x", "y", "line", "width", "height")))))


def order_of_lines(lines: list[tuple]) -> list[int]:
    """The reading order of a page's lines (x, y, line, width, height)."""
    left, top = min(x for x, *_ in lines), min(y for _, y, *_ in lines)
    wide, high = max(x + width for x, _, _, width, _ in lines) - left, max(y + height for _, y, _, _, height in lines) - top
    first, rest = [], []
    for x, y, line, width, _ in lines:
        if y - top <= 0.22 * high and width >= 0.58 * wide:
            first.append((y, x, line))
        else:
            rest.append((x, y, line))
    reach = max(2.5 * sorted(height for *_, height in lines)[len(lines) // 2], 0.04 * wide)
    return [line for _, _, line in sorted(first)] + [line for column in columns_of(rest, reach) for _, _, line in column]


def reading_order(lines: DataFrame) -> DataFrame:
    """(page, line, place): lines are (page, line, x, y, width, height); a missing number counts as 0.

    A task goes through its pages in Arrow batches, of which the lines of the open page alone are carried.
    """

    def ordered(page: int | None, held: list[tuple]) -> tuple[list, list, list]:
        order = order_of_lines(held)
        return [page] * len(order), order, list(range(len(order)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for part in parts:
            out: tuple[list, list, list] = [], [], []
            rows = list(zip(*(c.to_pylist() for c in part.columns[1:])))
            for page, line in zip(part.column(0).to_pylist(), rows):
                if page != at and held:
                    for all_, own in zip(out, ordered(at, held)):
                        all_ += own
                    held = []
                at = page
                held.append(line)
            yield batch_of(out)
        if held:
            yield batch_of(ordered(at, held))

    def batch_of(out: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int32()))], names=["page", "line", "place"])

    number = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    needed = lines.select(F.col("page").cast("long").alias("page"), number("x", "double"), number("y", "double"), number("line", "int"), number("width", "double"), number("height", "double"))
    return needed.repartition("page").sortWithinPartitions("page").mapInArrow(run, "page long, line int, place int")


#: Fixed value: pixels by which regions of one column overlap across; narrower ones by their width.
COLUMN_OVERLAP = 200


def overlap_columns(regions: DataFrame, *, least: int = COLUMN_OVERLAP) -> DataFrame:
    """(page, region, column, place): columns of regions (page, region, x, y, width) that overlap across, found greedily from the left.

    A page's regions come through one task by their left edge in Arrow batches, of which the open page's column ranges alone are carried.
    A region joins the column that it overlaps most, the first of equal ones, and widens it; else it opens a column. Regions without a
    box (x null) are of column 0. ``place`` counts from 0 by column, top edge and region; a null top edge or width counts as 0.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ranges = None, []
        for part in parts:
            out = []
            for page, left, width in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(4).to_pylist()):
                if page != at:
                    at, ranges = page, []
                if left is None:
                    out.append(0)
                    continue
                right = left + width
                shared = [min(right, b) - max(left, a) for a, b in ranges]
                fits = [(-n, i) for i, n in enumerate(shared) if n >= min(least, width) and n > 0]
                column = min(fits)[1] if fits else len(ranges)
                if fits:
                    ranges[column] = (min(ranges[column][0], left), max(ranges[column][1], right))
                else:
                    ranges.append((left, right))
                out.append(column)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], part.column(3), pa.array(out, pa.int32())], names=["page", "region", "y", "column"])

    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    ordered = regions.select("page", "region", F.col("x").cast("long").alias("x"), whole("y"), whole("width")).repartition("page").sortWithinPartitions("page", "x", "region")
    kinds = {f: regions.schema[f].dataType.simpleString() for f in ("page", "region")}
    found = ordered.mapInArrow(run, f"page {kinds['page']}, region {kinds['region']}, y long, column int")
    place = F.row_number().over(Window.partitionBy("page").orderBy("column", "y", "region")) - 1
    return found.select("page", "region", "column", place.cast("long").alias("place"))

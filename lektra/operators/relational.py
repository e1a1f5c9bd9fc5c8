"""Relational operators: functions from DataFrames to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektra.functions.text import ascii_fold
from lektra.operators.settling import settled


#: Rows of both sides that a task of a dealt join sorts, some tens of MB.
TASK_ROWS = 1_000_000


def tasks_for(*counts: int) -> int:
    """Tasks of a join of tables with so many rows."""
    return max(-(-sum(counts) // TASK_ROWS), 1)


def dealt(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows dealt by a key to so many tasks, which Spark doesn't coalesce: keys are compressed so well that their bytes say little of a sort's memory."""
    return rows.repartition(tasks, key) if tasks > 1 else rows


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in an order. One shuffle; the order must tell rows apart."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def non_empty(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias("__k")), F.col(parent_key) == F.col("__k"), "left_semi")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, tasks: int = 1) -> DataFrame:
    """Children whose parent is missing; a null key has none."""
    return deleted(children, parents.select(parent_key), child_key, tasks)


def counted_children(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """A count of each kind of child; each is counted before the join, so rows don't multiply."""
    for name, (child, child_key) in children.items():
        counts = child.groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias(name))
        parents = parents.join(counts, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def any_column_contains(df: DataFrame, text: str) -> DataFrame:
    """Rows of which any column, as text, contains a text; A to Z in either case."""
    wanted = ascii_fold(F.lit(text.strip()))
    return df.filter(reduce(Column.__or__, [F.coalesce(F.contains(ascii_fold(F.col(c).cast("string")), wanted), F.lit(False)) for c in df.columns]))


def browsed(df: DataFrame, *, key: str, sort: str | None = None, direction: str = "asc", page: int = 1, size: int = 25, search: str = "") -> DataFrame:
    """One page of a table: an unknown sort column means the key; the size is held in 1 to 100."""
    rows = any_column_contains(df, search) if search.strip() else df
    column = F.col(sort if sort in df.columns else key)
    size = min(max(size, 1), 100)
    return rows.orderBy(column.desc() if direction.lower() == "desc" else column.asc(), F.col(key)).offset((max(page, 1) - 1) * size).limit(size)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows take the place of old ones with their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def deleted(rows: DataFrame, keys: DataFrame, key: str, tasks: int = 1) -> DataFrame:
    """Rows without those of the keys (one column), by so many tasks if more than one is asked for."""
    gone = keys.select(F.col(keys.columns[0]).alias("__k"))
    if tasks == 1:
        return rows.join(gone, F.col(key) == F.col("__k"), "left_anti")
    keyed = dealt(rows.filter(F.col(key).isNotNull()), key, tasks).join(dealt(gone, "__k", tasks), F.col(key) == F.col("__k"), "left_anti")
    return keyed.unionByName(rows.filter(F.col(key).isNull()))  # which would all go to one task


def cascaded(tables: dict[str, DataFrame], edges: list[tuple[str, str, str, str]], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Delete ``gone`` (a column ``id``) from ``root`` and all that hangs on it.

    ``edges``: (parent, parent key, child, child key), parents before their children; ids stay a plan.
    """
    dead = {root: gone}
    for parent, parent_key, child, child_key in edges:
        if parent not in dead:
            continue
        lost = tables[child].join(dead[parent].select(F.col("id").alias("__k")), F.col(child_key) == F.col("__k"), "left_semi").select("id")
        dead[child] = dead[child].union(lost).distinct() if child in dead else lost
    return {name: deleted(df, dead[name], "id") if name in dead else df for name, df in tables.items()}


def with_shown_order(assets: DataFrame, parent: str = "item_id") -> DataFrame:
    """Assets of a parent in the order they are shown: by sort_index if any is set, then path, then id."""
    of = Window.partitionBy(parent)
    sorted_ = (F.count("*").over(of) > 1) & F.max((F.col("sort_index") != 0).cast("int")).over(of).cast("boolean")
    rows = assets.withColumn("__key", F.when(sorted_, F.col("sort_index")).otherwise(0))
    return rows.withColumn("position", F.row_number().over(of.orderBy("__key", ascii_fold("path"), "id"))).drop("__key")


def placed_in_groups(rows: DataFrame, group: str, row_id: str, *order: str) -> DataFrame:
    """(group, id, place from 1, before, after): each row's place and neighbours in its group, by ascending columns and then the id.

    No group meets in one task: rows are dealt by ranges of group and order, numbered within a range, and take what
    the ranges before hold as an offset; the first and last row of a range get their neighbours from the next one.
    """
    keys = [f"__{i}" for i in range(len(order))]
    named = rows.select(F.col(group).alias("__group"), *(F.col(c).alias(k) for c, k in zip(order, keys)), F.col(row_id).alias("__id"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # settled, as another run of the sampling, after an executor is lost, could draw other ranges
    dealt = settled(named.repartitionByRange(parts, "__group", *keys, "__id").withColumn("__part", F.spark_partition_id()))
    at = F.struct(*keys, "__id")
    ranges = dealt.groupBy("__group", "__part").agg(F.count("*").alias("n"), F.min(at)["__id"].alias("first"), F.max(at)["__id"].alias("last"))
    by_part = Window.partitionBy("__group").orderBy("__part")  # as many rows as ranges at most
    ranges = ranges.select(
        F.col("__group").alias("g"), F.col("__part").alias("p"),
        (F.sum("n").over(by_part) - F.col("n")).alias("offset"), F.lag("last").over(by_part).alias("previous"), F.lead("first").over(by_part).alias("next"),
    )
    inside = Window.partitionBy("__group", "__part").orderBy(*keys, "__id")
    local = dealt.select("__group", "__part", "__id", F.row_number().over(inside).alias("n"), F.lag("__id").over(inside).alias("b"), F.lead("__id").over(inside).alias("a"))
    met = local.join(ranges, F.col("__group").eqNullSafe(F.col("g")) & (F.col("__part") == F.col("p")))
    return met.select(F.col("__group").alias(group), F.col("__id").alias(row_id), (F.col("n") + F.col("offset")).alias("place"), F.coalesce("b", "previous").alias("before"), F.coalesce("a", "next").alias("after"))


def richness(*tables: DataFrame) -> DataFrame:
    """(score): the rows of all tables together."""
    counts = [t.agg(F.count("*").alias("n")) for t in tables]
    return reduce(DataFrame.unionAll, counts).agg(F.sum("n").alias("score"))


def exchanged(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, content) with a question and an answer (conv_id, question, answer) after the last of their conversation."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    at = asked.join(last, "conv_id", "left").withColumn("next", F.coalesce(F.col("last") + 1, F.lit(0)))
    turns = F.array(F.struct(F.col("next").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((F.col("next") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    added = at.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.content")
    return messages.select("conv_id", "turn", "role", "content").unionByName(added)


def inserted(rows: DataFrame, new: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the new ones whose parent is there, the new ones that are refused)."""
    return rows.unionByName(non_empty(new, parents, child_key, parent_key)), orphans(new, parents, child_key, parent_key)


def latest_texts(texts: DataFrame, *of: str) -> DataFrame:
    """(of, text): the newest text (id, text, created_at) of each combination of the columns ``of``; of equally new ones that with the least id."""
    order = F.struct(F.coalesce(F.col("created_at"), F.lit(0)), -F.col("id"))
    return texts.groupBy(*of).agg(F.max_by("text", order).alias("text"))

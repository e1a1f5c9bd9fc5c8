"""Sinks: collections as JSON lines, tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3


def write_collections(items: DataFrame, assets: DataFrame, path: str) -> None:
    """A folder for each collection, a line for each item with its assets in order; large collections become several files."""
    own = assets.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("sort_index", "id", "type", "path", "size"))).alias("assets"))  # of one item
    rows = items.join(own, F.col("id") == F.col("item_id"), "left").drop("item_id")
    rows.withColumn("version", F.lit(VERSION)).write.partitionBy("collection_id").option("maxRecordsPerFile", 1_000_000).json(path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_table(df: DataFrame, path: str) -> None:
    """All rows of a table as CSV, with a head line in each file."""
    df.write.option("header", True).option("maxRecordsPerFile", 1_000_000).csv(path)


def nested(collections: DataFrame, items: DataFrame, path: str, *, version: int = 3, parts: int | None = None) -> None:
    """One JSON document for each collection (id, name), with its items (collection_id, id, document: JSON) in order of their ids, below ``path``.

    Items are dealt by ranges of (collection, id), so a collection of any size is written by as many tasks as it needs; each writes the
    piece that it holds, as lines. The pieces of a collection, put together in the order of their names, are its document: the item with the
    least id brings the head, the one with the greatest the tail, and a collection without items is a piece of its own. An item with a null
    collection or id is left out; a null document is ``null``.
    """
    spark = items.sparkSession
    rows = items.filter("collection_id is not null and id is not null").select("collection_id", "id", F.coalesce("document", F.lit("null")).alias("document"))
    ends = rows.groupBy("collection_id").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    known = collections.select(F.col("id").alias("of"), "name").join(ends, F.col("of") == F.col("collection_id"), "left").drop("collection_id")
    head = F.concat(F.lit(f'{{"version":{version},"collection":'), F.to_json(F.struct(F.col("of").alias("id"), "name"), {"ignoreNullFields": "false"}), F.lit(',"items":['))
    joined = rows.join(known, F.col("collection_id") == F.col("of"))
    line = F.concat(F.when(F.col("id") == F.col("first"), head).otherwise(""), F.col("document"), F.when(F.col("id") == F.col("last"), "]}").otherwise(","))
    empty = known.filter("first is null").select(F.col("of").alias("collection"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.concat(head, F.lit("]}")).alias("value"))
    lines = joined.select(F.col("of").alias("collection"), "id", line.alias("value")).unionByName(empty)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "collection", "id").sortWithinPartitions("collection", "id").select("collection", "value").write.partitionBy("collection").text(path)

"""Connected components of a table of links, by alternating stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.llm.common import HEAVY_KEYS, heavy_join, settled


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b) reaches. Nodes without links aren't in it.

    Each round hangs the greater neighbours of a node on its least neighbour, then the lesser ones, until nothing
    changes; rounds are settled in the shared folder. The number of rounds grows with the logarithm of the nodes.
    Nodes with many links, the hubs of stars, take no part in shuffles by node: their least neighbours are broadcast.
    """
    now = settled(links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root")).union(now.select(F.col("low"), F.col("low"))).groupBy("node").agg(F.min("root").alias("root"))
        before = mark
        kept = settled if 2 * mark[0] > HEAVY_KEYS else lambda df: df  # few rows are made again rather than written
        around = now.select(F.col("high").alias("node"), F.col("low").alias("next")).union(now.select(F.col("low"), F.col("high")))
        least = kept(around.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("least"), F.count("*").alias("n")))
        hung = heavy_join(around, least, "node", 2 * mark[0], "n").filter("next > node")
        large = kept(hung.select(F.col("next").alias("high"), F.col("least").alias("low")).distinct())
        least = kept(large.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("n")))
        lower = heavy_join(large, least, "high", mark[0], "n").filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        now = settled(lower.union(least.select("high", F.col("least").alias("low"))).distinct())

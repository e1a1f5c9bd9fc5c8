"""Search: postings, vector neighbours, rank fusion, budgets and prompts; ranks by BM25 come from the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektra.functions.numbers import cosine
from lektra.functions.text import index_terms

def postings(texts: DataFrame) -> DataFrame:
    """(id, term, tf, length): from rows (id, text)."""
    terms = texts.select("id", index_terms("text").alias("terms")).select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def neighbours(vectors: DataFrame, query: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    """(id, score): the nearest by cosine of one query row (vector); vectors of other lengths or zero are left out."""
    scored = vectors.crossJoin(F.broadcast(query)).select("id", cosine(F.col("vector"), F.col("query")).alias("score"))  # one row
    kept = scored.filter(F.col("score").isNotNull() & ((F.col("score") >= least) if least > 0 else F.lit(True)))
    return kept.orderBy(F.desc("score"), "id").limit(limit)


def without_vector(texts: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """(id): all texts (id, text) that aren't blank and have no row in ``vectors`` (id); the first ``limit`` by id where one is given."""
    rows = texts.filter(F.length(F.trim("text")) > 0).join(vectors.select("id"), "id", "left_anti").select("id")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def fused(*legs: DataFrame, k: int = 60, limit: int = 6) -> DataFrame:
    """(id, score): reciprocal rank fusion of legs (id, place from 1)."""
    rows = legs[0].select("id", "place")
    for leg in legs[1:]:
        rows = rows.unionAll(leg.select("id", "place"))
    return rows.groupBy("id").agg(F.sum(1 / (k + F.col("place"))).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def placed(rows: DataFrame, *order) -> DataFrame:
    """Rows of a bounded leg with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def within_budget(rows: DataFrame, text: str, budget: int, *order) -> DataFrame:
    """Rows of a bounded list while their texts fit; the first is cut to the budget instead of dropped."""
    ordered = Window.orderBy(*order)
    cut = rows.withColumn("n", F.row_number().over(ordered)).withColumn(text, F.when(F.col("n") == 1, F.substring(text, 1, budget)).otherwise(F.col(text)))
    total = F.sum(F.length(text)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    over = cut.withColumn("over", (total > budget).cast("int"))
    return over.withColumn("stopped", F.max("over").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).filter("stopped = 0").drop("over", "stopped")


def history(messages: DataFrame, *, most_turns: int, most_chars: int) -> DataFrame:
    """(conversation_id, history): the last turns that aren't blank, each cut, as lines; no more than ``most_turns`` meet in a row."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("sort_index"))
    last = messages.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= most_turns).filter(F.trim("content") != "")
    who = F.when(F.col("role") == "assistant", "Asistente: ").otherwise("Usuario: ")
    lines = F.array_sort(F.collect_list(F.struct("sort_index", F.concat(who, F.substring(F.trim("content"), 1, most_chars)).alias("line"))))
    return last.groupBy("conversation_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def fragments(sources: DataFrame) -> DataFrame:
    """(of, fragments): numbered sources (of, n, title, collection, snippet), few of each, as a prompt quotes them."""
    said = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] «"), "title", F.lit("» ("), "collection", F.lit("):\n"), "snippet")
    each = F.array_sort(F.collect_list(F.struct("n", said.alias("said"))))
    return sources.groupBy("of").agg(F.array_join(F.transform(each, lambda x: x["said"]), "\n\n").alias("fragments"))


def context(hits: DataFrame, titles: DataFrame, texts: DataFrame, *, items: int, most_chars: int, budget: int) -> DataFrame:
    """(context): one row; the texts of the best items that have a title, each cut, in all at most ``budget`` characters."""
    best = hits.join(titles, "id").orderBy("rank", "id").limit(items).join(texts, "id").filter(F.length("text") > 0)
    said = F.concat(F.lit("--- "), "title", F.lit(" ---\n"), F.substring("text", 1, most_chars), F.lit("\n\n"))
    each = F.array_sort(F.collect_list(F.struct("rank", "id", said.alias("said"))))  # as many as ``items``
    return best.agg(F.substring(F.array_join(F.transform(each, lambda x: x["said"]), ""), 1, budget).alias("context"))

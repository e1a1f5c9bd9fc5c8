"""A stored inverted index: blocks of postings with their maxima, in slices by a hash of the id, sorted by term.

A search reads the blocks of the asked terms alone, and scores them where they lie: in each slice the ranges between block
borders are taken in descending order of what their maxima allow, until that can't reach the worst of the best ``limit``
any more. The best of all slices are then ordered. The number of slices follows from the bytes of the texts, so a term that
every text has is spread over all of them.

Statistics are kept as rows that add up: documents and words, and for each term how many texts have it. A text that is
indexed anew gets a higher generation, and rows that take its old share out of the statistics; postings of lesser generations of its id no longer count.

Defined results: a null text has no terms but counts as a document; of rows with one id in a call the last by text counts; rows without an
id are left out; asked terms that no text has are found in none; an empty index gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.functions.text import index_terms

K1, B = 1.2, 0.75
#: Bytes of texts in a slice, and postings in a block.
SLICE_BYTES, BLOCK = 8 << 20, 128
#: Of these the small row groups of the files consist, so that few others lie beside an asked term.
GROUP_BYTES = 1 << 20
#: Rows of blocks; those without a term hold the ids and lengths of all texts of their slice.
_ROWS = "slice int, term string, block int, ids array<long>, tfs array<int>, lengths array<int>, n int, most int, least int"
_ARROW = pa.schema([("slice", pa.int32()), ("term", pa.string()), ("block", pa.int32()), *((c, pa.list_(k)) for c, k in (("ids", pa.int64()), ("tfs", pa.int32()), ("lengths", pa.int32()))), *((c, pa.int32()) for c in ("n", "most", "least"))])


def _slice(n: int):
    return F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(n)).cast("int")


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each slice together, where batches are sorted by their first column."""
    held, now = [], None
    for batch in batches:
        cuts = np.flatnonzero(np.append(True, np.diff(batch.column(0).to_numpy()) != 0)).tolist() if batch.num_rows else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            at = batch.column(0)[a].as_py()
            if at != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = at
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _blocks_of(rows: pa.Table, size: int) -> pa.RecordBatch:
    """The blocks of a slice by term, from rows (slice, id, terms) by id, of which the first of each id counts."""
    at, ids = rows.column("slice")[0].as_py(), rows.column("id").to_numpy()
    rows = rows.filter(pa.array(np.append(True, ids[1:] != ids[:-1])))
    ids, lists = rows.column("id").to_numpy(), rows.column("terms")
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int32)
    words = pc.list_flatten(lists).combine_chunks().dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    codes = np.empty(len(order), np.int64)
    codes[order] = np.arange(len(order))
    places, tf = np.unique(codes[words.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, text = np.divmod(places, len(ids))  # by term, then by id
    within = np.arange(len(term)) - np.searchsorted(term, term)
    begins = np.flatnonzero(within % size == 0)
    every = np.arange(0, len(ids), size)
    ends = np.concatenate([every, len(ids) + begins, [len(ids) + len(term)]]).astype(np.int32)
    listed = lambda texts, terms, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([texts, terms]), kind))
    whole = lambda texts, terms: pa.array(np.concatenate([texts, terms]), pa.int32())
    names = words.dictionary.take(pa.array(order[term[begins]])).cast(pa.string())
    zero, own = np.zeros(len(every), np.int32), lengths[text]
    best = (np.maximum.reduceat(tf, begins), np.minimum.reduceat(own, begins)) if len(begins) else (tf, own)
    columns = [
        pa.array(np.full(len(ends) - 1, at), pa.int32()), pa.concat_arrays([pa.nulls(len(every), pa.string()), names]), whole(np.arange(len(every)), within[begins] // size),
        listed(ids, ids[text], pa.int64()), listed(np.zeros(len(ids), np.int32), tf, pa.int32()), listed(lengths, own, pa.int32()), pa.array(np.diff(ends), pa.int32()), whole(zero, best[0]), whole(zero, best[1]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _append(texts: DataFrame, path: str, generation: int, slices: int) -> None:
    """Texts move once, to their slices, and the blocks of a slice are made where they lie; all else is read from the blocks."""
    spark, size = texts.sparkSession, BLOCK
    dealt = texts.filter("id is not null").select(_slice(slices).alias("slice"), F.col("id").cast("long").alias("id"), "text").repartition(slices, "slice")
    last_first = dealt.sortWithinPartitions("slice", "id", F.desc_nulls_last("text"))
    terms = last_first.select("slice", "id", F.coalesce(index_terms("text"), F.array().cast("array<string>")).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_slice(batches):
            yield _blocks_of(rows, size)

    made = f"{path}/blocks/generation={generation}"
    terms.mapInArrow(run, _ROWS).write.option("parquet.block.size", GROUP_BYTES).parquet(made)
    blocks = spark.read.parquet(made)
    blocks.filter("term is null").select(F.inline(F.arrays_zip("ids", "lengths"))).select(F.col("ids").alias("id"), F.col("lengths").alias("length"), F.lit(generation).alias("generation")).write.mode("append").parquet(f"{path}/texts")
    blocks.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).write.mode("append").parquet(f"{path}/terms")


def write(texts: DataFrame, path: str) -> None:
    """Index all texts (id, text)."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(-(-size // SLICE_BYTES), 8)
    texts.sparkSession.createDataFrame([(slices,)], "slices int").coalesce(1).write.parquet(f"{path}/layout")
    _append(texts, path, 0, slices)
    _totals(texts.sparkSession.read.parquet(f"{path}/texts"), path, 1)


def _totals(texts: DataFrame, path: str, sign: int) -> None:
    texts.agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum("length"), F.lit(0))).alias("words")).coalesce(1).write.mode("append").parquet(f"{path}/totals")


def add(texts: DataFrame, path: str) -> None:
    """Index some texts anew or for the first time: new blocks, and rows that take the old ones out of the statistics."""
    spark = texts.sparkSession
    slices = spark.read.parquet(f"{path}/layout").first().slices
    old = spark.read.parquet(f"{path}/texts")
    generation = (old.agg(F.max("generation")).first()[0] or 0) + 1
    again = texts.filter("id is not null").select("id").distinct()
    replaced = old.join(again, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("length", "generation"), "generation").alias("t")).select("id", "t.*")
    stored = replaced.select("id", "length", F.col("generation").alias("was"), F.lit(generation).alias("generation")).withColumn("slice", _slice(slices))
    stored.write.mode("append").parquet(f"{path}/replaced")
    replaced = spark.read.parquet(f"{path}/replaced").filter(F.col("generation") == generation)
    _totals(replaced, path, -1)
    touched = _blocks(spark, path).join(F.broadcast(replaced.select("slice").distinct()), "slice", "left_semi")  # a row for each slice at most
    gone = postings_of(touched).join(replaced.select("id", F.col("was").alias("generation")), ["id", "generation"], "left_semi")
    gone.groupBy("term").agg((-F.count("*")).alias("n")).write.mode("append").parquet(f"{path}/terms")
    _append(texts, path, generation, slices)
    _totals(spark.read.parquet(f"{path}/texts").filter(F.col("generation") == generation), path, 1)


def _blocks(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/blocks")
    return rows.filter("term is not null") if terms is None else rows.filter(F.col("term").isin(*terms))


def _replaced(spark: SparkSession, path: str) -> DataFrame:
    """(id, generation, slice): the generation from which on postings of an id count."""
    try:
        return spark.read.parquet(f"{path}/replaced").groupBy("id", "slice").agg(F.max("generation").alias("generation"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id long, slice int, generation int")


def postings_of(blocks: DataFrame) -> DataFrame:
    """(id, term, tf, length, generation) of blocks."""
    return blocks.select("term", "generation", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).select(F.col("ids").alias("id"), "term", F.col("tfs").cast("long").alias("tf"), F.col("lengths").alias("length"), "generation")


def postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(id, term, tf, length) of the asked terms; the filter on terms reaches the scan of the sorted files."""
    since = _replaced(spark, path).select("id", F.col("generation").alias("since"))
    rows = postings_of(_blocks(spark, path, terms)).join(since, "id", "left")
    return rows.filter(F.col("since").isNull() | (F.col("generation") >= F.col("since"))).select("id", "term", "tf", "length")


def stats(spark: SparkSession, path: str) -> DataFrame:
    """(documents, terms, words) of the index, from its statistics."""
    terms = spark.read.parquet(f"{path}/terms").groupBy("term").agg(F.sum("n").alias("n")).filter("n > 0").agg(F.count("*").alias("terms"))
    return spark.read.parquet(f"{path}/totals").agg(F.sum("n").alias("documents"), F.sum("words").alias("words")).join(terms).select("documents", "terms", "words")  # one row each


def search(spark: SparkSession, path: str, terms: list[str], limit: int | None = None, *, every: bool = True) -> DataFrame:
    """(id, rank): Okapi BM25, negative so that less is better, of texts with all terms or with any; the best ``limit``, or all."""
    terms = list(dict.fromkeys(terms))
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    df = {r.term: r.n for r in spark.read.parquet(f"{path}/terms").filter(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # as many as terms
    empty = spark.createDataFrame([], "id long, rank double")
    if not totals.n or not terms or (every and any(df.get(t, 0) <= 0 for t in terms)):
        return empty
    mean = totals.words / totals.n
    idf = {t: max(float(np.log((totals.n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))), 1e-6) for t in terms}
    as_block = _blocks(spark, path, terms).select("slice", "term", "generation", "ids", "tfs", "lengths", "most", "least")
    none = F.lit(None)
    as_replaced = _replaced(spark, path).select("slice", F.lit("").alias("term"), "generation", F.array("id").alias("ids"), none.cast("array<int>").alias("tfs"), none.cast("array<int>").alias("lengths"), none.cast("int").alias("most"), none.cast("int").alias("least"))

    def weight(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_slice(batches):
            yield best(rows)

    def best(rows: pa.Table) -> pa.RecordBatch:
        """The best of one slice."""
        names = rows.column("term").to_pylist()
        ids_of = lambda at: np.concatenate([rows.column("ids")[i].values.to_numpy() for i in at])
        dead = [i for i, t in enumerate(names) if t == ""]
        dead_ids = ids_of(dead) if dead else np.empty(0, np.int64)
        order = np.argsort(dead_ids)
        dead_ids, since = dead_ids[order], rows.column("generation").to_numpy()[dead][order]
        lists = []  # of each term: ids, scores, and first id and bound of its blocks
        for t in terms:
            at = [i for i, name in enumerate(names) if name == t]
            if not at:
                continue
            ids = ids_of(at)
            tf, length = (np.concatenate([rows.column(c)[i].values.to_numpy() for i in at]).astype(float) for c in ("tfs", "lengths"))
            of_block = np.repeat(np.arange(len(at)), [len(rows.column("ids")[i]) for i in at])
            if len(dead_ids):
                found = np.minimum(np.searchsorted(dead_ids, ids), len(dead_ids) - 1)
                lives = (dead_ids[found] != ids) | (rows.column("generation").to_numpy()[at][of_block] >= since[found])
                ids, tf, length, of_block = ids[lives], tf[lives], length[lives], of_block[lives]
            if not len(ids):
                continue
            bound = idf[t] * weight(rows.column("most").to_numpy()[at].astype(float), rows.column("least").to_numpy()[at].astype(float))
            order = np.argsort(ids, kind="stable")  # generations may be mixed
            lists.append((ids[order], idf[t] * weight(tf, length)[order], bound[of_block][order]))
        out_ids, out_scores = np.empty(0, np.int64), np.empty(0)
        if lists and not (every and len(lists) < len(terms)):
            borders = np.unique(np.concatenate([x[::BLOCK] for x, _, _ in lists]))
            most = sum(np.maximum.reduceat(np.append(b, 0), np.minimum(np.searchsorted(x, borders), len(x))) * (np.diff(np.append(np.searchsorted(x, borders), len(x))) > 0) for x, _, b in lists)
            ends = np.append(borders[1:], np.iinfo(np.int64).max)
            for i in np.argsort(-most, kind="stable").tolist():
                if limit is not None and len(out_ids) >= limit and most[i] < out_scores.min() * (1 - 1e-9):
                    break
                parts = [slice(int(np.searchsorted(x, borders[i])), int(np.searchsorted(x, ends[i], side="left" if i + 1 < len(borders) else "right"))) for x, _, _ in lists]
                ids, at, n = np.unique(np.concatenate([x[p] for (x, _, _), p in zip(lists, parts)]), return_inverse=True, return_counts=True)
                scores = np.bincount(at, np.concatenate([s[p] for (_, s, _), p in zip(lists, parts)]), len(ids))
                kept = n == len(terms) if every else n > 0
                out_ids, out_scores = np.append(out_ids, ids[kept]), np.append(out_scores, scores[kept])
                if limit is not None and len(out_ids) > 4 * limit:
                    top = np.lexsort((out_ids, -out_scores))[:limit]
                    out_ids, out_scores = out_ids[top], out_scores[top]
        if limit is not None:
            top = np.lexsort((out_ids, -out_scores))[:limit]
            out_ids, out_scores = out_ids[top], out_scores[top]
        return pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(-out_scores)], names=["id", "rank"])

    rows = as_block.unionByName(as_replaced).repartition("slice").sortWithinPartitions("slice", "term")
    found = rows.mapInArrow(run, "id long, rank double")
    return found if limit is None else found.orderBy("rank", "id").limit(limit)


def searched(spark: SparkSession, path: str, terms: list[str], limit: int) -> tuple[DataFrame, str]:
    """All terms; if nothing is found and there are several, any term. The strategy is told beside the rows."""
    strict = search(spark, path, terms, limit)
    if len(set(terms)) < 2 or not strict.isEmpty():
        return strict, "strict"
    return search(spark, path, terms, limit, every=False), "relaxed"

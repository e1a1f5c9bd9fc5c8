"""Search and retrieval over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.functions.text import ACCENTS, ascii_fold, question_terms, search_terms_core, search_terms_ui, snippet
from lektra.operators import search as S
from lektra.operators.nearest import above, nearest
from lektra.plans.catalog import query
from lektra.sources import index
from lektra.sources.corpus import Corpus

_TERMS = rf"SELECT doc_id AS id, regexp_extract_all(translate(lower(text), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[\p{{L}}\p{{N}}]+') AS terms, source, text FROM documents"


def _ranked(terms: list[str], every: bool) -> str:
    """BM25 written out."""
    counts = ", ".join(f"len(list_filter(terms, lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    stats = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(terms)))
    where = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"SELECT id, -({score}) AS rank FROM (SELECT id, len(terms) AS length, {counts} FROM ({_TERMS})), (SELECT count(*) AS n, avg(length) AS mean, {stats} FROM (SELECT len(terms) AS length, {counts} FROM ({_TERMS}))) WHERE {where}"


def _texts(c: Corpus) -> DataFrame:
    return c.documents.select(F.col("doc_id").alias("id"), "text")


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM ({_TERMS})) GROUP BY 1, 2")
def a1_fts_build(c: Corpus) -> DataFrame:
    return S.postings(_texts(c)).select("id", "term", "tf")


@query(f"SELECT id, len(terms) AS n FROM ({_TERMS})")
def a3_fts_tokenise(c: Corpus) -> DataFrame:
    from lektra.functions.text import index_terms

    return _texts(c).select("id", F.size(index_terms("text")).cast("long").alias("n"))


@query(f"SELECT id, round(rank, 6) AS rank FROM ({_ranked(['the', 'that'], True)})")
def a4_fts_search_strict(c: Corpus) -> DataFrame:
    return index.search(c.spark, c.text_index, search_terms_core('the-"that" AND')).select("id", F.round("rank", 6).alias("rank"))


@query(f"SELECT id, round(rank, 6) AS rank, 'relaxed' AS strategy FROM ({_ranked(['zzzz', 'schen'], False)}) ORDER BY rank, id LIMIT 50")
def a5_fts_search_auto(c: Corpus) -> DataFrame:
    rows, strategy = index.searched(c.spark, c.text_index, search_terms_ui('zzzz "schen"'), 50)
    return rows.select("id", F.round("rank", 6).alias("rank"), F.lit(strategy).alias("strategy"))


@query(f"SELECT i.id, i.title FROM ({_ranked(['the'], True)} ORDER BY rank, id LIMIT 50) h JOIN items i ON i.id = h.id WHERE i.collection_id = 'src1'", "items")
def a6_search_in_collection(c: Corpus) -> DataFrame:
    hits, _ = index.searched(c.spark, c.text_index, ["the"], 50)
    return c.items.join(hits, "id").filter("collection_id = 'src1'").orderBy(ascii_fold("title"), "id").select("id", "title")


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS score FROM embeddings WHERE vec_id <> 3 ORDER BY score DESC, id LIMIT 5")
def a8_similar_assets(c: Corpus) -> DataFrame:
    return _near(c, 3, 5).select("id", F.round("score", 6).alias("score"))


def _near(c: Corpus, vec: int, limit: int) -> DataFrame:
    vectors = c.vectors.select(F.col("asset_id").alias("id"), F.col("embedding").alias("vector"))
    one = vectors.filter(F.col("id") == vec).select(F.col("vector").alias("query"))
    return S.neighbours(vectors.filter(F.col("id") != vec), one, limit)


_VECTOR_LEG = "SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS score FROM embeddings WHERE vec_id <> 3 AND vec_id IN (SELECT doc_id FROM documents) ORDER BY score DESC, id LIMIT 24)"
_WORD_LEG = f"SELECT id, row_number() OVER (ORDER BY rank, id) AS place FROM ({_ranked(['thing'], True)} ORDER BY rank, id LIMIT 24)"
_FUSED = f"SELECT id, sum(1.0 / (60 + place)) AS score FROM (SELECT * FROM ({_VECTOR_LEG}) UNION ALL SELECT * FROM ({_WORD_LEG})) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6"


def _vector_leg(c: Corpus) -> DataFrame:
    vectors = c.vectors.select(F.col("asset_id").alias("id"), F.col("embedding").alias("vector"))
    one = vectors.filter("id = 3").select(F.col("vector").alias("query"))
    with_text = vectors.filter("id <> 3").join(c.documents.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return S.placed(S.neighbours(with_text, one, 24), F.desc("score"), "id")


def _word_leg(c: Corpus) -> DataFrame:
    return S.placed(index.search(c.spark, c.text_index, ["thing"], 24), "rank", "id")


@query(_VECTOR_LEG)
def a9_vector_leg(c: Corpus) -> DataFrame:
    return _vector_leg(c).select("id", F.col("place").cast("long").alias("place"))


@query(_WORD_LEG)
def a10_lexical_leg(c: Corpus) -> DataFrame:
    return _word_leg(c).select("id", F.col("place").cast("long").alias("place"))


@query(f"SELECT id, round(score, 8) AS score FROM ({_FUSED})")
def a11_rrf_fuse(c: Corpus) -> DataFrame:
    return S.fused(_vector_leg(c), _word_leg(c)).select("id", F.round("score", 8).alias("score"))


_SNIPPET = "CASE WHEN length(text) <= 200 THEN text ELSE substring(text, greatest(least(greatest(CASE WHEN strpos(lower(text), 'thing') > 0 THEN strpos(lower(text), 'thing') - 1 ELSE 0 END - 100, 0), length(text) - 200), 0) + 1, 200) END"


@query(f"WITH s AS (SELECT f.id, row_number() OVER (ORDER BY score DESC, f.id) AS n, source AS collection, {_SNIPPET} AS snippet FROM ({_FUSED}) f JOIN documents d ON d.doc_id = f.id), t AS (SELECT *, sum(length(snippet)) OVER (ORDER BY n) AS total FROM s) SELECT id, n, collection, snippet FROM t WHERE total <= 1000")
def a12_hybrid_retrieve(c: Corpus) -> DataFrame:
    """Both legs, fused; each source with its collection and a snippet, as long as they fit into the context."""
    sources = S.fused(_vector_leg(c), _word_leg(c)).join(c.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), "text"), "id")
    shown = sources.withColumn("snippet", snippet(F.col("text"), question_terms("Any thing?"), 200))
    return S.within_budget(shown, "snippet", 1000, F.desc("score"), "id").select("id", F.col("n").cast("long").alias("n"), "collection", "snippet")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id % 97, doc_id LIMIT 100")
def a16_embedding_candidates(c: Corpus) -> DataFrame:
    rows = c.documents.filter(F.length(F.trim("text")) > 0).join(c.vectors.select(F.col("asset_id").alias("doc_id")), "doc_id", "left_anti")
    return rows.orderBy(F.col("doc_id") % 97, "doc_id").limit(100).select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def a16_embedding_candidates_all(c: Corpus) -> DataFrame:
    """All of them; a16_embedding_candidates gives the first hundred, as its SQL does."""
    return S.without_vector(_texts(c), c.vectors.select(F.col("asset_id").alias("id"))).select(F.col("id").alias("doc_id"))


@query("SELECT i.collection_id, i.id, coalesce(n, 0) AS assets FROM items i LEFT JOIN (SELECT item_id, count(*) AS n FROM assets GROUP BY 1) ON item_id = i.id", "items", "assets")
def a13_export_tree(c: Corpus) -> DataFrame:
    """The tree of a collection, a JSON document for each item with its assets, so that no collection meets in one task."""
    tree = exported(c).select("collection_id", "id", F.from_json("document", "assets array<struct<id:long>>")["assets"].alias("assets"))
    return tree.select("collection_id", "id", F.size("assets").cast("long").alias("assets"))


def exported(c: Corpus) -> DataFrame:
    assets = c.assets.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "path", "size"))).alias("assets"))
    items = c.items.join(assets, F.col("id") == F.col("item_id"), "left").withColumn("assets", F.coalesce("assets", F.array().cast(assets.schema["assets"].dataType)))
    return items.select("collection_id", "id", F.to_json(F.struct(F.lit(3).alias("version"), F.col("collection_id").alias("collection"), "id", "title", "assets")).alias("document"))


@query("SELECT conversation_id, count(*) AS messages, count_if(role = 'user') AS questions, substring(arg_min(content, sort_index), 1, 60) AS opening FROM messages GROUP BY 1", "messages")
def a18_conversation_list(c: Corpus) -> DataFrame:
    return c.messages.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("questions"), F.substring(F.min_by("content", "sort_index"), 1, 60).alias("opening"))


@query(f"SELECT i.id, i.title FROM (SELECT id FROM ({_ranked(['thing'], True)}) ORDER BY rank, id LIMIT 20) h JOIN items i ON i.id = h.id", "items")
def a7_search_global_by_index(c: Corpus) -> DataFrame:
    """The twenty best items by the index, in the order of their titles; only if there is none, titles and metadata are searched."""
    hits, _ = index.searched(c.spark, c.text_index, search_terms_ui("thing"), 20)
    by_title = c.items.filter(F.contains(ascii_fold("title"), F.lit("thing")) | F.contains(ascii_fold("metadata"), F.lit("thing"))).orderBy("title", "id").limit(20).select("id", "title")
    return by_title if hits.isEmpty() else c.items.join(hits.select("id"), "id").orderBy("title", "id").select("id", "title")


_PAIRS = "SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0"


def _vectors(c: Corpus) -> DataFrame:
    return c.vectors.select(F.col("asset_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"SELECT query, id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM ({_PAIRS})) WHERE place <= 5")
def a8_similar_assets_of_many(c: Corpus) -> DataFrame:
    """The five most similar assets of every twentieth, against all."""
    found = nearest(_vectors(c), _vectors(c).filter("id % 20 = 0"), 5)
    return found.select("query", "id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"SELECT query, id, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM ({_PAIRS}) WHERE id IN (SELECT doc_id FROM documents)) WHERE place <= 24")
def a9_vector_legs(c: Corpus) -> DataFrame:
    """The vector legs of many questions: the 24 nearest assets that have a text."""
    with_text = _vectors(c).join(c.documents.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return nearest(with_text, _vectors(c).filter("id % 20 = 0"), 24).select("query", "id", F.col("place").cast("long").alias("place"))


@query(f"SELECT query, round(max(score), 6) AS nearest, count(*) AS above FROM ({_PAIRS}) WHERE score >= 0.3 GROUP BY 1")
def m7_cosines_above(c: Corpus) -> DataFrame:
    """How many vectors are nearer than a floor to every twentieth, and how near the nearest of them is."""
    vectors = _vectors(c)
    return above(vectors, vectors.filter("id % 20 = 0"), 0.3).select("query", F.round("nearest", 6).alias("nearest"), "above")

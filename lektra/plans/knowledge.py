"""Entities, triples and places, over rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.operators import knowledge as K
from lektra.operators.relational import first_by
from lektra.plans.catalog import query
from lektra.sources.corpus import Corpus


def _results(c: Corpus) -> DataFrame:
    """What a model might say: the first word, twice, as two types in turn, and one unknown type."""
    word = F.regexp_extract("text", r"[\p{L}]{4,}", 0)
    kind = F.when(F.col("doc_id") % 2 == 0, "LUGAR").otherwise("per")
    entity = lambda v, t: F.struct(v.alias("value"), t.alias("type"))
    made = F.to_json(F.array(entity(word, kind), entity(F.concat(F.lit(" «"), word, F.lit("», ")), kind), entity(word, F.lit("XYZ"))))
    return c.documents.filter(word != "").select(F.col("doc_id").alias("item_id"), "text", made.alias("result"))


_WORD = r"SELECT doc_id AS item_id, w AS value, CASE WHEN doc_id % 2 = 0 THEN 'place' ELSE 'person' END AS type, text FROM (SELECT doc_id, text, regexp_extract(text, '[\p{L}]{4,}') AS w FROM documents) WHERE w <> ''"


@query(f"SELECT item_id, value, type, 0.95::DOUBLE AS confidence, strpos(lower(text), lower(value)) - 1 AS start FROM ({_WORD})")
def k1_parse_entities(c: Corpus) -> DataFrame:
    return K.parsed_entities(_results(c)).select("item_id", "value", "type", "confidence", F.col("start").cast("long").alias("start"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'place' WHEN 2 THEN 'organization' END AS type FROM nation")
def k3_entity_type_map(c: Corpus) -> DataFrame:
    alias = F.element_at(F.array(*map(F.lit, (" per ", "GPE", "Institution", "??"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return c.table("nation").select("n_nationkey", K.entity_type(alias).alias("type"))


@query(f"SELECT item_id, value FROM ({_WORD}) WHERE item_id % 5 <> 0")
def k4_protected_entities(c: Corpus) -> DataFrame:
    found = K.parsed_entities(_results(c))
    return K.unprotected(found, found.filter("item_id % 5 = 0").withColumn("value", F.upper("value"))).select("item_id", "value")


@query(f"SELECT item_id, value, CASE WHEN item_id % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM ({_WORD}) UNION ALL SELECT item_id, value, 'manual' FROM ({_WORD}) WHERE item_id % 2 = 0")
def k5_replace_automatic(c: Corpus) -> DataFrame:
    found = K.parsed_entities(_results(c)).select("item_id", "value")
    old = found.withColumn("source", F.lit("old")).unionByName(found.filter("item_id % 2 = 0").withColumn("source", F.lit("manual")))
    return K.replaced(old, found.filter("item_id % 3 = 0").withColumn("source", F.lit("new")), "item_id", ~F.coalesce("source", F.lit("")).isin("manual", "manual_deleted"))


@query(f"SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'manual_deleted' ELSE 'model' END AS source, CASE WHEN item_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM ({_WORD})")
def k6_soft_delete(c: Corpus) -> DataFrame:
    gone = F.col("item_id") % 4 == 0
    return K.parsed_entities(_results(c)).select("item_id", F.when(gone, "manual_deleted").otherwise("model").alias("source"), F.when(gone, 1.0).otherwise(F.col("confidence")).alias("confidence"))


@query("SELECT o_orderkey AS item_id, 'customer ' || o_custkey AS subject, 'placed' AS predicate, 'order ' || o_orderkey AS object FROM orders WHERE o_orderkey % 5 <> 0")
def k8_parse_triples(c: Corpus) -> DataFrame:
    who, what = F.concat(F.lit(" customer  "), F.col("o_custkey").cast("string")), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    one = F.struct(who.alias("subject"), F.lit("placed").alias("predicate"), F.when(F.col("o_orderkey") % 5 != 0, what).otherwise(" ").alias("object"))
    two = F.struct(F.trim(who).alias("subject"), F.lit("placed").alias("predicate"), F.when(F.col("o_orderkey") % 5 != 0, F.upper(what)).otherwise("").alias("object"))
    return K.parsed_triples(c.table("orders").select(F.col("o_orderkey").alias("item_id"), F.to_json(F.array(one, two)).alias("result")))


@query("SELECT user_id, event_type, max(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY 1, 2")
def k10_result_upsert(c: Corpus) -> DataFrame:
    return first_by(c.table("events"), ["user_id", "event_type"], F.desc("event_id")).select("user_id", "event_type", "value")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'skipped' WHEN s_nationkey % 2 = 0 THEN 'resolved' ELSE 'not_found' END AS geo_status FROM supplier")
def k11_geo_status(c: Corpus) -> DataFrame:
    nations = c.table("nation")
    rows = c.table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("value"), F.when(F.col("s_suppkey") % 3 == 0, "person").otherwise("place").alias("type"), F.lit("pending").alias("geo_status"))
    gazetteer = nations.filter("n_nationkey % 2 = 0").select(K.entity_key("n_name").alias("key"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    return K.geocoded(rows, gazetteer).select("s_suppkey", "geo_status")


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN 'local' ELSE '' END, ''), 'fallback') AS engine FROM documents")
def k12_engine_choice(c: Corpus) -> DataFrame:
    local = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("local"))).otherwise(F.array().cast("array<string>"))
    return c.documents.select("doc_id", F.element_at(F.when(F.size(local) > 0, local).otherwise(F.array(F.lit("fallback"))), 1).alias("engine"))

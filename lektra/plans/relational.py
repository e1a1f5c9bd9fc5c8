"""Scans, filters, joins, aggregates, windows, sorts and mutations over the corpus model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektra.functions.text import ascii_fold, base_name, file_kind, sensitive, topic_name
from lektra.operators import relational as R
from lektra.operators.knowledge import unsuppressed
from lektra.plans.catalog import query
from lektra.sources.corpus import Corpus


@query("SELECT * FROM nation")
def s1_table_scan(c: Corpus) -> DataFrame:
    return c.table("nation")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def s2_sql_select(c: Corpus) -> DataFrame:
    from lektra.sources.gate import select

    return select(c, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = ? AND c_acctbal > ?", ["BUILDING", 5000])


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int', true, 0), ('nation', 'n_name', 'string', false, 1), ('nation', 'n_regionkey', 'int', false, 2)) t(table_name, column_name, kind, is_key, position)")
def s6_catalog_describe_table(c: Corpus) -> DataFrame:
    from lektra.sources.gate import described

    return described(c.table("nation"), "nation", "n_nationkey")


@query("SELECT lower(path) AS key, min(id) AS id, min(type) AS kind FROM assets GROUP BY 1", "assets")
def s7_import_files(c: Corpus) -> DataFrame:
    files = c.assets.select("id", "path", ascii_fold("path").alias("key"), file_kind("path").alias("kind")).filter("kind is not null")
    return R.first_by(files, ["key"], F.col("id")).select("key", "id", "kind")


@query("""SELECT id, '{"original_name":"' || id || '.' || CASE id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'PDF' ELSE 'mp3' END || '","size":' || size || '}' AS metadata FROM assets""", "assets")
def s8_import_metadata(c: Corpus) -> DataFrame:
    return c.assets.select("id", F.to_json(F.struct(base_name("path").alias("original_name"), "size")).alias("metadata"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 50 AS good FROM documents")
def s9_text_layer_quality(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", (F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= 50).alias("good"))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS size FROM documents")
def s15_blob_digest(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def f1_filter_eq(c: Corpus) -> DataFrame:
    return c.documents.filter("source = 'src3'").select("doc_id", "lang")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE'))")
def f2_in_subquery(c: Corpus) -> DataFrame:
    nations = R.non_empty(c.table("nation"), c.table("region").filter("r_name = 'EUROPE'"), "n_regionkey", "r_regionkey")
    return R.non_empty(c.table("customer"), nations, "c_nationkey", "n_nationkey").select("c_custkey")


@query("SELECT id FROM assets WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = assets.id AND length(trim(d.text)) > 200 ) OR EXISTS (SELECT 1 FROM conversations k WHERE k.conv_id = assets.id AND length(trim(k.text)) > 0)", "assets")
def f3_asset_has_text(c: Corpus) -> DataFrame:
    has = c.documents.filter(F.length(F.trim("text")) > 200).select("doc_id").union(c.messages.filter(F.length(F.trim("content")) > 0).select("conversation_id"))
    return R.non_empty(c.assets, has, "id", "doc_id").select("id")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def f4_not_exists(c: Corpus) -> DataFrame:
    return R.orphans(c.documents, c.vectors, "doc_id", "asset_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE nullif(lang, 'fr') IS NULL OR nullif(lang, 'fr') <> 'de'")
def f5_is_null_or_ne(c: Corpus) -> DataFrame:
    return c.documents.filter(~F.nullif(F.col("lang"), F.lit("fr")).eqNullSafe("de")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND (nullif(lang, 'en') = 'fr' OR nullif(lang, 'en') IS NULL)")
def f6_scope_asset_plus_item(c: Corpus) -> DataFrame:
    scope = F.nullif(F.col("lang"), F.lit("en"))
    return c.documents.filter((F.col("source") == "src1") & ((scope == "fr") | scope.isNull())).select("doc_id")


@query("SELECT id FROM items WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') OR contains(metadata, 'de')", "items")
def f7_like_contains(c: Corpus) -> DataFrame:
    return c.items.filter(F.contains(ascii_fold("title"), F.lit("the")) | F.contains(F.col("metadata"), F.lit("de"))).select("id")


@query("SELECT DISTINCT upper(trim(p_brand)) AS topic FROM part WHERE starts_with(upper(p_brand), 'BRAND#1') ORDER BY 1 LIMIT 20")
def f8_like_prefix(c: Corpus) -> DataFrame:
    return c.table("part").select(topic_name("p_brand").alias("topic")).filter(F.col("topic").startswith("BRAND#1")).distinct().orderBy("topic").limit(20)


@query("SELECT * FROM supplier WHERE contains(CAST(s_suppkey AS VARCHAR), '1') OR contains(lower(s_name), '1') OR contains(CAST(s_nationkey AS VARCHAR), '1')")
def f9_like_any_column(c: Corpus) -> DataFrame:
    rows = c.table("supplier")
    return R.any_column_contains(rows.drop("s_acctbal"), "1").join(rows.select("s_suppkey", "s_acctbal"), "s_suppkey")


@query("SELECT doc_id FROM documents WHERE coalesce(nullif(lang, 'en'), '') NOT IN ('fr', 'de')")
def f10_not_in_coalesced(c: Corpus) -> DataFrame:
    return c.documents.filter(~F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.lit("")).isin("fr", "de")).select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE label IS NULL OR label >= 2")
def f12_confidence_floor(c: Corpus) -> DataFrame:
    return c.vectors.filter(F.col("label").isNull() | (F.col("label") >= 2)).select(F.col("asset_id").alias("vec_id"))


@query("SELECT DISTINCT source AS name FROM documents WHERE contains(lower(source), 'c1')")
def f13_name_contains(c: Corpus) -> DataFrame:
    return c.collections.filter(F.contains(F.lower("name"), F.lit("c1"))).select("name")


@query("SELECT id, title || ' ' || metadata AS search_text FROM items", "items")
def f15_generated_column(c: Corpus) -> DataFrame:
    return c.items.select("id", F.concat_ws(" ", "title", "metadata").alias("search_text"))


@query("SELECT id, CASE type WHEN 'image' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END AS place FROM assets", "assets")
def f16_case_rank(c: Corpus) -> DataFrame:
    return c.assets.select("id", F.when(F.col("type") == "image", 0).when(F.col("type") == "pdf", 1).otherwise(2).alias("place"))


@query("SELECT doc_id, CAST(vec_id IS NOT NULL AS INT) AS has_vector, CAST(l.doc_id2 IS NOT NULL AS INT) AS has_label FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN (SELECT doc_id AS doc_id2 FROM labels) l ON l.doc_id2 = doc_id")
def f17_flag_projection(c: Corpus) -> DataFrame:
    vectors, labels = c.vectors.select(F.col("asset_id").alias("v")), c.table("labels").select(F.col("doc_id").alias("l"))
    rows = c.documents.join(vectors, F.col("doc_id") == F.col("v"), "left").join(labels, F.col("doc_id") == F.col("l"), "left")
    return rows.select("doc_id", F.col("v").isNotNull().cast("int").alias("has_vector"), F.col("l").isNotNull().cast("int").alias("has_label"))


@query("SELECT p_partkey, CASE WHEN ends_with(k, '_api_key') OR regexp_matches(k, 'secret|token|password|credential') THEN '***' ELSE p_name END AS value FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'x_API_KEY' WHEN 1 THEN 'theme' ELSE 'MyToken' END AS k0, lower(CASE p_partkey % 3 WHEN 0 THEN 'x_API_KEY' WHEN 1 THEN 'theme' ELSE 'MyToken' END) AS k FROM part)")
def f18_redact_settings(c: Corpus) -> DataFrame:
    key = F.when(F.col("p_partkey") % 3 == 0, "x_API_KEY").when(F.col("p_partkey") % 3 == 1, "theme").otherwise("MyToken")
    return c.table("part").select("p_partkey", F.when(sensitive(key), "***").otherwise(F.col("p_name")).alias("value"))


@query("SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id) THEN 'asset' WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) THEN 'item' ELSE 'unknown' END AS target_type FROM events")
def f19_target_type_infer(c: Corpus) -> DataFrame:
    events = c.table("events").join(c.table("supplier").select(F.col("s_suppkey").alias("a")), F.col("user_id") == F.col("a"), "left")
    events = events.join(c.table("customer").select(F.col("c_custkey").alias("b")), F.col("user_id") == F.col("b"), "left")
    return events.select("event_id", F.when(F.col("a").isNotNull(), "asset").when(F.col("b").isNotNull(), "item").otherwise("unknown").alias("target_type"))


@query("SELECT o_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def j1_inner_chain(c: Corpus) -> DataFrame:
    owners = c.table("customer").filter("c_nationkey = 7").select("c_custkey", "c_name")
    mine = c.table("orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    return c.table("lineitem").join(mine, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j2_semi_group(c: Corpus) -> DataFrame:
    return R.non_empty(c.table("customer"), c.table("orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j3_left_outer(c: Corpus) -> DataFrame:
    return c.table("customer").join(c.table("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


_PRIMARY = "SELECT item_id, id AS asset_id, type FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE type WHEN 'image' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END, sort_index, created_at, id) AS n FROM assets) WHERE n = 1"


@query(_PRIMARY, "assets")
def j4_primary_asset(c: Corpus) -> DataFrame:
    place = F.when(F.col("type") == "image", 0).when(F.col("type") == "pdf", 1).otherwise(2)
    return R.first_by(c.assets, ["item_id"], place, F.col("sort_index"), F.col("created_at"), F.col("id")).select("item_id", F.col("id").alias("asset_id"), "type")


@query("SELECT d.doc_id, v.label, l.quality FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE v.vec_id <> 5")
def j5_left_multi(c: Corpus) -> DataFrame:
    rows = c.vectors.filter("asset_id <> 5").join(c.documents.select("doc_id"), F.col("asset_id") == F.col("doc_id"), "left")
    return rows.join(c.table("labels").select(F.col("doc_id").alias("k"), "quality"), F.col("doc_id") == F.col("k"), "left").select("doc_id", "label", "quality")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, lang FROM documents LEFT JOIN (SELECT doc_id AS k, quality FROM labels) ON k = doc_id WHERE source = 'src2'")
def j7_citation_join(c: Corpus) -> DataFrame:
    labels = c.table("labels").select(F.col("doc_id").alias("k"), "quality")
    return c.documents.filter("source = 'src2'").join(labels, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "lang")


@query("SELECT s_suppkey, p_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE s_nationkey = 3 GROUP BY ALL")
def j8_m2m_join(c: Corpus) -> DataFrame:
    links = c.table("lineitem").join(c.table("supplier").filter("s_nationkey = 3").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "l_partkey").distinct()
    return links.join(c.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("s_suppkey", "p_name").distinct()


@query("""SELECT 'document without vector' AS audit, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'vector without document', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'document without label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'customer without order', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'order without line', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'part without line', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'event without customer', event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def j9_anti_audits(c: Corpus) -> DataFrame:
    audits = (
        ("document without vector", c.documents, c.vectors, "doc_id", "asset_id", "doc_id"), ("vector without document", c.vectors, c.documents, "asset_id", "doc_id", "asset_id"),
        ("document without label", c.documents, c.table("labels"), "doc_id", "doc_id", "doc_id"), ("customer without order", c.table("customer"), c.table("orders"), "c_custkey", "o_custkey", "c_custkey"),
        ("order without line", c.table("orders"), c.table("lineitem"), "o_orderkey", "l_orderkey", "o_orderkey"), ("part without line", c.table("part"), c.table("lineitem"), "p_partkey", "l_partkey", "p_partkey"),
        ("event without customer", c.table("events"), c.table("customer"), "user_id", "c_custkey", "event_id"),
    )
    found = [R.orphans(child.select(*{key, show}), parent, key, parent_key, R.tasks_for(child.count(), parent.count())).select(F.lit(name).alias("audit"), F.col(show).alias("id")) for name, child, parent, key, parent_key, show in audits]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


@query("SELECT v.vec_id, d.source FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE d.source IN ('src1', 'src2')")
def j10_semi_sequence(c: Corpus) -> DataFrame:
    mine = c.documents.filter(F.col("source").isin("src1", "src2")).select("doc_id", "source")
    return c.vectors.join(mine, F.col("asset_id") == F.col("doc_id")).select(F.col("asset_id").alias("vec_id"), "source")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def j11_lookup_join(c: Corpus) -> DataFrame:
    return c.table("orders").filter("o_totalprice > 300000").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT a.event_id FROM events a WHERE a.event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 1 AND b.user_id = a.user_id AND (b.event_type = a.event_type OR (a.event_id < b.event_id + 40 AND b.event_id < a.event_id + 40)))")
def j13_theta_overlap(c: Corpus) -> DataFrame:
    spans = c.table("events").select("event_id", F.col("user_id").alias("group"), F.col("event_type").alias("value"), F.col("event_id").alias("start"), (F.col("event_id") + 40).alias("end"))
    return unsuppressed(spans.filter("event_id % 2 = 0"), spans.filter("event_id % 2 = 1")).select("event_id")


@query("SELECT c_custkey, coalesce(orders, '') AS orders FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j15_map_group(c: Corpus) -> DataFrame:
    grouped = c.table("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("orders"))
    return c.table("customer").join(grouped, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit("")).alias("orders"))


@query("SELECT source AS collection_id, count(*) AS items FROM documents GROUP BY 1")
def g1_count_where(c: Corpus) -> DataFrame:
    return c.items.groupBy("collection_id").agg(F.count("*").alias("items"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def g2_count_children_left(c: Corpus) -> DataFrame:
    return R.counted_children(c.table("customer").select("c_custkey"), "c_custkey", orders=(c.table("orders"), "o_custkey"))


@query(f"SELECT i.id, i.title, coalesce(n, 0) AS assets, asset_id, type FROM items i LEFT JOIN (SELECT item_id, count(*) AS n FROM assets GROUP BY 1) k ON k.item_id = i.id LEFT JOIN ({_PRIMARY}) p ON p.item_id = i.id", "items", "assets")
def g3_card_summary(c: Corpus) -> DataFrame:
    items = R.counted_children(c.items.select("id", "title"), "id", assets=(c.assets, "item_id"))
    return items.join(j4_primary_asset(c), F.col("id") == F.col("item_id"), "left").select("id", "title", "assets", "asset_id", "type")


@query("SELECT count(*) AS assets, count_if(length(trim(text)) > 0) AS with_text, count(vec_id) AS with_vector, count_if(length(trim(text)) > 0 AND vec_id IS NULL) AS missing FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def g4_embedding_coverage(c: Corpus) -> DataFrame:
    rows = c.documents.join(c.vectors.select("asset_id"), F.col("doc_id") == F.col("asset_id"), "left")
    has = F.length(F.trim("text")) > 0
    return rows.agg(F.count("*").alias("assets"), F.count_if(has).alias("with_text"), F.count("asset_id").alias("with_vector"), F.count_if(has & F.col("asset_id").isNull()).alias("missing"))


@query("SELECT type, count(*) AS assets, count(vec_id) AS with_vector, count(*) - count(vec_id) AS missing FROM assets LEFT JOIN embeddings ON vec_id = id GROUP BY 1", "assets")
def g5_coverage_by_type(c: Corpus) -> DataFrame:
    rows = c.assets.join(c.vectors.select("asset_id"), F.col("id") == F.col("asset_id"), "left")
    return rows.groupBy("type").agg(F.count("*").alias("assets"), F.count("asset_id").alias("with_vector"), (F.count("*") - F.count("asset_id")).alias("missing")).orderBy(F.desc("missing"), "type")


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def g6_subquery_counts(c: Corpus) -> DataFrame:
    return R.counted_children(c.table("nation").select("n_nationkey"), "n_nationkey", customers=(c.table("customer"), "c_nationkey"), suppliers=(c.table("supplier"), "s_nationkey"))


@query("SELECT user_id, count(*) AS events FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def g7_count_by_key(c: Corpus) -> DataFrame:
    return c.table("events").groupBy("user_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "user_id").limit(50)


@query("SELECT conversation_id, string_agg(role || ': ' || content, ' ' ORDER BY sort_index) AS text FROM messages GROUP BY 1", "messages")
def g8_ordered_concat(c: Corpus) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("sort_index", F.concat_ws(": ", "role", "content").alias("line"))))
    return c.messages.groupBy("conversation_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), " ").alias("text"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def g9_last_by_key(c: Corpus) -> DataFrame:
    return c.table("events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def g10_latest_by_key(c: Corpus) -> DataFrame:
    return R.first_by(c.table("orders"), ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT count(*) AS dirty FROM (SELECT DISTINCT table_name, row_id FROM oplog)", "oplog")
def g11_distinct_count(c: Corpus) -> DataFrame:
    return c.oplog.agg(F.count_distinct("table_name", "row_id").alias("dirty"))


@query("SELECT coalesce(max(seq), 0) AS snapshot, coalesce(max(CASE WHEN seq < 0 THEN seq END), -1) + 1 AS next_index FROM oplog", "oplog")
def g12_max_default(c: Corpus) -> DataFrame:
    return c.oplog.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("snapshot"), (F.coalesce(F.max(F.when(F.col("seq") < 0, F.col("seq"))), F.lit(-1)) + 1).alias("next_index"))


@query("SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM assets WHERE type = 'audio'", "assets")
def g13_sum_default(c: Corpus) -> DataFrame:
    return c.assets.filter("type = 'audio'").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'all', (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM labels)")
def g21_richness_score(c: Corpus) -> DataFrame:
    counts = None
    for name in ("documents", "pages", "labels"):
        one = c.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionAll(one)
    return counts.unionAll(counts.agg(F.lit("all").alias("name"), F.sum("n").alias("n")))


@query("SELECT count_if(op = 'D') AS deletions, count(*) AS entries FROM oplog", "oplog")
def g23_unread_counts(c: Corpus) -> DataFrame:
    return c.oplog.agg(F.count_if(F.col("op") == "D").alias("deletions"), F.count("*").alias("entries"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def w1_top1_per_key(c: Corpus) -> DataFrame:
    return R.first_by(c.table("lineitem"), ["l_orderkey"], F.desc("l_extendedprice"), F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def w2_latest_per_job_type(c: Corpus) -> DataFrame:
    return R.first_by(c.table("events"), ["user_id", "event_type"], F.desc("event_id")).select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def w3_rank_in_leg(c: Corpus) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return c.table("orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def w3_rank_in_source(c: Corpus) -> DataFrame:
    rows = c.documents.select("source", "doc_id", (-F.col("n_chars")).alias("shortness"))
    return R.placed_in_groups(rows, "source", "doc_id", "shortness").select("source", "doc_id", "place")


@query("SELECT conversation_id, sort_index, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role, content FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sort_index DESC) AS n FROM messages WHERE trim(content) <> '') WHERE n <= 3", "messages")
def w4_last_turns(c: Corpus) -> DataFrame:
    recent = Window.partitionBy("conversation_id").orderBy(F.desc("sort_index"))
    rows = c.messages.filter(F.trim("content") != "").withColumn("n", F.row_number().over(recent)).filter("n <= 3")
    return rows.select("conversation_id", "sort_index", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), "content")


@query("SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY translate(o_orderpriority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), o_orderkey)")
def w7_siblings(c: Corpus) -> DataFrame:
    shown = Window.partitionBy("o_custkey").orderBy(ascii_fold("o_orderpriority"), "o_orderkey")
    return c.table("orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(shown).alias("before"), F.lead("o_orderkey").over(shown).alias("after"))


@query("SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM items WINDOW w AS (PARTITION BY collection_id ORDER BY translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id)", "items")
def w7_siblings_in_collection(c: Corpus) -> DataFrame:
    rows = c.items.select("collection_id", "id", ascii_fold("title").alias("shown"))
    return R.placed_in_groups(rows, "collection_id", "id", "shown").select("id", "before", "after")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def w8_consecutive_dedupe(c: Corpus) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return c.table("events").withColumn("p", before).filter("p is null or p <> event_type").select("event_id")


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def w10_first_seen(c: Corpus) -> DataFrame:
    return c.table("events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT id, item_id, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN m > 0 AND k > 1 THEN sort_index ELSE 0 END, lower(path), id) AS position FROM (SELECT *, max(sort_index) OVER (PARTITION BY item_id) AS m, count(*) OVER (PARTITION BY item_id) AS k FROM assets))", "assets")
def o3_display_order(c: Corpus) -> DataFrame:
    return R.with_shown_order(c.assets).select("id", "item_id", F.col("position").cast("long").alias("position"))


@query("SELECT source AS id, max(doc_id) AS updated_at FROM documents GROUP BY 1 ORDER BY 2 DESC")
def o1_order_updated_desc(c: Corpus) -> DataFrame:
    return c.collections.orderBy(F.desc("updated_at")).select("id", "updated_at")


@query("SELECT id, title FROM items WHERE collection_id = 'src4' ORDER BY translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id", "items")
def o2_order_title(c: Corpus) -> DataFrame:
    return c.items.filter("collection_id = 'src4'").orderBy(ascii_fold("title"), "id").select("id", "title")


@query("SELECT user_id, ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def o4_multi_key_order(c: Corpus) -> DataFrame:
    return c.table("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("user_id", "ts", "event_id")


@query("SELECT * FROM part WHERE contains(lower(p_type), 'steel') OR contains(lower(p_name), 'steel') OR contains(lower(p_brand), 'steel') ORDER BY p_size DESC, p_partkey LIMIT 30 OFFSET 30")
def o5_browse_page(c: Corpus) -> DataFrame:
    return R.browsed(c.table("part"), key="p_partkey", sort="p_size", direction="DESC", page=2, size=30, search=" steel ")


@query("SELECT seq, table_name FROM oplog WHERE op = 'D' ORDER BY changed_at DESC, seq DESC LIMIT 50 OFFSET 10", "oplog")
def o6_conflict_page(c: Corpus) -> DataFrame:
    return c.oplog.filter("op = 'D'").orderBy(F.desc("changed_at"), F.desc("seq")).offset(10).limit(50).select("seq", "table_name")


@query("SELECT DISTINCT p_type AS name FROM part ORDER BY 1 LIMIT 100")
def o9_names_sorted_limit(c: Corpus) -> DataFrame:
    return c.table("part").select(F.col("p_type").alias("name")).distinct().orderBy("name").limit(100)


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 25")
def o10_ring_tail(c: Corpus) -> DataFrame:
    return c.table("events").orderBy(F.desc("event_id")).limit(25).select("event_id")


@query("SELECT doc_id AS asset_id, 'extraction' AS kind, length(text) AS n FROM documents UNION ALL SELECT conv_id, 'transcription', length(text) FROM conversations")
def u1_union_all(c: Corpus) -> DataFrame:
    said = c.messages.select(F.col("conversation_id").alias("asset_id"), F.lit("transcription").alias("kind"), F.length("content").cast("long").alias("n"))
    return c.extractions.select("asset_id", F.lit("extraction").alias("kind"), F.length("text_content").cast("long").alias("n")).unionByName(said)


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def u2_set_difference(c: Corpus) -> DataFrame:
    return c.table("customer").select(F.col("c_custkey").alias("id")).subtract(c.table("orders").select("o_custkey"))


@query("SELECT upper(trim(lang)) AS topic FROM documents UNION SELECT upper(trim(event_type)) FROM events")
def u3_set_union(c: Corpus) -> DataFrame:
    return c.documents.select(topic_name("lang").alias("topic")).union(c.table("events").select(topic_name("event_type"))).distinct()


@query("SELECT c_custkey, o_custkey IS NULL AS refused FROM (SELECT DISTINCT o_custkey + 100 AS c_custkey FROM orders) LEFT JOIN (SELECT c_custkey AS o_custkey FROM customer) ON o_custkey = c_custkey")
def d1_insert_with_parent_check(c: Corpus) -> DataFrame:
    rows = c.table("orders").select((F.col("o_custkey") + 100).alias("c_custkey")).distinct()
    missing = R.orphans(rows, c.table("customer").select(F.col("c_custkey").alias("k")), "c_custkey", "k")
    return rows.join(missing.withColumn("refused", F.lit(True)), "c_custkey", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'new ' || s_name FROM supplier WHERE s_suppkey % 2 = 0")
def d2_upsert_by_key(c: Corpus) -> DataFrame:
    old = c.table("supplier").select("s_suppkey", "s_name")
    return R.upserted(old, old.filter("s_suppkey % 2 = 0").withColumn("s_name", F.concat(F.lit("new "), "s_name")), ["s_suppkey"])


@query("SELECT user_id, event_id, CASE WHEN n = 1 THEN 'edited' ELSE event_type END AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)")
def d4_update_latest(c: Corpus) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return c.table("events").withColumn("n", newest).select("user_id", "event_id", F.when(F.col("n") == 1, "edited").otherwise(F.col("event_type")).alias("event_type"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)")
def d5_cascade_delete(c: Corpus) -> DataFrame:
    tables = {"customer": c.table("customer").withColumn("id", F.col("c_custkey")), "orders": c.table("orders").withColumn("id", F.col("o_orderkey")), "lineitem": c.table("lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))}
    gone = tables["customer"].filter("c_nationkey = 3").select("id")
    left = R.cascaded(tables, [("customer", "id", "orders", "o_custkey"), ("orders", "id", "lineitem", "l_orderkey")], "customer", gone)
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
def d8_delete_if_empty(c: Corpus) -> DataFrame:
    return R.non_empty(c.table("customer"), c.table("orders").filter("o_orderstatus <> 'F'"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT DISTINCT upper(trim(lang)) AS name, 'old' AS state FROM documents UNION ALL SELECT DISTINCT upper(trim(event_type)), 'new' FROM events WHERE upper(trim(event_type)) NOT IN (SELECT upper(lang) FROM documents)")
def d9_find_or_create_topic(c: Corpus) -> DataFrame:
    old = c.documents.select(topic_name("lang").alias("name")).distinct()
    new = R.orphans(c.table("events").select(topic_name("event_type").alias("name")).distinct(), old.toDF("k"), "name", "k")
    return old.withColumn("state", F.lit("old")).unionByName(new.withColumn("state", F.lit("new")))


@query("SELECT event_id, 0 AS uploaded FROM events")
def d14_reset_flag_all(c: Corpus) -> DataFrame:
    return c.table("events").select("event_id", F.lit(0).alias("uploaded"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def extra_rollup(c: Corpus) -> DataFrame:
    return c.table("orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def extra_hourly_events(c: Corpus) -> DataFrame:
    rows = c.table("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

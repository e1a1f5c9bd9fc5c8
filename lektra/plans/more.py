"""Readers, dialogue and prompt texts, layouts, mutations and capture that the other families leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektra.functions import numbers as N
from lektra.functions import text as T
from lektra.functions.udfs import decoded_vectors, fnv1a64, jsonish, packed_vectors
from lektra.operators import geometry as G
from lektra.operators import relational as R
from lektra.operators.grouped import batches, overlap_columns, reading_order
from lektra.operators.settling import fresh_path
from lektra.plans.catalog import query
from lektra.plans.texts import _KEPT, _WORDS, frequencies
from lektra.sources import exports, files
from lektra.sources.corpus import Corpus
from lektra.streaming import jobs


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s10_sentinel_reader(c: Corpus) -> DataFrame:
    said = F.concat(F.lit("log\n<<<BEGIN>>>\n"), "props", F.lit("\n<<<END>>> bye"))
    found = F.regexp_extract(said, r"(?s)<<<BEGIN>>>\s*(.*?)\s*<<<END>>>", 1)
    return c.table("events").select("event_id", F.from_json(found, "k long")["k"].alias("k"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 9 <> 0 ORDER BY event_id DESC LIMIT 200")
def s13_log_reader(c: Corpus) -> DataFrame:
    """JSON lines, of which bad ones are skipped; the newest 200."""
    line = F.to_json(F.struct("event_id", "event_type"))
    lines = c.table("events").select(F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(line).alias("line"))
    rows = lines.select(F.from_json("line", "event_id long, event_type string").alias("e")).filter("e.event_id is not null")
    return rows.select("e.*").orderBy(F.desc("event_id")).limit(200)


@query("SELECT l_orderkey AS page, l_linenumber AS place, 'part ' || l_partkey AS content FROM lineitem")
def s17_layout_response(c: Corpus) -> DataFrame:
    """A nested answer for each page, parsed back into blocks in their order."""
    block = F.struct(F.col("l_linenumber").alias("order"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("content"))
    said = c.table("lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(block)).alias("blocks"))).alias("said"))
    parsed = said.select("page", F.posexplode(F.from_json("said", "blocks array<struct<order:int,content:string>>")["blocks"]).alias("place", "b"))
    return parsed.select("page", F.col("b.order").alias("place"), "b.content")


@query("SELECT a.doc_id, a.doc_id % 5 + 1 AS turn FROM documents a")
def w6_cumulative_segments(c: Corpus) -> DataFrame:
    """The segment that holds a character offset: five segments of ten characters, the offset in the middle of one."""
    rows = c.documents.select("doc_id", (F.col("doc_id") % 5 * 10 + 5).alias("offset"), F.posexplode(F.array(*[F.lit(10)] * 5)).alias("turn", "length"))
    total = F.sum("length").over(Window.partitionBy("doc_id").orderBy("turn"))
    return rows.withColumn("end", total).filter((F.col("offset") < F.col("end")) & (F.col("offset") >= F.col("end") - F.col("length"))).select("doc_id", (F.col("turn") + 1).cast("long").alias("turn"))


@query("SELECT conv_id, max(g) + 1 AS paragraphs FROM (SELECT conv_id, sum(CAST(p IS NOT NULL AND p <> role AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)) GROUP BY 1")
def w9_paragraph_break(c: Corpus) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.table("conversations").withColumn("p", F.lag("role").over(order))
    breaks = F.sum((F.col("p").isNotNull() & (F.col("p") != F.col("role"))).cast("long")).over(order)
    return rows.withColumn("g", breaks).groupBy("conv_id").agg((F.max("g") + 1).alias("paragraphs"))


@query("SELECT upper(trim(name)) AS topic, count(*) AS items FROM (SELECT doc_id, 'quality' AS name FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, ' toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, lang FROM documents) GROUP BY 1")
def g1_items_by_topic(c: Corpus) -> DataFrame:
    labels = c.table("labels")
    rows = labels.filter("quality = 1").select(F.lit("quality").alias("name")).unionAll(labels.filter("toxic = 1").select(F.lit(" toxic"))).unionAll(c.documents.select("lang"))
    return rows.groupBy(T.topic_name("name").alias("topic")).agg(F.count("*").alias("items"))


@query("SELECT lang AS kind, count(*) AS docs, CASE lang WHEN 'en' THEN 0 WHEN 'es' THEN 1 ELSE 2 END AS place FROM documents GROUP BY 1")
def g17_group_by_type_order(c: Corpus) -> DataFrame:
    grouped = c.documents.groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("docs"))
    return grouped.withColumn("place", F.when(F.col("kind") == "en", 0).when(F.col("kind") == "es", 1).otherwise(2)).orderBy("place", "kind")


@query("SELECT lang AS kind, CASE lang WHEN 'en' THEN 0 WHEN 'es' THEN 1 ELSE 2 END AS place, doc_id FROM documents")
def g17_members_by_type_order(c: Corpus) -> DataFrame:
    """The members of each kind as rows, in order, so that no list holds a kind."""
    place = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "es", 1).otherwise(2)
    return c.documents.select(F.col("lang").alias("kind"), place.alias("place"), "doc_id").orderBy("place", "kind", "doc_id")


@query("SELECT id, title FROM items WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ion') ORDER BY translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id LIMIT 20", "items")
def a7_search_global(c: Corpus) -> DataFrame:
    """No term of the index is a mere part of a word, so titles are searched instead."""
    return c.items.filter(F.contains(T.ascii_fold("title"), F.lit("ion"))).orderBy(T.ascii_fold("title"), "id").limit(20).select("id", "title")


@query(r"SELECT d, sum(n)::BIGINT AS tokens FROM (SELECT source AS d, len(list_filter(regexp_extract_all(translate(lower(text), 'A', 'A'), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3)) AS n FROM documents) GROUP BY 1")
def a15_corpus_sizes(c: Corpus) -> DataFrame:
    terms = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return c.documents.groupBy(F.col("source").alias("d")).agg(F.sum(F.size(terms)).alias("tokens"))


@query("SELECT count_if(vec_id IS NOT NULL) AS before, count(*) AS requested, count_if(doc_id % 10 <> 0) AS succeeded, count_if(doc_id % 10 = 0) AS failed FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def a17_backfill_report(c: Corpus) -> DataFrame:
    rows = c.documents.select("doc_id").join(c.vectors.select("asset_id"), F.col("doc_id") == F.col("asset_id"), "left")
    failed = F.col("doc_id") % 10 == 0
    return rows.agg(F.count("asset_id").alias("before"), F.count("*").alias("requested"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))


@query()
def a19_word_cloud(c: Corpus) -> DataFrame:
    """Places of the fifty most frequent words, by their rank, on a spiral."""
    from lektra.functions.cloud import placed_words

    rows = frequencies(c.documents).orderBy(F.desc("count"), "word").limit(50).collect()  # fifty rows
    return c.spark.createDataFrame(placed_words([(r["word"], r["count"]) for r in rows]), "word string, size double, x double, y double")


@query("SELECT event_id, CASE WHEN event_id % 100 < 10 THEN 1 WHEN event_id % 100 < 20 THEN 2 WHEN event_id % 100 < 50 THEN 5 ELSE 10 END AS step FROM events")
def a20_chart_step(c: Corpus) -> DataFrame:
    at = F.col("event_id") % 100 / 10
    return c.table("events").select("event_id", F.when(at < 1, 1).when(at < 2, 2).when(at < 5, 5).otherwise(10).alias("step"))


@query("SELECT doc_id, strpos(lower(text), 'thing') - 1 AS anchor FROM documents WHERE strpos(lower(text), 'thing') > 0")
def x9_anchor(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.anchor(F.col("text"), ["thing"]).cast("long").alias("anchor")).filter("anchor is not null")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN '## ' || l_linestatus WHEN 'N' THEN 'Note: ' || l_linestatus ELSE l_linestatus END AS text FROM lineitem")
def x24_format_region_text(c: Corpus) -> DataFrame:
    kind, text = F.col("l_returnflag"), F.col("l_linestatus")
    return c.table("lineitem").select("l_orderkey", "l_linenumber", F.when(kind == "A", F.concat(F.lit("## "), text)).when(kind == "N", F.concat(F.lit("Note: "), text)).otherwise(text).alias("text"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'Assistant: ' ELSE 'User: ' END || substring(text, 1, 100), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY 1")
def x32_format_history(c: Corpus) -> DataFrame:
    line = F.concat(F.when(F.col("role") == "assistant", "Assistant: ").otherwise("User: "), F.substring("text", 1, 100))
    return c.table("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


@query("SELECT event_id, length(props) > 9 AS long FROM events")
def x33_cell_preview(c: Corpus) -> DataFrame:
    return c.table("events").select("event_id", (F.length("props") > 9).alias("long"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def m8_decode_blob(c: Corpus) -> DataFrame:
    back = decoded_vectors(packed_vectors("embedding"))
    return c.vectors.select(F.col("asset_id").alias("vec_id"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT doc_id, lpad(lower(to_hex(CAST(list_reduce([14695981039346656037::HUGEINT] || list_transform(string_split(source, ''), lambda x: ascii(x)::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))), 16, '0') AS hash FROM documents")
def m10_fnv1a64(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", fnv1a64("source").alias("hash"))


@query("SELECT vec_id, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE) / 2, 6) AS first FROM embeddings")
def m12_mix_to_mono(c: Corpus) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: (F.col("embedding")[i * 2].cast("double") + F.col("embedding")[i * 2 + 1].cast("double")) / 2)
    return c.vectors.select(F.col("asset_id").alias("vec_id"), F.round(pairs[0], 6).alias("first"))


@query("SELECT event_id, CASE WHEN s < 60 THEN 'seconds' WHEN s < 3600 THEN 'minutes' WHEN s < 86400 THEN 'hours' WHEN s < 604800 THEN 'days' ELSE 'weeks' END AS bucket FROM (SELECT event_id, event_id * 500 AS s FROM events)")
def m13_relative_time(c: Corpus) -> DataFrame:
    s = F.col("event_id") * 500
    return c.table("events").select("event_id", F.when(s < 60, "seconds").when(s < 3600, "minutes").when(s < 86_400, "hours").when(s < 604_800, "days").otherwise("weeks").alias("bucket"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'kept' AS reserved FROM events")
def n2_merge_reserved(c: Corpus) -> DataFrame:
    own = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, _: k != "__import")
    merged = F.map_concat(own, F.create_map(F.lit("__import"), F.lit("kept")))
    return c.table("events").select("event_id", merged["k"].cast("long").alias("k"), merged["__import"].alias("reserved"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def n6_jsonish_repair(c: Corpus) -> DataFrame:
    broken = F.concat(F.lit("Sure! ```json\n[{k: "), F.get_json_object("props", "$.k"), F.lit(",},]\n```"))
    return c.table("events").select("event_id", F.get_json_object(jsonish(broken), "$[0].k").cast("long").alias("k"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS cells FROM nation")
def n7_cell_to_json(c: Corpus) -> DataFrame:
    return c.table("nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("cells"))


@query("SELECT user_id, max(value) AS confidence FROM (SELECT user_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT a.user_id, a.value FROM events a WHERE a.event_id % 2 = 1) GROUP BY 1")
def k7_review_merge(c: Corpus) -> DataFrame:
    rows = c.table("events")
    a, b = (rows.filter(f"event_id % 2 = {i}").groupBy("user_id").agg(F.max("value").alias(f"v{i}")) for i in (0, 1))
    return a.join(b, "user_id", "full").select("user_id", F.greatest("v0", "v1").alias("confidence"))


@query("SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM events")
def d3_delete_then_insert(c: Corpus) -> DataFrame:
    rows = c.table("events").select("user_id", "event_id", F.lit("old").alias("state"))
    return R.upserted(rows, rows.filter("user_id % 2 = 0").withColumn("state", F.lit("new")), ["user_id"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_orderkey % 2 = 0))")
def d6_delete_emptied_parents(c: Corpus) -> DataFrame:
    orders = c.table("orders")
    left = R.deleted(orders, orders.filter("o_orderkey % 2 = 0").select("o_orderkey"), "o_orderkey")
    touched = orders.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id")).distinct()
    emptied = R.orphans(touched, left, "id", "o_custkey")
    return R.deleted(c.table("customer"), emptied, "c_custkey").select("c_custkey")


@query("SELECT conv_id, coalesce(max(turn), -1) + 1 AS question, coalesce(max(turn), -1) + 2 AS answer FROM conversations GROUP BY 1")
def d10_persist_exchange(c: Corpus) -> DataFrame:
    return c.table("conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("question"), (F.coalesce(F.max("turn"), F.lit(-1)) + 2).alias("answer"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def d15_conversation_delete(c: Corpus) -> DataFrame:
    gone = c.table("conversations").filter("conv_id % 3 = 0").select("conv_id").distinct()
    return R.deleted(c.table("conversations"), gone, "conv_id").select("conv_id", "turn")


@query('WITH RECURSIVE o AS (SELECT user_id AS device, event_id AS seq, length(props) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT device, 0::BIGINT AS seq, 0::BIGINT AS k, 0 AS open, 0 AS n, 0::BIGINT AS size, 0 AS batch FROM (SELECT DISTINCT device FROM o) UNION ALL SELECT r.device, o.seq, o.k, CASE WHEN o.bytes <= 30 AND n > 0 AND (n >= 5 OR size + o.bytes > 30) THEN open + 1 ELSE open END, CASE WHEN o.bytes > 30 THEN n WHEN n > 0 AND (n >= 5 OR size + o.bytes > 30) THEN 1 ELSE n + 1 END, CASE WHEN o.bytes > 30 THEN size WHEN n > 0 AND (n >= 5 OR size + o.bytes > 30) THEN o.bytes ELSE size + o.bytes END, CASE WHEN o.bytes > 30 THEN -1 WHEN n > 0 AND (n >= 5 OR size + o.bytes > 30) THEN open + 1 ELSE open END FROM r JOIN o ON o.device = r.device AND o.k = r.k + 1) SELECT device, seq, batch FROM r WHERE k > 0')
def c5_batch_split(c: Corpus) -> DataFrame:
    """Batches of a device's changes in their order: by count and by bytes, taken greedily."""
    changes = c.oplog.select(F.col("row_id").alias("device"), "seq", F.length("props").cast("long").alias("bytes"))
    return batches(changes, most_rows=5, most_bytes=30)


@query("SELECT table_name, row_id, max(seq) AS version FROM oplog WHERE seq > 100 GROUP BY 1, 2", "oplog")
def c7_apply_push_results(c: Corpus) -> DataFrame:
    return c.oplog.filter("seq > 100").groupBy("table_name", "row_id").agg(F.max("seq").alias("version"))


@query("SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM events d WHERE d.user_id = events.user_id AND d.event_id > events.event_id) THEN 'deferred' ELSE 'deleted' END AS outcome FROM events WHERE event_id % 7 = 0")
def c12_dirty_cascade_defer(c: Corpus) -> DataFrame:
    rows = c.table("events")
    last = rows.groupBy("user_id").agg(F.max("event_id").alias("last"))
    return rows.filter("event_id % 7 = 0").join(last, "user_id").select("event_id", F.when(F.col("last") > F.col("event_id"), "deferred").otherwise("deleted").alias("outcome"))


@query("SELECT p_partkey, first AS topic FROM part JOIN (SELECT upper(trim(p_brand)) AS name, min(p_partkey) AS first FROM part GROUP BY 1) ON name = upper(trim(p_brand))")
def c14_topic_alias(c: Corpus) -> DataFrame:
    names = c.table("part").select("p_partkey", T.topic_name("p_brand").alias("name"))
    return names.join(names.groupBy("name").agg(F.min("p_partkey").alias("topic")), "name").select("p_partkey", "topic")


@query("SELECT l_orderkey AS page, l_linenumber AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS shown FROM lineitem")
def l5_block_views(c: Corpus) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"))
    return c.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("place"), F.row_number().over(order).cast("long").alias("shown"))


@query()
def l7_reading_order(c: Corpus) -> DataFrame:
    """Lines of a page, columns from left to right, each from top to bottom, after wide lines at the top."""
    lines = c.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 2 * 500.0).alias("x"), (F.col("l_linenumber") * 30.0).alias("y"), F.lit(400.0).alias("width"), F.lit(20.0).alias("height"))
    return reading_order(lines)


@query("SELECT l_orderkey, l_linenumber, least(x, 100) AS x FROM (SELECT *, l_quantity * 3 AS x FROM lineitem WHERE l_discount >= 0.05)")
def l10_detection_filter(c: Corpus) -> DataFrame:
    kept = c.table("lineitem").filter("l_discount >= 0.05").withColumn("box", G.box(F.col("l_quantity") * 3, F.lit(0), F.lit(1), F.lit(1)))
    return kept.filter(G.area(F.col("box")) > 0).select("l_orderkey", "l_linenumber", F.least(F.col("box.x"), F.lit(100.0)).alias("x"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(least(1 - l_tax - 0.1, 1), 0), 6) AS x, l_discount AS y FROM lineitem")
def l13_rotate_annotations(c: Corpus) -> DataFrame:
    """A quarter turn to the right in the unit square: (x, y) of a box of height 0.1 becomes (1 - y - 0.1, x)."""
    return c.table("lineitem").select("l_orderkey", "l_linenumber", F.round(F.greatest(F.least(1 - F.col("l_tax") - 0.1, F.lit(1.0)), F.lit(0.0)), 6).alias("x"), F.col("l_discount").alias("y"))


@query("WITH e AS (SELECT user_id AS key, event_id AS seq, event_id % 3 <> 0 AS submitted, list(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM events), s AS (SELECT *, CASE WHEN past IS NULL THEN 0 ELSE list_reduce(past, lambda s, x: least(greatest(s + x, 0), 2), 0) END AS state FROM e) SELECT key, seq, CASE WHEN submitted THEN CASE state WHEN 0 THEN 'enqueued' ELSE 'coalesced' END ELSE CASE state WHEN 0 THEN 'ignored' WHEN 1 THEN 'finished' ELSE 'rerun' END END AS action FROM s")
def c_jobs_coalesced(c: Corpus) -> DataFrame:
    """Requests and ends of jobs by user, in three runs of one stream, whose state goes on from run to run."""
    folder = fresh_path(c.spark, "jobs")
    events = c.table("events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("seq"), (F.col("event_id") % 3 != 0).alias("submitted"))
    buckets = jobs.buckets_for(events.count())
    borders = [-1, *(round(x) for x in events.approxQuantile("seq", [0.33, 0.66], 0.01)), 1 << 62]
    for low, high in zip(borders[:-1], borders[1:]):
        events.filter((F.col("seq") > low) & (F.col("seq") <= high)).write.mode("append").parquet(f"{folder}/events")
        stream = jobs.coalesced(c.spark.readStream.schema(events.schema).parquet(f"{folder}/events"), buckets)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/actions").trigger(availableNow=True).start().awaitTermination()
    return c.spark.read.parquet(f"{folder}/actions")


@query()
def l6_overlap_columns(c: Corpus) -> DataFrame:
    """Columns of the line items of an order, as regions on a page; SQL can't go through them greedily, so a test does."""
    rows = c.table("lineitem").withColumn("region", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    return overlap_columns(rows.select(F.col("l_orderkey").alias("page"), "region", (F.col("l_partkey") % 900).alias("x"), (F.col("l_suppkey") % 700).alias("y"), (F.col("l_quantity") * 8).cast("long").alias("width")))


@query()
def s15_file_digests(c: Corpus) -> DataFrame:
    """The files of all tables by content; SQL can't list a folder, so a test hashes them again."""
    rows = files.digested(c.spark, c.folder, fresh_path(c.spark, "digests"), "*.parquet")
    return rows.select(F.substring_index("path", "/", -1).alias("name"), "length", "sha256")


@query("SELECT collection_id, id, assets, row_number() OVER (PARTITION BY collection_id ORDER BY id) = 1 AS head, row_number() OVER (PARTITION BY collection_id ORDER BY id DESC) = 1 AS tail FROM (SELECT i.collection_id, i.id, count(a.id) AS assets FROM items i LEFT JOIN assets a ON a.item_id = i.id GROUP BY 1, 2)", "items", "assets")
def a13_collection_documents(c: Corpus) -> DataFrame:
    """The nested documents of all collections, as their pieces tell: each item with its assets, and which of them brings the head and the tail."""
    path = fresh_path(c.spark, "documents")
    assets = c.assets.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "path", "size"))).alias("assets"))  # four of an item
    items = c.items.join(assets, F.col("id") == F.col("item_id"), "left").select("collection_id", "id", F.to_json(F.struct("id", "title", "metadata", F.coalesce("assets", F.array().cast(assets.schema["assets"].dataType)).alias("assets"))).alias("document"))
    exports.nested(c.collections.select("id", "name"), items, path)
    told = c.spark.read.text(path)
    body = F.regexp_replace(F.regexp_replace("value", r'^\{"version":3,"collection":\{[^{}]*\},"items":\[', ""), r",$|\]\}$", "")
    item = F.from_json(body, "id long, assets array<struct<id:long>>")
    return told.select(F.col("collection").alias("collection_id"), item["id"].alias("id"), F.size(item["assets"]).cast("long").alias("assets"), F.startswith("value", F.lit('{"version":3,')).alias("head"), F.endswith("value", F.lit("]}]}")).alias("tail"))


@query(f"WITH w AS ({_WORDS}), v AS (SELECT doc_id, row_number() OVER (PARTITION BY source, doc_id // 6, doc_id % 2 ORDER BY doc_id % 97 DESC, doc_id) AS n FROM documents) SELECT source AS collection, word, count(*) AS count FROM w JOIN v USING (doc_id) WHERE n = 1 AND {_KEPT} GROUP BY 1, 2")
def a15_corpus_frequencies(c: Corpus) -> DataFrame:
    """Words of the newest extraction and the newest transcription of each asset, by collection; here six documents are versions of one asset."""
    rows = c.documents.select("source", F.floor(F.col("doc_id") / 6).alias("asset"), (F.col("doc_id") % 2).alias("kind"), F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 97).alias("created_at"))
    latest = R.latest_texts(rows, "source", "asset", "kind")
    return latest.select(F.col("source").alias("collection"), F.explode(T.words("text")).alias("word")).groupBy("collection", "word").agg(F.count("*").alias("count"))


@query("SELECT o_orderkey, array_to_string(CASE WHEN m <= 0 THEN [0.0::DOUBLE] ELSE list_transform(range(0, CAST(ceil(m / step) AS BIGINT) + 1), lambda i: round(i * step, 3)) END, ' ') AS ticks FROM (SELECT *, CASE WHEN r <= 1 THEN 1 WHEN r <= 2 THEN 2 WHEN r <= 5 THEN 5 ELSE 10 END * g AS step FROM (SELECT *, raw / g AS r FROM (SELECT *, 10.0::DOUBLE ** floor(log10(raw)) AS g FROM (SELECT o_orderkey, m, CASE WHEN m > 0 THEN m / 4 ELSE 1 END AS raw FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice / 1000 END::DOUBLE AS m FROM orders)))))")
def a20_chart_ticks(c: Corpus) -> DataFrame:
    most = F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(F.col("o_totalprice") / 1000).cast("double")
    return c.table("orders").select("o_orderkey", F.array_join(N.ticks(most).cast("array<string>"), " ").alias("ticks"))


@query("SELECT event_id, CASE unit WHEN 'second' THEN trunc(s) WHEN 'minute' THEN trunc(s / 60) WHEN 'hour' THEN trunc(s / 3600) WHEN 'day' THEN trunc(s / 86400) WHEN 'month' THEN trunc(s / 2592000) ELSE trunc(s / 31536000) END::BIGINT AS value, unit FROM (SELECT *, CASE WHEN abs(s) < 60 THEN 'second' WHEN abs(s) < 3600 THEN 'minute' WHEN abs(s) < 86400 THEN 'hour' WHEN abs(s) < 2592000 THEN 'day' WHEN abs(s) < 31536000 THEN 'month' ELSE 'year' END AS unit FROM (SELECT event_id, floor((CASE WHEN event_id % 2 = 0 THEN 1700000000000 - (event_id % 5000) * (event_id % 5000) * 20000 ELSE (1700000000 + (event_id % 20000) * (event_id % 20000)) * 1000 END - 1700000000000) / 1000.0 + 0.5)::DOUBLE AS s FROM events))")
def m13_time_from_now(c: Corpus) -> DataFrame:
    """Times before now in milliseconds, and after now in seconds."""
    e = F.col("event_id").cast("long")
    created = F.when(e % 2 == 0, 1_700_000_000_000 - (e % 5000) * (e % 5000) * 20_000).otherwise(1_700_000_000 + (e % 20_000) * (e % 20_000))
    return c.table("events").select("event_id", N.relative_time(created, F.lit(1_700_000_000_000)).alias("r")).select("event_id", "r.value", "r.unit")


@query("SELECT o_orderkey AS page, coalesce(n, 0) < 2 OR (area > 0 AND coalesce(largest, 0) > 0.6 * area) AS bypass FROM (SELECT o_orderkey, (o_orderkey % 4) * 40 * 30.0::DOUBLE AS area FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity * l_linenumber * 8) AS largest FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def l12_layout_bypass(c: Corpus) -> DataFrame:
    """Orders as pages, their line items as regions."""
    pages = c.table("orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 4 * 40).alias("width"), F.lit(30).alias("height"))
    return G.bypassed(pages, c.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("width"), (F.col("l_linenumber") * 8).alias("height")))

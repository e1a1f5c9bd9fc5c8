"""Texts, metadata and entities of records: what a search box, a log, a prompt or a form does with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektra.functions import logs
from lektra.functions import text as T
from lektra.functions.udfs import pretty_json
from lektra.operators import knowledge as K
from lektra.operators import relational as R
from lektra.operators import search as S
from lektra.plans.catalog import query
from lektra.plans.search import _ranked, _texts
from lektra.sources import index
from lektra.sources.corpus import Corpus

_LINE = "CASE event_id % 6 WHEN 0 THEN 'login token=abc' || event_id || ' ok' WHEN 1 THEN 'Bearer ' || md5(CAST(event_id AS VARCHAR)) || ' sent' WHEN 2 THEN 'plain  line ' || event_id WHEN 3 THEN 'password: hunter2 next ' || event_id WHEN 4 THEN 'key ' || md5(CAST(event_id AS VARCHAR)) ELSE 'secret \"' || md5(CAST(event_id AS VARCHAR)) || '\", x ' || md5(event_type) END"


def _line():
    e, hashed = F.col("event_id").cast("string"), F.md5(F.col("event_id").cast("string"))
    kind = F.col("event_id") % 6
    return (
        F.when(kind == 0, F.concat(F.lit("login token=abc"), e, F.lit(" ok"))).when(kind == 1, F.concat(F.lit("Bearer "), hashed, F.lit(" sent"))).when(kind == 2, F.concat(F.lit("plain  line "), e))
        .when(kind == 3, F.concat(F.lit("password: hunter2 next "), e)).when(kind == 4, F.concat(F.lit("key "), hashed)).otherwise(F.concat(F.lit('secret "'), hashed, F.lit('", x '), F.md5("event_type")))
    )


@query(f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'login [redactado] ok' WHEN 1 THEN '[redactado] [redactado] sent' WHEN 3 THEN '[redactado] [redactado] next ' || event_id WHEN 5 THEN '[redactado] [redactado] x [redactado]' ELSE {_LINE} END AS line FROM events")
def x28_redact_sensitive(c: Corpus) -> DataFrame:
    return c.table("events").select("event_id", logs.redacted(_line()).alias("line"))


@query("SELECT event_id, CASE WHEN length(event_type) > 5 THEN 'a b' || substring(event_type, 1, 2) || '… [truncado]' ELSE 'a b' || event_type END AS field FROM events")
def x28_log_field(c: Corpus) -> DataFrame:
    """Control characters blank, and what exceeds the limit cut."""
    most = F.when(F.length("event_type") > 5, F.concat(F.lit("a\x01b"), F.substring("event_type", 1, 2), F.lit("xxxxx"))).otherwise(F.concat(F.lit("a\x01b"), "event_type"))
    limit = 5
    long = logs.log_field(most, limit)
    short = logs.log_field(most, 100)
    return c.table("events").select("event_id", F.when(F.length("event_type") > 5, long).otherwise(short).alias("field"))


_RAW = "title || ' AND (foo-bar*) foo near \"x\" x, not.end'"


@query(f"SELECT id, array_to_string(list_transform(list_filter(w, lambda x, i: i = 1 OR w[i - 1] <> x), lambda x: '\"' || x || '\"'), ' ') AS query FROM (SELECT id, list_filter(regexp_split_to_array(translate(translate({_RAW}, '\"()*^', ''), '-:,.', '    '), '\\s+'), lambda x: x <> '' AND upper(x) NOT IN ('AND', 'OR', 'NOT', 'NEAR')) AS w FROM items)", "items")
def x6_search_queries(c: Corpus) -> DataFrame:
    raw = F.concat("title", F.lit(' AND (foo-bar*) foo near "x" x, not.end'))
    return c.items.select("id", T.search_query(raw).alias("query"))


@query("SELECT id, list_transform(list_sort(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x, i: {'n': -length(x), 'i': i, 'x': x})), lambda s: s.x) AS terms FROM (SELECT id, list_filter(list_transform(string_split(title, ' '), lambda x: lower(regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'))), lambda x: length(x) >= 4) AS w FROM items)", "items")
def x7_query_terms(c: Corpus) -> DataFrame:
    return c.items.select("id", T.terms_of("title").alias("terms"))


_SEGMENTS = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"SELECT doc_id, CAST(coalesce(min(CASE WHEN contains(lower(s), 'thing') THEN i END), min(CASE WHEN total > 150 THEN i END)) * 5 - 5 AS DOUBLE) AS start FROM (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM ({_SEGMENTS})) GROUP BY 1 HAVING start IS NOT NULL")
def x9_resolved_timestamps(c: Corpus) -> DataFrame:
    """When a source was said: the first segment with a term, else the one that holds character 150."""
    segments = F.transform(F.split("text", "\n"), lambda s, i: F.struct((i * 5).cast("double").alias("start"), (i * 5 + 5).cast("double").alias("end"), s.alias("text")))
    return c.documents.select("doc_id", T.said_at(segments, ["thing"], F.lit(150))["start"].alias("start")).filter("start is not null")


@query("SELECT id, trim(regexp_replace(title, '^[\"''“”‘’«»\\-–—\\s]+|[\"''“”‘’«»\\-–—\\s]+$', '', 'g')) AS value FROM items", "items")
def x19_manual_values(c: Corpus) -> DataFrame:
    return c.items.select("id", T.manual_value(F.concat(F.lit(" «- "), "title", F.lit(" –' "))).alias("value"))


@query("SELECT id, id % 4 = 0 OR id % 4 = 1 AS member FROM (SELECT doc_id AS id FROM documents)")
def x30_version_family(c: Corpus) -> DataFrame:
    """Which files are versions of the same picture."""
    base = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 4
    name = F.when(kind == 0, F.concat(base, F.lit(".JPG"))).when(kind == 1, F.concat(base, F.lit("_v12.png"))).when(kind == 2, F.concat(base, F.lit("_vX.png"))).otherwise(F.concat(base, F.lit("_final_v2.pdf")))
    return c.documents.select(F.col("doc_id").alias("id"), T.in_version_family(name, base).alias("member"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'assets/' || source || '/a.png' END AS rel, CASE id % 4 WHEN 1 THEN 'outside' WHEN 2 THEN 'not_under_assets' WHEN 3 THEN 'empty' END AS error FROM (SELECT doc_id AS id, source FROM documents)")
def x31_derived_paths(c: Corpus) -> DataFrame:
    kind = F.col("doc_id") % 4
    path = F.when(kind == 0, F.concat(F.lit("C:\\data\\assets\\"), "source", F.lit("\\a.png"))).when(kind == 1, "/tmp/assets/a.png").when(kind == 2, "C:/data/other/a.png").otherwise("  ")
    return c.documents.select(F.col("doc_id").alias("id"), T.relative_path(path, "C:\\data").alias("r")).select("id", "r.rel", "r.error")


@query("SELECT conversation_id, string_agg(CASE role WHEN 'assistant' THEN 'Asistente: ' ELSE 'Usuario: ' END || substring(trim(content), 1, 100), chr(10) ORDER BY sort_index) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sort_index DESC) AS n FROM messages) WHERE n <= 6 AND trim(content) <> '' GROUP BY 1", "messages")
def x32_last_turns(c: Corpus) -> DataFrame:
    return S.history(c.messages, most_turns=6, most_chars=100)


@query("SELECT source AS collection, string_agg('[' || n || '] «' || title || '» (' || source || '):' || chr(10) || substring(text, 1, 40), chr(10) || chr(10) ORDER BY n) AS fragments FROM (SELECT source, text, title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents JOIN items ON id = doc_id) WHERE n <= 3 GROUP BY 1", "items")
def x32_fragments(c: Corpus) -> DataFrame:
    """The first three documents of each collection, as a prompt quotes them."""
    first = Window.partitionBy("source").orderBy("doc_id")
    titles = c.items.select(F.col("id").alias("doc_id"), "title")
    shown = c.documents.withColumn("n", F.row_number().over(first)).filter("n <= 3").join(titles, "doc_id")
    return S.fragments(shown.select(F.col("source").alias("of"), "n", "title", F.col("source").alias("collection"), F.substring("text", 1, 40).alias("snippet"))).select(F.col("of").alias("collection"), "fragments")


@query("SELECT event_id, event_id % 3 = 0 AS is_json, CASE event_id % 3 WHEN 0 THEN '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || ',' || chr(10) || '  \"l\": [' || chr(10) || '    1,' || chr(10) || '    \"é\"' || chr(10) || '  ]' || chr(10) || '}' WHEN 1 THEN '—' ELSE repeat('x', CAST(event_id % 200 AS INT)) END AS expanded, event_id % 3 = 0 OR (event_id % 3 = 2 AND event_id % 200 > 120) AS can_expand FROM events")
def x33_cells(c: Corpus) -> DataFrame:
    """Cells of a table browser: JSON laid out over lines, nulls as a dash, long texts to expand."""
    kind = F.col("event_id") % 3
    value = F.when(kind == 0, F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"l":[1,"é"]}'))).when(kind == 2, F.expr("repeat('x', cast(event_id % 200 as int))"))
    rows = c.table("events").select("event_id", value.alias("value")).withColumn("pretty", pretty_json("value"))
    text = F.coalesce("pretty", "value", F.lit("—"))
    return rows.select("event_id", F.col("pretty").isNotNull().alias("is_json"), text.alias("expanded"), F.coalesce(F.col("pretty").isNotNull() | (F.length("value") > 120), F.lit(False)).alias("can_expand"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_id % 4 WHEN 0 THEN 'spacy' WHEN 1 THEN 'asr' WHEN 2 THEN 'ocr' END AS shape FROM events WHERE event_id % 4 <> 3")
def s10_marked_outputs(c: Corpus) -> DataFrame:
    """JSON between the marks of three tools, with noise around; output without marks is left out."""
    name = F.get(F.array(F.lit("SPACY_NER"), F.lit("ASR"), F.lit("OCR")), (F.col("event_id") % 4).cast("int"))
    said = F.concat(F.lit("noise {}\n==="), name, F.lit("_JSON_BEGIN===\n"), "props", F.lit("\n==="), name, F.lit("_JSON_END===\nbye"))
    rows = c.table("events").select("event_id", F.coalesce(said, F.lit("no marks")).alias("said"))
    found = rows.select("event_id", T.between_marks("said").alias("m")).filter("m is not null")
    shape = F.lower(F.regexp_replace("m.name", "_NER$", ""))
    return found.select("event_id", F.get_json_object("m.body", "$.k").cast("long").alias("k"), shape.alias("shape"))


@query("SELECT name FROM (SELECT table_name AS name FROM information_schema.tables) WHERE name IN ('documents', 'pages', 'labels', 'conversations', 'benchmark', 'embeddings')")
def s5_catalog_list_tables(c: Corpus) -> DataFrame:
    """The tables of the allowed ones that the folder has."""
    return c.listed(("documents", "pages", "labels", "conversations", "benchmark", "embeddings", "settings", "sync_oplog"))


_OFFSET = "(event_id * 7919) % 1000000 - 500000"


@query(f"SELECT event_id, {_OFFSET} AS offset_ms, abs({_OFFSET}) > 300000 AS warning FROM events")
def m5_clock_offset(c: Corpus) -> DataFrame:
    """Server time less local time, and whether it is worth a warning."""
    server = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = c.table("events").select("event_id", server.alias("server"), (server - ((F.col("event_id") * 7919) % 1_000_000 - 500_000)).alias("local"))
    return rows.select("event_id", T.clock_offset("server", "local").alias("o")).select("event_id", "o.offset_ms", "o.warning")


@query("SELECT conv_id, turn FROM conversations WHERE contains(CAST(conv_id AS VARCHAR), '7') OR contains(CAST(turn AS VARCHAR), '7') OR contains(lower(role), '7') OR contains(lower(text), '7')")
def f9_any_column(c: Corpus) -> DataFrame:
    return R.any_column_contains(c.table("conversations"), " 7 ").select("conv_id", "turn")


@query("SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM labels) + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS score")
def g21_richness(c: Corpus) -> DataFrame:
    """Rows of all tables that make a corpus rich."""
    return R.richness(*(c.table(t) for t in ("documents", "pages", "labels", "conversations", "embeddings", "benchmark", "events", "orders", "customer")))


def _entities(c: Corpus) -> DataFrame:
    e = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("GPE", "persona", "Fecha", "otro", "animal", "lugar"))), (e % 6).cast("int"))
    return c.table("events").select(e.alias("id"), F.col("user_id").alias("item_id"), kind.alias("alias"), F.concat(F.lit("Place "), (e % 50).cast("string")).alias("value"), F.when(e % 5 == 0, "pending").otherwise("resolved").alias("geo_status"), F.when(e % 7 == 0, "manual_deleted").when(e % 2 == 0, "llm").alias("source"))


_ALIAS = "['place','person','date','misc',NULL,'place'][event_id % 6 + 1]"


@query(f"SELECT event_id AS id, user_id AS item_id, 'Place ' || event_id % 50 AS value FROM events WHERE {_ALIAS} = 'place' AND event_id % 5 = 0 AND event_id % 7 <> 0")
def f11_pending_places(c: Corpus) -> DataFrame:
    rows = _entities(c).withColumn("type", K.entity_type(F.col("alias")))
    return K.pending_places(rows).select("id", "item_id", "value")


@query(f"SELECT user_id AS item_id, 'place ' || event_id % 50 AS key, {_ALIAS} AS type, min(event_id) AS first FROM events WHERE {_ALIAS} IS NOT NULL GROUP BY 1, 2, 3")
def k2_local_entities(c: Corpus) -> DataFrame:
    """Answers of a local model: aliases of types in any case, unknown types go, of equal values of a type the first stays."""
    e = _entities(c)
    raw = e.select("item_id", "id", F.to_json(F.array(F.struct(F.concat(F.lit(" "), "value", F.lit(".")).alias("value"), F.col("alias").alias("type")))).alias("result"), F.lit("").alias("text"))
    each = K.parsed_entities(raw.select(F.concat_ws(":", "item_id", "id").alias("item_id"), "text", "result"), default=0.85)
    parts = F.split("item_id", ":")
    found = each.select(parts[0].cast("long").alias("item_id"), parts[1].cast("long").alias("id"), T.entity_key("value").alias("key"), "type")
    return found.groupBy("item_id", "key", "type").agg(F.min("id").alias("first"))


@query("SELECT doc_id AS item_id, lower(w) AS key, CAST(CASE WHEN doc_id % 2 = 0 THEN 7 ELSE strpos(lower(text), lower(w)) - 1 END AS INT) AS start, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.99 ELSE 0.95 END AS DOUBLE) AS confidence FROM (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]+') AS w FROM documents WHERE lang = 'en') WHERE doc_id % 5 <> 0 AND length(w) > 3")
def k7_reviewed_entities(c: Corpus) -> DataFrame:
    """Entities that a reviewer's answer keeps: spans from equal candidates, else from the text; protected ones go."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    docs = c.documents.filter("lang = 'en'").select(F.col("doc_id").alias("item_id"), "text", word.alias("word")).filter(F.length("word") > 3)
    review = F.concat(F.lit("Here: ```json\n["), F.to_json(F.struct(F.col("word").alias("value"), F.lit("person").alias("type"))), F.lit(","), F.to_json(F.struct(F.lit("x").alias("value"), F.lit("robot").alias("type"))), F.lit("]\n```"))
    candidates = docs.filter("item_id % 2 = 0").select("item_id", F.upper("word").alias("value"), F.lit("person").alias("type"), F.lit(7).alias("start"), (F.length("word") + 7).alias("end"), F.lit(0.99).alias("confidence"))
    protected = docs.filter("item_id % 5 = 0").select("item_id", F.col("word").alias("value"), F.lit("person").alias("type"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    found = K.reviewed(docs.select("item_id", "text", review.alias("review")), candidates, protected)
    return found.select("item_id", T.entity_key("value").alias("key"), "start", "confidence")


@query("SELECT l_orderkey AS item_id, l_partkey AS asset_id, CASE WHEN l_orderkey % 3 <> 2 AND l_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_partkey % 2 = 0 OR NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_orderkey = lineitem.l_orderkey AND e.l_partkey % 2 = 0)")
def k9_replaced_triples(c: Corpus) -> DataFrame:
    """New triples of an item take the place of all of that item; those of an asset, of that asset of the item alone."""
    rows = c.table("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("asset_id"))
    old, fresh = rows.withColumn("state", F.lit("old")), rows.filter("asset_id % 2 = 0").withColumn("state", F.lit("new"))
    by_item = K.replaced_in(old, fresh.filter("item_id % 3 = 0"), ["item_id"])
    return K.replaced_in(by_item, fresh.filter("item_id % 3 = 1"), ["item_id", "asset_id"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 'f' || event_id END AS reserved FROM events")
def n2_merged_metadata(c: Corpus) -> DataFrame:
    """A form's metadata with the reserved entry of the source, where the source has one."""
    own = F.from_json("props", "map<string,string>")
    source = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"__import":{"name":"f'), F.col("event_id").cast("string"), F.lit('"},"k":"old"}'))).when(F.col("event_id") % 3 == 1, '{"k":"old"}')
    merged = T.merged_metadata(own, source, "__import")
    return c.table("events").select("event_id", F.get_json_object(merged, "$.k").cast("long").alias("k"), F.get_json_object(merged, "$.__import.name").alias("reserved"))


@query("SELECT id, label, value FROM (SELECT id, unnest([{'label': 'Nombre del archivo', 'value': id || '.' || e}, {'label': 'Tipo de archivo', 'value': upper(type)}, {'label': 'Extensión', 'value': lower(e)}, {'label': 'Asset ID', 'value': CAST(id AS VARCHAR)}, {'label': 'Ruta interna', 'value': path}], recursive := true) FROM (SELECT *, string_split(path, '.')[2] AS e FROM assets)) WHERE NOT (label = 'Tipo de archivo' AND id % 2 = 0) AND NOT (label = 'Extensión' AND id % 3 = 0)", "assets")
def n3_technical_metadata(c: Corpus) -> DataFrame:
    """What a file tells of itself, without what the user's own keys already say."""
    keys = F.filter(F.array(F.when(F.col("id") % 2 == 0, "Mime  TYPE"), F.when(F.col("id") % 3 == 0, "éxtension")), lambda k: k.isNotNull())
    told = T.technical_metadata(T.base_name("path"), F.col("type"), F.col("id").cast("string"), F.col("path"), keys)
    return c.assets.select("id", F.explode(told).alias("m")).select("id", "m.label", "m.value")


@query("WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id, turn, role, text AS content FROM conversations UNION ALL SELECT conv_id, last + 1, 'user', 'Question ' || conv_id FROM l WHERE conv_id % 4 = 0 UNION ALL SELECT conv_id, last + 2, 'assistant', 'Answer' FROM l WHERE conv_id % 4 = 0 UNION ALL SELECT -1, 0, 'user', 'First' UNION ALL SELECT -1, 1, 'assistant', 'Answer'")
def d10_persisted_exchanges(c: Corpus) -> DataFrame:
    """Question and answer at the end of a conversation; one that isn't there yet begins with them."""
    old = c.table("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    asked = old.select("conv_id").distinct().filter("conv_id % 4 = 0").select("conv_id", F.concat(F.lit("Question "), F.col("conv_id").cast("string")).alias("question"), F.lit("Answer").alias("answer"))
    asked = asked.union(c.spark.createDataFrame([(-1, "First", "Answer")], "conv_id long, question string, answer string"))
    return R.exchanged(old, asked)


@query("SELECT conv_id, turn, role, text AS content, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 2 ELSE 0 END AS sources FROM conversations WHERE conv_id % 10 = 3")
def a18_conversation(c: Corpus) -> DataFrame:
    """Whole conversations in order; sources are decoded from their JSON, what is none counts as none."""
    raw = F.when(F.col("role") == "assistant", F.when(F.col("turn") % 3 == 0, '[{"index":1},{"index":2}]').when(F.col("turn") % 3 == 1, "not json"))
    rows = c.table("conversations").filter("conv_id % 10 = 3").select("conv_id", "turn", "role", F.col("text").alias("content"), raw.alias("raw"))
    sources = F.coalesce(F.size(F.from_json("raw", "array<struct<index:int>>")), F.lit(0))
    return rows.select("conv_id", "turn", "role", "content", F.greatest(sources, F.lit(0)).alias("sources")).orderBy("conv_id", "turn")


_CONTEXT = f"SELECT title, text, row_number() OVER (ORDER BY rank, h.id) AS n FROM ({_ranked(['the', 'that'], True)}) h JOIN items i ON i.id = h.id JOIN documents d ON d.doc_id = h.id WHERE i.collection_id = 'src1' ORDER BY rank, h.id LIMIT 5"


@query(f"SELECT substring(string_agg('--- ' || title || ' ---' || chr(10) || substring(text, 1, 1200) || chr(10) || chr(10), '' ORDER BY n), 1, 3000) AS context FROM ({_CONTEXT})", "items")
def a14_ask_context(c: Corpus) -> DataFrame:
    """What a question gets to read: the five best items of a collection, 1200 characters of each, 3000 in all."""
    hits = index.search(c.spark, c.text_index, T.search_terms_core("the-that"))
    return S.context(hits, c.items.filter("collection_id = 'src1'").select("id", "title"), _texts(c), items=5, most_chars=1200, budget=3000)


@query("SELECT vec_id, unnest(range(len(embedding) // 2)) AS place, unnest(list_transform(range(len(embedding) // 2), lambda i: round((embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2, 6))) AS sample FROM embeddings")
def m12_mono(c: Corpus) -> DataFrame:
    from lektra.functions.numbers import mono

    rows = c.vectors.select(F.col("asset_id").alias("vec_id"), F.posexplode(mono("embedding", 2)).alias("place", "sample"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.round("sample", 6).alias("sample"))


@query("SELECT vec_id, i AS place, round(CASE WHEN CAST(floor(i * 1.5) AS BIGINT) + 1 < n THEN e[CAST(floor(i * 1.5) AS BIGINT) + 1] * (1 - (i * 1.5 - floor(i * 1.5))) + e[CAST(floor(i * 1.5) AS BIGINT) + 2] * (i * 1.5 - floor(i * 1.5)) ELSE e[CAST(floor(i * 1.5) AS BIGINT) + 1] END, 6) AS sample FROM (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS n, unnest(range(CAST(ceil(len(embedding) / 1.5) AS BIGINT))) AS i FROM embeddings)")
def m12_resampled(c: Corpus) -> DataFrame:
    from lektra.functions.numbers import resampled

    rows = c.vectors.select(F.col("asset_id").alias("vec_id"), F.posexplode(resampled("embedding", 24_000, 16_000)).alias("place", "sample"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.round("sample", 6).alias("sample"))

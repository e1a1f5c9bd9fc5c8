"""Queries on replicated rows: pushes, deferred and parked changes, conflicts, cascades, sessions, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.operators import replicas as R
from lektra.operators.relational import dealt, inserted, tasks_for
from lektra.operators.settling import fresh_path, settled
from lektra.plans.catalog import query
from lektra.sources import exports, index
from lektra.sources.corpus import Corpus

_RESULTS = "SELECT DISTINCT event_type AS table_name, user_id AS row_id, CASE user_id % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'lww_won' ELSE 'lww_lost' END AS status, user_id * 10 AS server_seq, CASE WHEN user_id % 2 = 0 THEN user_id * 10 + 5 END AS winner_seq FROM events WHERE user_id % 5 <> 0"
_LATER = "EXISTS (SELECT 1 FROM oplog o WHERE o.table_name = r.table_name AND o.row_id = r.row_id AND o.seq > 800)"
_PUSH = f"WITH oplog AS (SELECT event_id AS seq, event_type AS table_name, user_id AS row_id FROM events), r AS ({_RESULTS}), x AS (SELECT r.*, status = 'lww_lost' AS lost, status = 'lww_lost' AND {_LATER} AS skipped FROM r) "


def _pushed(c: Corpus) -> dict[str, DataFrame]:
    rows = c.table("events").filter("user_id % 5 <> 0").select(F.col("event_type").alias("table_name"), F.col("user_id").alias("row_id")).distinct()
    u = F.col("row_id")
    results = rows.select("table_name", "row_id", F.when(u % 3 == 0, "applied").when(u % 3 == 1, "lww_won").otherwise("lww_lost").alias("status"), (u * 10).alias("server_seq"), F.when(u % 2 == 0, u * 10 + 5).alias("winner_seq"), F.lit("d1").alias("winner_device"))
    oplog = c.oplog.select("seq", "table_name", "row_id")
    versions = oplog.select("table_name", "row_id", F.lit(1).cast("long").alias("server_seq")).distinct()
    return R.pushed(results, oplog, versions, 800)


@query(_PUSH + "SELECT o.* FROM oplog o WHERE seq > 800 OR NOT EXISTS (SELECT 1 FROM r WHERE r.table_name = o.table_name AND r.row_id = o.row_id)")
def c7_oplog_after_push(c: Corpus) -> DataFrame:
    return _pushed(c)["oplog"]


@query(_PUSH + "SELECT 'lww-' || table_name || '-' || row_id || '-' || server_seq AS id, CASE WHEN winner_seq IS NULL THEN 'server_seq=' || server_seq ELSE 'server_seq=' || winner_seq || ' device=d1' END AS winner_summary FROM x WHERE lost")
def c7_conflicts_after_push(c: Corpus) -> DataFrame:
    return _pushed(c)["conflicts"].select("id", "winner_summary")


@query(_PUSH + "SELECT table_name, row_id, winner_seq AS server_seq FROM x WHERE lost AND NOT skipped AND winner_seq IS NOT NULL")
def c7_winners_after_push(c: Corpus) -> DataFrame:
    return _pushed(c)["winners"].drop("winner_device")


@query(_PUSH + "SELECT table_name, row_id, CASE WHEN lost THEN coalesce(winner_seq, server_seq) ELSE server_seq END AS server_seq FROM x WHERE NOT skipped UNION ALL SELECT DISTINCT table_name, row_id, 1 FROM oplog o WHERE NOT EXISTS (SELECT 1 FROM x WHERE NOT skipped AND x.table_name = o.table_name AND x.row_id = o.row_id)")
def c7_versions_after_push(c: Corpus) -> DataFrame:
    return _pushed(c)["versions"]


@query("SELECT c_custkey AS row_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderkey % 50 = 0 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 40 = 0))) THEN 'deferred' ELSE 'applied' END AS outcome FROM customer WHERE c_custkey % 3 = 0")
def c12_deferred_tombstones(c: Corpus) -> DataFrame:
    """Tombstones wait while a row below them, one or two edges down, has a change that wasn't pushed."""
    line = c.table("lineitem").select((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"), "l_partkey")
    orders = c.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"))
    dirty = orders.filter("id % 50 = 0").select(F.lit("orders").alias("table_name"), F.col("id").alias("row_id")).union(line.filter("l_partkey % 40 = 0").select(F.lit("lines"), "id"))
    gone = c.table("customer").filter("c_custkey % 3 = 0").select(F.lit("customers").alias("table_name"), F.col("c_custkey").alias("row_id"))
    edges = (("customers", "orders", "customer_id"), ("orders", "lines", "order_id"))
    waits = R.deferred(gone, {"orders": orders, "lines": line}, dirty, edges).select("row_id", F.lit("deferred").alias("outcome"))
    return gone.join(waits, "row_id", "left").select("row_id", F.coalesce("outcome", F.lit("applied")).alias("outcome"))


@query("WITH RECURSIVE t AS (SELECT event_id AS row_id, CASE WHEN event_id % 100 = 0 THEN 'applied' ELSE 'parent_deleted' END AS outcome FROM events WHERE event_id % 100 IN (0, 60) UNION ALL SELECT row_id + 1, outcome FROM t WHERE (row_id + 1) % 20 <> 0 AND EXISTS (SELECT 1 FROM events WHERE event_id = row_id + 1)) SELECT event_id AS row_id, coalesce(outcome, 'parked') AS outcome FROM events LEFT JOIN t ON row_id = event_id")
def c13_parked_to_the_fixpoint(c: Corpus) -> DataFrame:
    """Chains of twenty rows: some hang on a row that is there, some on a deleted one, the others on one that never comes."""
    e = F.col("event_id")
    parent = F.when(e % 100 == 0, F.lit(-1)).when(e % 100 == 60, F.lit(-2)).when(e % 20 == 0, F.lit(-3)).otherwise(e - 1)
    ids = lambda n: c.spark.range(1).select(F.lit(n).cast("long").alias("id"))
    return R.drained(c.table("events").select(e.alias("row_id"), parent.alias("parent_id")), ids(-1), ids(-2)).select("row_id", "outcome")


_CONFLICTS = "SELECT 'c' || event_id AS id, epoch_us(ts) // 1000 AS created_at, event_id % 4 = 0 AS acknowledged FROM events"


def _conflicts(c: Corpus) -> DataFrame:
    return c.table("events").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), (F.col("event_id") % 4 == 0).alias("acknowledged"))


@query(f"SELECT * FROM ({_CONFLICTS}) ORDER BY created_at DESC, id DESC LIMIT 500 OFFSET 20")
def c19_conflict_page(c: Corpus) -> DataFrame:
    return R.conflict_page(_conflicts(c), 900, 20)


@query(f"SELECT id, created_at, acknowledged OR substring(id, 2)::BIGINT % 6 = 1 AS acknowledged FROM ({_CONFLICTS})")
def c19_acknowledged_conflicts(c: Corpus) -> DataFrame:
    told = c.table("events").filter("event_id % 6 = 1").select(F.concat(F.lit("c"), F.col("event_id").cast("string")))
    return R.acknowledged(_conflicts(c), told)


@query("SELECT 'sync_oplog' AS name, 0 AS rows UNION ALL SELECT 'sync_conflicts', 0 UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'sync_meta', 1 UNION ALL SELECT 'sync_blob_index', count(*) FROM documents UNION ALL SELECT 'uploaded', 0")
def c20_logout(c: Corpus) -> DataFrame:
    """What is left of each table after the end of a session, and how many blobs still count as uploaded."""
    meta = c.spark.createDataFrame([("device_id", "d"), ("last_pull_seq", "7"), ("theme", "dark")], "key string, value string")
    blobs = c.documents.select(F.md5("text").alias("hash"), F.lit(True).alias("uploaded"))
    made = R.session_ended({"sync_oplog": c.oplog, "sync_conflicts": _conflicts(c), "documents": c.documents}, meta, blobs)
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in made.items()]
    counts.append(made["sync_blob_index"].agg(F.lit("uploaded").alias("name"), F.count_if("uploaded").alias("rows")))
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def _tasks(c: Corpus) -> int:
    return tasks_for(c.table("lineitem").count(), c.table("orders").count())


def _model(c: Corpus) -> dict[str, DataFrame]:
    """The tables that hang on collections, from customers (collections), orders (items) and lines (assets)."""
    items = c.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("collection_id"))
    assets = c.table("lineitem").select((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("item_id"))
    assets = settled(dealt(assets, "item_id", _tasks(c)).distinct())  # dealt first, so that no task gathers the ids of all that it scans; made once for all tables
    of_asset = assets.select("id", F.col("id").alias("asset_id"), "item_id")
    of_item = items.select("id", F.col("id").alias("item_id"), F.lit(None).cast("long").alias("asset_id"))
    results = assets.select("id", F.col("id").alias("target_id"), F.when(F.col("id") % 3 == 0, "asset").when(F.col("id") % 3 == 1, "unknown").otherwise("other").alias("target_type"))
    results = results.union(items.select("id", "id", F.lit("item")))
    children = {name: of_asset for name in ("extractions", "layouts", "transcriptions", "annotations", "vec_assets")}
    return {"collections": c.table("customer").select(F.col("c_custkey").alias("id")), "items": items, "assets": assets, "llm_results": results, "entities": of_item, "triples": of_item, "notes": of_item, "item_topics": of_item.withColumn("topic_id", F.col("id") % 10)} | children


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


_A = "(SELECT DISTINCT l_orderkey * 1000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id, l_orderkey AS item_id FROM lineitem)"
_LOST = "(SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 0)"


def _rows(counts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, ({sql}) AS rows" for name, sql in sorted(counts.items()))


_ITEMS_LEFT = f"SELECT count(*) FROM orders WHERE o_orderkey NOT IN {_LOST}"
_ASSETS_LEFT = f"SELECT count(*) FROM {_A} WHERE item_id NOT IN {_LOST}"
_ASSETS_ALL = f"SELECT count(*) FROM {_A}"


@query(_rows({
    "collections": "SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0", "items": _ITEMS_LEFT, "assets": _ASSETS_LEFT, "extractions": _ASSETS_LEFT, "layouts": _ASSETS_LEFT, "vec_assets": _ASSETS_LEFT,
    "transcriptions": _ASSETS_ALL, "annotations": _ASSETS_ALL, "entities": _ITEMS_LEFT, "triples": _ITEMS_LEFT, "notes": _ITEMS_LEFT, "item_topics": "SELECT count(*) FROM orders",
    "llm_results": f"SELECT ({_ITEMS_LEFT}) + count(*) FROM {_A} WHERE id % 3 = 2 OR item_id NOT IN {_LOST}",
}))
def d5_cascade_delete_collections(c: Corpus) -> DataFrame:
    """Rows left in every table after collections are deleted with all that hangs on them."""
    return _counted(R.without_collections(_model(c), c.table("customer").filter("c_custkey % 4 = 0").select("c_custkey"), _tasks(c)))


_ODD = f"SELECT count(*) FROM {_A} WHERE item_id % 5 <> 0"


@query(_rows({
    "collections": "SELECT count(*) FROM customer", "items": "SELECT count(*) FROM orders", "assets": _ODD, "extractions": _ODD, "layouts": _ODD, "vec_assets": _ODD, "transcriptions": _ODD, "annotations": _ODD,
    "entities": "SELECT count(*) FROM orders", "triples": "SELECT count(*) FROM orders", "notes": "SELECT count(*) FROM orders", "item_topics": "SELECT count(*) FROM orders",
    "llm_results": f"SELECT (SELECT count(*) FROM orders) + count(*) FROM {_A} WHERE id % 3 = 2 OR item_id % 5 <> 0",
}))
def d7_cascade_delete_assets(c: Corpus) -> DataFrame:
    tables = _model(c)
    return _counted(R.without_assets(tables, tables["assets"].filter("item_id % 5 = 0").select("id"), _tasks(c)))


@query(_rows({
    "items": "SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0", "entities": "SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0", "triples": "SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0",
    "item_topics": "SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0", "notes": "SELECT count(*) FROM orders", "assets": _ASSETS_ALL, "layouts": _ASSETS_ALL,
}))
def d12_foreign_key_cascade(c: Corpus) -> DataFrame:
    """Items go with what cascades from them; notes and assets, which restrict, stay."""
    tables = {k: v for k, v in _model(c).items() if k in ("items", "entities", "triples", "item_topics", "notes", "assets", "layouts")}
    return _counted(R.cascaded(tables, "items", tables["items"].filter("id % 5 = 0").select("id")))


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'b' || n_nationkey ELSE 'old' END AS value FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'theme', 'dark'")
def d13_settings(c: Corpus) -> DataFrame:
    """Settings after upserts (twice for some keys, the last counts) and deletes."""
    n = c.table("nation")
    old = n.select(F.col("n_name").alias("key"), F.lit("old").alias("value"))
    even = n.filter("n_nationkey % 2 = 0")
    first = even.select(F.col("n_name").alias("key"), F.lit("a").alias("value"), F.lit(1).alias("seq"))
    second = even.select("n_name", F.concat(F.lit("b"), F.col("n_nationkey").cast("string")), F.lit(2))
    new = c.spark.createDataFrame([("theme", "dark", 1)], "key string, value string, seq int")
    return R.settings_after(old, first.union(second).union(new), n.filter("n_nationkey % 5 = 0").select("n_name"))


@query("SELECT md5(text) AS hash, false AS uploaded FROM documents")
def d14_reverified_blobs(c: Corpus) -> DataFrame:
    blobs = c.documents.select(F.md5("text").alias("hash"), (F.col("doc_id") % 2 == 0).alias("uploaded"))
    return R.session_ended({}, c.spark.createDataFrame([], "key string, value string"), blobs)["sync_blob_index"]


@query("SELECT source AS collection_id, count(*) AS items, count(DISTINCT doc_id) AS documents FROM documents GROUP BY 1")
def s11_export_collections(c: Corpus) -> DataFrame:
    """Collections written as JSON lines, a folder for each, and read again."""
    path = fresh_path(c.spark, "export")
    exports.write_collections(c.items, c.assets, path)
    rows = exports.read_collections(c.spark, path)
    return rows.groupBy("collection_id").agg(F.count("*").alias("items"), F.count_distinct("id").alias("documents"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s12_export_table(c: Corpus) -> DataFrame:
    """A table written as CSV with a head line, and read again with its types."""
    path = fresh_path(c.spark, "table")
    exports.write_table(c.table("nation"), path)
    return c.spark.read.schema(c.table("nation").schema).option("header", True).csv(path)


_WORDS = r"SELECT id, unnest(terms) AS term FROM (SELECT doc_id AS id, regexp_extract_all(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[\p{L}\p{N}]+') AS terms FROM documents)"


def _index(c: Corpus) -> str:
    path = fresh_path(c.spark, "index")
    index.write(c.documents.select(F.col("doc_id").alias("id"), "text"), path)
    return path


@query(f"SELECT i.id, i.title, count(*) AS tf FROM ({_WORDS}) w JOIN items i ON i.id = w.id WHERE term = 'thing' AND i.collection_id = 'src1' GROUP BY 1, 2", "items")
def j6_index_lookup(c: Corpus) -> DataFrame:
    """The postings of a term, read from their part of a stored index and joined to the items of a collection."""
    hits = index.postings(c.spark, c.text_index, ["thing"]).select("id", "tf")
    return hits.join(c.items.filter("collection_id = 'src1'"), "id").select("id", "title", "tf")


@query(f"SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms, count(*) AS words FROM ({_WORDS})")
def g22_index_stats(c: Corpus) -> DataFrame:
    return index.stats(c.spark, c.text_index)


@query(f"WITH w AS ({_WORDS}) SELECT id, term, count(*) AS tf FROM w WHERE id <> 1 AND term IN ('thing', 'fresh') GROUP BY 1, 2 UNION ALL SELECT 1, 'fresh', 2 UNION ALL SELECT 1, 'thing', 1 UNION ALL SELECT -5, 'thing', 1")
def a2_index_item(c: Corpus) -> DataFrame:
    """One text indexed anew and one added: their old postings are no longer found."""
    path = _index(c)
    index.add(c.spark.createDataFrame([(1, "Fresh thing, FRESH!"), (-5, "thing")], "id long, text string"), path)
    return index.postings(c.spark, path, ["thing", "fresh"]).select("id", "term", "tf")


@query("SELECT o_orderkey, o_custkey, 'there' AS state FROM orders UNION ALL SELECT -o_orderkey, o_custkey + 50, CASE WHEN o_custkey + 50 IN (SELECT c_custkey FROM customer) THEN 'there' ELSE 'refused' END FROM orders WHERE o_orderkey > 0")
def d1_inserted_with_parents(c: Corpus) -> DataFrame:
    """Orders inserted where their customer exists; the others are refused."""
    old = c.table("orders").select("o_orderkey", "o_custkey")
    new = old.filter("o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), (F.col("o_custkey") + 50).alias("o_custkey"))
    rows, refused = inserted(old, new, c.table("customer"), "o_custkey", "c_custkey")
    return rows.withColumn("state", F.lit("there")).unionByName(refused.withColumn("state", F.lit("refused")))

"""Change capture over the event table as an operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.plans.catalog import query
from lektra.sources.corpus import Corpus
from lektra.operators.settling import fresh_path
from lektra.streaming import capture as S
from lektra.streaming import replication as R


@query("SELECT c_custkey AS row_id, CASE c_custkey % 10 WHEN 0 THEN 'D' WHEN 1 THEN 'U' ELSE 'I' END AS op FROM customer WHERE c_custkey % 10 IN (0, 1, 2)")
def c1_capture(c: Corpus) -> DataFrame:
    rows = c.table("customer").select("c_custkey", "c_name")
    after = rows.filter("c_custkey % 10 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 1, "new").otherwise(F.col("c_name")))
    return S.captured(rows.filter("c_custkey % 10 <> 2"), after, "c_custkey")


@query("SELECT DISTINCT table_name, row_id FROM oplog WHERE row_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)", "oplog")
def c2_reseed(c: Corpus) -> DataFrame:
    versions = c.table("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("row_id"))
    return c.oplog.select("table_name", "row_id").distinct().join(versions, "row_id", "left_anti").select("table_name", "row_id")


_LAST = "SELECT table_name, row_id, arg_max(op, seq) AS op, max(changed_at) AS changed_at FROM oplog GROUP BY 1, 2"


@query(_LAST, "oplog")
def c3_coalesce_ops(c: Corpus) -> DataFrame:
    return S.coalesced(c.oplog)


@query(f"SELECT table_name, row_id, op = 'D' OR c_custkey IS NULL AS deleted, changed_at + 250 AS changed_at, CASE WHEN op <> 'D' THEN c_name END AS name FROM ({_LAST}) LEFT JOIN customer ON c_custkey = row_id AND c_custkey % 3 <> 0", "oplog")
def c4_build_changes(c: Corpus) -> DataFrame:
    rows = c.table("customer").filter("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    return S.changes(S.coalesced(c.oplog), rows, "c_custkey", 250).select("table_name", "row_id", "deleted", "changed_at", F.get_json_object("payload", "$.c_name").alias("name"))


def _page(c: Corpus) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("items", "collections", "assets", "notes"))), (F.col("event_id") % 4 + 1).cast("int"))
    return c.table("events").select(names.alias("table_name"), F.col("user_id").alias("row_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 == 0).alias("deleted"), F.when(F.col("event_id") % 11 != 0, F.col("props")).otherwise("{bad").alias("payload"), F.when(F.col("event_id") % 4 == 2, F.col("user_id") + 1).alias("parent_id"))


_PAGE = "SELECT ['items', 'collections', 'assets', 'notes'][event_id % 4 + 1] AS table_name, user_id AS row_id, event_id AS seq, event_id % 7 = 0 AS deleted, event_id % 11 = 0 AS bad, CASE WHEN event_id % 4 = 2 THEN user_id + 1 END AS parent_id FROM events"


@query(f"SELECT seq, CASE table_name WHEN 'collections' THEN 0 WHEN 'items' THEN 3 WHEN 'assets' THEN 4 ELSE 5 END * CASE WHEN deleted THEN -1 ELSE 1 END + CASE WHEN deleted THEN 1000 ELSE 0 END AS place FROM ({_PAGE})")
def c8_order_page(c: Corpus) -> DataFrame:
    return _page(c).select("seq", S.page_rank().alias("place")).orderBy("place", "seq")


@query(f"SELECT seq, CASE WHEN seq <= 100 AND seq <> 0 AND row_id % 2 = 0 THEN 'skipped' WHEN deleted THEN CASE WHEN row_id % 5 = 0 THEN 'skipped' ELSE 'applied' END WHEN bad THEN 'journaled' WHEN row_id % 5 = 0 THEN 'skipped' WHEN parent_id % 3 = 0 THEN 'parked' ELSE 'applied' END AS outcome FROM ({_PAGE})")
def c9_apply_outcomes(c: Corpus) -> DataFrame:
    page = _page(c)
    known = page.filter("row_id % 2 = 0").select("table_name", "row_id").distinct().withColumn("seq", F.lit(100))
    dirty = page.filter("row_id % 5 = 0").select("table_name", "row_id")
    keys = page.select(F.col("parent_id").alias("id")).filter("id % 3 <> 0").distinct()
    return S.outcomes(page, known, dirty, keys).select("seq", "outcome")


@query("SELECT DISTINCT event_type AS table_name, 'k' AS column FROM events")
def c10_schema_drift(c: Corpus) -> DataFrame:
    return S.drift(c.oplog.select("table_name", F.col("props").alias("payload")), ["id", "name"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS name FROM supplier")
def c11_missing_column_preserved(c: Corpus) -> DataFrame:
    payload = F.when(F.col("s_suppkey") % 2 == 0, F.lit('{"name":"new"}')).otherwise('{"other":1}')
    given = F.array_contains(F.json_object_keys(payload), "name")
    return c.table("supplier").select("s_suppkey", F.when(given, F.get_json_object(payload, "$.name")).otherwise(F.col("s_name")).alias("name"))


@query("SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 4 = 0 THEN 'parked' ELSE 'applied' END AS state FROM orders")
def c13_park_and_drain(c: Corpus) -> DataFrame:
    parked = c.table("orders").select(F.col("o_orderkey").alias("row_id"), (-F.col("o_custkey") - 1).alias("parent_id"))
    owners = c.table("customer").filter("c_custkey % 4 <> 0").select((-F.col("c_custkey") - 1).alias("row_id"), F.lit(-10**9).cast("long").alias("parent_id"))
    keys = c.spark.range(1).select(F.lit(-10**9).cast("long").alias("id"))
    done, left = S.drained(parked.unionByName(owners), keys)
    return done.filter("row_id >= 0").select("row_id", F.lit("applied").alias("state")).unionByName(left.select("row_id", F.lit("parked").alias("state")))


@query("SELECT DISTINCT user_id AS item_id FROM events WHERE event_id % 4 IN (0, 2, 3)")
def c15_index_queue(c: Corpus) -> DataFrame:
    page = _page(c)
    return page.filter(F.col("table_name").isin("items", "assets", "notes")).select(F.col("row_id").alias("item_id")).distinct()


@query("SELECT doc_id, vec_id IS NULL AS missing FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR label <> doc_id % 5")
def c16_blob_queue(c: Corpus) -> DataFrame:
    rows = c.documents.select("doc_id").join(c.vectors, F.col("doc_id") == F.col("asset_id"), "left")
    return rows.filter(F.col("asset_id").isNull() | (F.col("label") != F.col("doc_id") % 5)).select("doc_id", F.col("asset_id").isNull().alias("missing"))


@query("SELECT count(DISTINCT (table_name, row_id)) AS pending, count_if(op = 'D') AS conflicts, CAST(coalesce(sum(CASE WHEN op = 'I' THEN seq END), 0) AS BIGINT) AS bytes, max(changed_at) - min(changed_at) > 300000 AS clock_warning FROM oplog", "oplog")
def c18_sync_status(c: Corpus) -> DataFrame:
    return c.oplog.agg(F.count_distinct("table_name", "row_id").alias("pending"), F.count_if(F.col("op") == "D").alias("conflicts"), F.coalesce(F.sum(F.when(F.col("op") == "I", F.col("seq"))), F.lit(0)).alias("bytes"), (F.max("changed_at") - F.min("changed_at") > 300_000).alias("clock_warning"))



#: Bytes of a replicated row in memory, about.
ROW_BYTES = 100


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 13 = 0 THEN 'journaled' WHEN o_custkey % 10 = 3 THEN 'parked' WHEN o_custkey % 10 = 7 THEN 'gone' ELSE 'present' END AS state FROM orders")
def c13_replicated_stream(c: Corpus) -> DataFrame:
    """Orders as items of customers as collections, page by page: children first, then most of the parents, then deletes, and the children again.

    Of ten customers one never comes, so its orders stay parked, and one is deleted with its orders. Every thirteenth order has a broken payload.
    """
    folder = fresh_path(c.spark, "replication")
    no_parents, nothing = F.array().cast(R.PARENTS), F.lit(None).cast("string")
    row = lambda table, key, seq, deleted, parents, payload: (F.lit(table).alias("table_name"), F.col(key).cast("long").alias("row_id"), F.lit(seq).cast("long").alias("seq"), F.lit(deleted).alias("deleted"), parents.cast(R.PARENTS).alias("parents"), nothing.alias("name"), payload.alias("payload"))
    customers, last = c.table("customer"), F.col("c_custkey") % 10
    parent = F.array(F.struct(F.lit("collections").alias("table_name"), F.col("o_custkey").cast("long").alias("row_id")))
    items = c.table("orders").select(*row("items", "o_orderkey", 1, False, parent, F.when(F.col("o_orderkey") % 13 == 0, "{bad").otherwise("{}")))
    nothing_dirty = customers.limit(0).select(F.lit("").alias("table_name"), F.col("c_custkey").alias("row_id"))
    expected = (customers.count() + items.count()) * ROW_BYTES
    # one run of the stream for each page, so that a page is one micro-batch, however many files it has
    for page in (items, customers.filter(last != 3).select(*row("collections", "c_custkey", 2, False, no_parents, F.lit("{}"))), customers.filter(last == 7).select(*row("collections", "c_custkey", 3, True, no_parents, nothing)), items):
        page.write.mode("append").parquet(f"{folder}/pages")
        pages = c.spark.readStream.schema(R.CHANGE).parquet(f"{folder}/pages")
        state = R.replicate(pages, f"{folder}/state", f"{folder}/checkpoint", nothing_dirty, expected_bytes=expected)
    mine = F.col("table_name") == "items"
    rows = state.read("rows").filter(mine).select("row_id", F.when(F.col("present"), "present").otherwise("gone").alias("state"))
    return rows.unionByName(state.read("parked").filter(mine).select("row_id", F.lit("parked").alias("state"))).unionByName(state.journal().filter(mine).select("row_id", F.lit("journaled").alias("state")).distinct())

"""Replicated rows: results of a push, deferred and parked changes, conflicts, cascades, and the end of a session.

Tables are DataFrames by name; each function returns new ones, nothing is written in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.operators.relational import dealt, deleted
from lektra.operators.settling import settled

#: Fixed values: (parent, child, key of the child) of the edges along which a delete goes on.
CASCADES = (
    ("items", "entities", "item_id"), ("items", "triples", "item_id"), ("items", "item_topics", "item_id"),
    ("assets", "extractions", "asset_id"), ("assets", "transcriptions", "asset_id"), ("assets", "layouts", "asset_id"), ("assets", "annotations", "asset_id"),
    ("topics", "item_topics", "topic_id"), ("rag_conversations", "rag_messages", "conversation_id"),
)
#: What goes with an asset, and with the items and assets of a collection: (child, key); results of a model also go by their target.
OF_ASSET = (("extractions", "asset_id"), ("layouts", "asset_id"), ("transcriptions", "asset_id"), ("annotations", "asset_id"), ("entities", "asset_id"), ("triples", "asset_id"), ("vec_assets", "asset_id"))
OF_COLLECTION = {"assets": (("extractions", "asset_id"), ("layouts", "asset_id")), "items": (("entities", "item_id"), ("triples", "item_id"), ("notes", "item_id"), ("vec_assets", "item_id"))}
#: Tables that the end of a session empties, and keys that it removes.
SESSION_TABLES = ("sync_oplog", "sync_row_versions", "sync_conflicts", "sync_pending_rows", "sync_pending_blobs", "sync_pending_fts", "sync_topic_aliases")
SESSION_KEYS = ("last_pull_seq", "device_id", "account_id", "account_email", "seeded_account", "server_epoch", "capture_enabled", "clock_offset_ms")

ROW = ["table_name", "row_id"]


def _without(rows: DataFrame, key: str, ids: DataFrame, tasks: int = 1) -> DataFrame:
    return deleted(rows, ids, key, tasks)


def _without_results(results: DataFrame, target: str, ids: DataFrame, tasks: int = 1) -> DataFrame:
    """Results of a model whose target, of this or of unknown type, is gone."""
    typed = results.withColumn("__of", F.when(F.col("target_type").isin(target, "unknown"), F.col("target_id")))
    return deleted(typed, ids, "__of", tasks).drop("__of")


def without_assets(tables: dict[str, DataFrame], ids: DataFrame, tasks: int = 1) -> dict[str, DataFrame]:
    """All tables without the assets ``ids`` (one column) and without what hangs on them; joins go by so many tasks."""
    made = dict(tables)
    for child, key in OF_ASSET:
        if child in made:
            made[child] = _without(made[child], key, ids, tasks)
    if "llm_results" in made:
        made["llm_results"] = _without_results(made["llm_results"], "asset", ids, tasks)
    made["assets"] = _without(made["assets"], "id", ids, tasks)
    return made


def without_collections(tables: dict[str, DataFrame], ids: DataFrame, tasks: int = 1) -> dict[str, DataFrame]:
    """All tables without collections, their items, the assets of these, and what hangs on any of them; joins go by so many tasks."""
    of = lambda rows, key, parents: dealt(rows, key, tasks).join(dealt(parents.select(F.col(parents.columns[0]).alias("__k")), "__k", tasks), F.col(key) == F.col("__k"), "left_semi").select("id")
    items = of(tables["items"], "collection_id", ids)
    gone = {"items": items, "assets": of(tables["assets"], "item_id", items)}
    made = dict(tables)
    for parent, children in OF_COLLECTION.items():
        for child, key in children:
            if child in made:
                made[child] = _without(made[child], key, gone[parent], tasks)
    if "llm_results" in made:
        for target, dead in (("asset", gone["assets"]), ("item", items), ("collection", ids)):
            made["llm_results"] = _without_results(made["llm_results"], target, dead, tasks)
    return made | {"assets": _without(tables["assets"], "id", gone["assets"], tasks), "items": _without(tables["items"], "id", items, tasks), "collections": _without(tables["collections"], "id", ids)}


def cascaded(tables: dict[str, DataFrame], root: str, ids: DataFrame, edges=CASCADES) -> dict[str, DataFrame]:
    """All tables without rows of ``root`` and all that the edges reach from them, however deep."""
    made, front = dict(tables), [(root, ids.select(F.col(ids.columns[0]).alias("id")))]
    made[root] = deleted(made[root], front[0][1], "id")
    while front:
        parent, dead = front.pop()
        for above, child, key in edges:
            if above == parent and child in made:
                lost = tables[child].join(dead.select(F.col("id").alias("__k")), F.col(key) == F.col("__k"), "left_semi").select("id")
                made[child] = deleted(made[child], lost, "id")
                front.append((child, lost))
    return made


def deferred(tombstones: DataFrame, tables: dict[str, DataFrame], dirty: DataFrame, edges=CASCADES) -> DataFrame:
    """(table_name, row_id): the tombstones that would destroy a row with a pending change, along any path of edges."""
    found = None
    front = [(name, tombstones.filter(F.col("table_name") == name).select(F.col("row_id").alias("root"), F.col("row_id").alias("at")), name) for name in sorted({e[0] for e in edges})]
    while front:
        parent, reached, root = front.pop()
        for above, child, key in edges:
            if above != parent or child not in tables:
                continue
            below = reached.join(tables[child].select(F.col("id").alias("__id"), F.col(key).alias("at")), "at").select("root", F.col("__id").alias("at"))
            pending = dirty.filter(F.col("table_name") == child).select(F.col("row_id").alias("at"))
            hit = below.join(pending, "at", "left_semi").select(F.lit(root).alias("table_name"), F.col("root").alias("row_id"))
            found = hit if found is None else found.unionByName(hit)
            if any(e[0] == child for e in edges):
                front.append((child, below, root))
    return found.distinct()


def pushed(results: DataFrame, oplog: DataFrame, versions: DataFrame, snapshot: int) -> dict[str, DataFrame]:
    """What the results of a push (table_name, row_id, status, server_seq, winner_seq, winner_device) do.

    oplog: without what the push covered. conflicts: one for each lost change. winners: rows to be written, of lost changes
    without a later one of their own. versions: the server's, but for lost rows with a later change; a winner brings its own.
    """
    left = oplog.join(results.select(*ROW, F.lit(True).alias("__pushed")), ROW, "left").filter(F.col("__pushed").isNull() | (F.col("seq") > snapshot)).drop("__pushed")
    later = left.filter(F.col("seq") > snapshot).select(*ROW).distinct().withColumn("__later", F.lit(True))
    rows = results.join(later, ROW, "left").withColumn("__lost", F.col("status") == "lww_lost")
    skipped = F.col("__lost") & F.coalesce("__later", F.lit(False))
    summary = F.when(F.col("winner_seq").isNotNull(), F.concat(F.lit("server_seq="), F.col("winner_seq").cast("string"), F.lit(" device="), "winner_device")).otherwise(F.concat(F.lit("server_seq="), F.col("server_seq").cast("string")))
    conflict = F.concat_ws("-", F.lit("lww"), "table_name", F.col("row_id").cast("string"), F.col("server_seq").cast("string"))
    conflicts = rows.filter("__lost").select(conflict.alias("id"), *ROW, F.lit("lww_lost").alias("reason"), summary.alias("winner_summary"), F.lit(False).alias("acknowledged")).dropDuplicates(["id"])
    winners = rows.filter(F.col("__lost") & ~skipped & F.col("winner_seq").isNotNull()).select(*ROW, F.col("winner_seq").alias("server_seq"), "winner_device")
    fresh = rows.filter(~skipped).select(*ROW, F.when(F.col("__lost"), F.coalesce("winner_seq", "server_seq")).otherwise(F.col("server_seq")).alias("server_seq"))
    kept = versions.join(fresh.select(*ROW), ROW, "left_anti").select(*ROW, "server_seq")
    return {"oplog": left, "conflicts": conflicts, "winners": winners, "versions": kept.unionByName(fresh)}


def drained(parked: DataFrame, keys: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(row_id, parent_id, outcome): applied once its parent is there, at any depth; parent_deleted below a deleted row; else parked.

    Rounds go on until one changes nothing; each is settled, so that the plan doesn't grow.
    """
    known = settled(keys.select("id").distinct())
    dead = settled((tombstones if tombstones is not None else keys.limit(0)).select("id").distinct())
    left, done = settled(parked.select("row_id", "parent_id")), []
    while True:
        by_parent = lambda ids: ids.select(F.col(ids.columns[0]).alias("parent_id")).distinct()
        lost = left.join(by_parent(dead), "parent_id", "left_semi").select("row_id", "parent_id", F.lit("parent_deleted").alias("outcome"))
        ready = left.join(by_parent(dead), "parent_id", "left_anti").join(by_parent(known), "parent_id", "left_semi").select("row_id", "parent_id", F.lit("applied").alias("outcome"))
        found = settled(lost.unionByName(ready))
        if found.isEmpty():
            break
        done.append(found)
        known, dead = (found.filter(F.col("outcome") == o).select(F.col("row_id").alias("id")) for o in ("applied", "parent_deleted"))
        left = settled(left.join(found.select("row_id"), "row_id", "left_anti"))
    out = left.select("row_id", "parent_id", F.lit("parked").alias("outcome"))
    for part in done:
        out = out.unionByName(part)
    return out


def conflict_page(conflicts: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest conflicts first; the limit is held in 1 to 500."""
    return conflicts.orderBy(F.desc("created_at"), F.desc("id")).offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def acknowledged(conflicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Conflicts with those of ``ids`` acknowledged; the others stay as they are."""
    told = ids.select(F.col(ids.columns[0]).alias("__k")).distinct()
    return conflicts.join(told, F.col("id") == F.col("__k"), "left").withColumn("acknowledged", F.col("acknowledged") | F.col("__k").isNotNull()).drop("__k")


def session_ended(tables: dict[str, DataFrame], meta: DataFrame, blobs: DataFrame) -> dict[str, DataFrame]:
    """The tables of a session emptied, its keys removed, and all blobs (hash, uploaded) to be confirmed again; hashes stay."""
    made = {name: df.limit(0) if name in SESSION_TABLES else df for name, df in tables.items()}
    return made | {"sync_meta": meta.filter(~F.col("key").isin(*SESSION_KEYS)), "sync_blob_index": blobs.withColumn("uploaded", F.lit(False))}


def settings_after(settings: DataFrame, written: DataFrame, removed: DataFrame) -> DataFrame:
    """Settings (key, value) after upserts, of which the last (key, value, seq) of a key counts, and then deletes (key)."""
    last = written.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return deleted(settings.join(last.select("key"), "key", "left_anti").unionByName(last), removed, "key")

"""Change capture: coalescing, ordering, last-writer-wins, parking; in batch and as a stream.

A change is (table_name, row_id, seq, deleted, changed_at, payload); the state of replicated rows is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lektra.operators import replicas

#: Tables in the order in which upserts are applied; deletes go the other way.
TABLE_ORDER = ("collections", "topics", "rag_conversations", "items", "assets", "notes", "entities", "triples", "item_topics", "llm_results", "rag_messages", "annotations", "extractions", "transcriptions", "layouts", "vec_assets")


def captured(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(row_id, op): what turned one snapshot into the other."""
    a = before.select(F.col(key).alias("row_id"), F.xxhash64(*before.columns).alias("old"))
    b = after.select(F.col(key).alias("row_id"), F.xxhash64(*before.columns).alias("new"))
    op = F.when(F.col("old").isNull(), "I").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "U")
    return a.join(b, "row_id", "full").select("row_id", op.alias("op")).filter("op is not null")


def coalesced(oplog: DataFrame, snapshot: int | None = None) -> DataFrame:
    """One entry for each row: its last operation and its latest time."""
    rows = oplog if snapshot is None else oplog.filter(F.col("seq") <= snapshot)
    return rows.groupBy("table_name", "row_id").agg(F.max_by("op", "seq").alias("op"), F.max("changed_at").alias("changed_at"))


def changes(coalesced_ops: DataFrame, rows: DataFrame, key: str, offset_ms: int = 0) -> DataFrame:
    """What is pushed: a payload for rows that exist, a tombstone for those that don't."""
    payload = rows.select(F.col(key).alias("row_id"), F.to_json(F.struct(*rows.columns)).alias("payload"))
    joined = coalesced_ops.join(payload, "row_id", "left")
    deleted = (F.col("op") == "D") | F.col("payload").isNull()
    return joined.select("table_name", "row_id", deleted.alias("deleted"), (F.col("changed_at") + offset_ms).alias("changed_at"), F.when(~deleted, F.col("payload")).alias("payload"))


def page_rank(table: str = "table_name", deleted: str = "deleted"):
    """The place of a change's table within a page: upserts from parent to child, then deletes from child to parent."""
    place = F.coalesce(*(F.when(F.col(table) == name, i) for i, name in enumerate(TABLE_ORDER)), F.lit(len(TABLE_ORDER)))
    return F.when(F.col(deleted), 1000 - place).otherwise(place)


def winners(known: DataFrame, page: DataFrame) -> DataFrame:
    """The replicated rows after a page: for each row the greatest version, and none older than what is known."""
    both = known.withColumn("page", F.lit(0)).unionByName(page.withColumn("page", F.lit(1)))
    newest = Window.partitionBy("table_name", "row_id").orderBy(F.desc("seq"), "page")
    return both.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n", "page")


def outcomes(page: DataFrame, versions: DataFrame, dirty: DataFrame, keys: DataFrame) -> DataFrame:
    """Each change with what becomes of it: skipped, journaled, parked or applied, tested in that order."""
    rows = page.join(versions.select("table_name", "row_id", F.col("seq").alias("known")), ["table_name", "row_id"], "left")
    rows = rows.join(dirty.select("table_name", "row_id", F.lit(True).alias("dirty")).distinct(), ["table_name", "row_id"], "left")
    rows = rows.join(keys.select(F.col("id").alias("parent_id"), F.lit(True).alias("there")).distinct(), "parent_id", "left")
    outcome = (
        F.when((F.col("known") >= F.col("seq")) & (F.col("seq") != 0), "skipped")
        .when(F.col("deleted"), F.when(F.col("dirty"), "skipped").otherwise("applied"))
        .when(F.col("payload").isNull() | F.try_parse_json("payload").isNull(), "journaled")
        .when(F.col("dirty"), "skipped")
        .when(F.col("parent_id").isNotNull() & F.col("there").isNull(), "parked")
        .otherwise("applied")
    )
    return rows.withColumn("outcome", outcome).drop("known", "dirty", "there")


def drift(page: DataFrame, columns: list[str]) -> DataFrame:
    """(table_name, column): payload keys that the table doesn't have, each told once."""
    return page.select("table_name", F.explode(F.json_object_keys("payload")).alias("column")).filter(~F.col("column").isin(*columns)).distinct()


def drained(parked: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, still parked): parked rows (row_id, parent_id) whose parents exist or get there, at any depth."""
    found = replicas.drained(parked, keys)
    return found.filter("outcome = 'applied'").drop("outcome"), found.filter("outcome = 'parked'").drop("outcome")


#: Parts of the replicated rows; a page rewrites the parts that it touches.
BUCKETS = 64


def _manifest(spark: SparkSession, target: str, batch: int) -> dict[int, int]:
    """For each part, the batch that wrote it last, as of a batch; none before the first."""
    if batch < 0:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{target}/manifest/version={batch}").collect()}  # BUCKETS rows at most


def replica(spark: SparkSession, target: str, schema: StructType, batch: int, buckets: list[int] | None = None) -> DataFrame:
    """The replicated rows after a batch, or those of some parts."""
    paths = [f"{target}/rows/version={v}/bucket={b}" for b, v in sorted(_manifest(spark, target, batch).items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Apply all pages (JSON files) that are there as a stream; rows lie in parts by a hash of table and row.

    Each batch writes the parts that its page touches, and a manifest that says which batch wrote each part last. A
    batch that is repeated after a failure writes the same again, from the manifest of the batch before it. Versions that no
    late manifest names may be removed by ``unused``.
    """

    def merge(page: DataFrame, batch: int) -> None:
        newest = Window.partitionBy("table_name", "row_id").orderBy(F.desc("seq"))
        bucket = F.pmod(F.xxhash64("table_name", "row_id"), F.lit(BUCKETS)).cast("int")
        once = page.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")
        touched = [r[0] for r in page.select(bucket).distinct().collect()]  # BUCKETS rows at most
        made = winners(replica(spark, target, page.schema, batch - 1, touched), once).withColumn("bucket", bucket)
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/version={batch}")
        after = _manifest(spark, target, batch - 1) | dict.fromkeys(touched, batch)
        spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/version={batch}")

    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def unused(spark: SparkSession, target: str, batch: int) -> list[str]:
    """Paths of parts that only manifests before a batch name; a cleaning job may delete them."""
    now = _manifest(spark, target, batch)
    rows = spark.read.parquet(*(f"{target}/manifest/version={b}" for b in range(batch))).distinct().collect() if batch > 0 else []
    return sorted(f"{target}/rows/version={r.version}/bucket={r.bucket}" for r in rows if now.get(r.bucket) != r.version)

"""Replication as a stream whose state lives in versioned tables: versions, parked rows and links outlast their micro-batch.

A change is (table_name, row_id, seq, deleted, parents array<struct<table_name, row_id>>, name, payload). A page is a
micro-batch. Of each row the newest change counts. In a page upserts come first: known versions and rows with a pending change of
one's own are skipped, broken payloads journaled, a topic whose name another one has becomes its alias, and rows whose parents
aren't there are parked, until a page brings them, at any depth. Then deletes go down along the links, unless they would
destroy a row with a pending change; such a tombstone is left for later. A last pass journals parked rows that have no parent to wait for.

Three tables by hash of a key, in parts: ``rows`` and ``parked`` by the row, ``links`` by the parent. A batch reads the parts in which its
keys lie, writes those that it changes as a version of its own, and then a manifest that says which version of each part counts; a
batch that is repeated after a failure starts from the manifest before it and writes the same again. The number of parts
follows from the bytes that are expected: ``parts_for``. ``retired`` names what a manifest has replaced, for a cleaning job.

Defined results: changes with null table or id are journaled; equal changes count once; a null list of parents is an empty one; of
changes of one row and version the delete counts; no files give no batch and an empty replica.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektra.operators.settling import settled

KEY = ["table_name", "row_id"]
PARENTS = "array<struct<table_name:string,row_id:long>>"
CHANGE = f"table_name string, row_id long, seq long, deleted boolean, parents {PARENTS}, name string, payload string"
KINDS = {
    "rows": f"table_name string, row_id long, seq long, epoch string, present boolean, parents {PARENTS}, name string, payload string",
    "parked": CHANGE,
    "links": "table_name string, row_id long, child_table string, child_id long",
}
#: Bytes of a part, which a batch rewrites if it touches one of its keys.
PART_BYTES = 64 << 20


def parts_for(expected_bytes: int) -> int:
    """Parts for a state of so many bytes: a power of two, 8 at least."""
    return max(8, 1 << max(-(-expected_bytes // PART_BYTES) - 1, 0).bit_length())


def bucket_of(parts: int):
    return F.pmod(F.xxhash64("table_name", "row_id"), F.lit(parts)).cast("int")


class Replica:
    """The state at ``target`` as of a batch."""

    def __init__(self, spark: SparkSession, target: str, batch: int, parts: int | None = None):
        self.spark, self.target, self.batch = spark, target, batch
        self.versions: dict[str, dict[int, int]] = {kind: {} for kind in KINDS}
        self.parts, self.epoch = parts or 8, ""
        if batch >= 0:
            for r in spark.read.parquet(f"{target}/manifest/batch={batch}").collect():  # a row for each part and table
                self.parts, self.epoch = r.parts, r.epoch
                if r.kind:
                    self.versions[r.kind][r.bucket] = r.version

    def read(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.target}/{kind}/batch={v}/bucket={b}" for b, v in sorted(self.versions[kind].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(KINDS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], KINDS[kind])

    def buckets(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(bucket_of(self.parts)).distinct().collect()]  # as many as parts

    def lookup(self, kind: str, keys: DataFrame) -> DataFrame:
        """The rows of a table with one of the keys (table_name, row_id), from the parts in which they lie."""
        return self.read(kind, self.buckets(keys)).join(keys.select(*KEY).distinct(), KEY, "left_semi")

    def present(self) -> DataFrame:
        """The replicated rows."""
        return self.read("rows").filter("present").drop("present", "epoch")

    def aliases(self) -> DataFrame:
        """(row_id, local_id) of topics that are another one by name."""
        schema = "row_id long, local_id long"
        return _or_empty(self.spark, f"{self.target}/aliases", schema).filter(F.col("batch") <= self.batch).select("row_id", "local_id").distinct()

    def journal(self) -> DataFrame:
        """(table_name, row_id, seq, reason) of what could not be applied."""
        schema = "table_name string, row_id long, seq long, reason string"
        return _or_empty(self.spark, f"{self.target}/journal", schema).filter(F.col("batch") <= self.batch).drop("batch")


def _or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


def _opened(rows: DataFrame) -> DataFrame:
    """(child_table, child_id, table_name, row_id): a row for each parent."""
    return rows.select(F.col("table_name").alias("child_table"), F.col("row_id").alias("child_id"), F.inline("parents"))


def _newest(rows: DataFrame) -> DataFrame:
    first = Window.partitionBy(*KEY).orderBy(F.desc("seq"), F.desc("deleted"), F.desc_nulls_last("payload"))
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(*KEY), KEY, "left_anti")


def apply_page(state: Replica, page: DataFrame, dirty: DataFrame, epoch: str) -> dict[str, DataFrame]:
    """What a page does to a state: changed ``rows``, ``parked``, ``unparked`` (keys), ``links``, ``aliases``, ``journal``.

    ``dirty`` (table_name, row_id): rows with a pending change of one's own. In another epoch no version is known.
    """
    spark = state.spark
    page = settled(_newest(page.withColumn("parents", F.coalesce("parents", F.array().cast(PARENTS))).withColumn("deleted", F.coalesce("deleted", F.lit(False)))))
    own = settled(dirty.select(*KEY).distinct())

    def admitted(changes: DataFrame, new: bool = True) -> DataFrame:
        """With ``outcome``: skipped, journaled, delete or upsert. A new change also has to be newer than what is parked."""
        known = state.lookup("rows", changes).filter(F.col("epoch") == epoch).select(*KEY, "seq")
        if new:
            known = known.unionByName(state.lookup("parked", changes).select(*KEY, "seq"))
        known = known.groupBy(*KEY).agg(F.max("seq").alias("known"))
        rows = changes.join(known, KEY, "left").join(own.withColumn("mine", F.lit(True)), KEY, "left")
        outcome = (
            F.when(F.col("table_name").isNull() | F.col("row_id").isNull(), "journaled")
            .when((F.col("known") >= F.col("seq")) & (F.col("seq") != 0), "skipped")
            .when(F.col("deleted"), F.when(F.col("mine"), "skipped").otherwise("delete"))
            .when(F.col("payload").isNull() | F.try_parse_json("payload").isNull(), "journaled")
            .when(F.col("mine"), "skipped")
            .otherwise("upsert")
        )
        return settled(rows.withColumn("outcome", outcome).drop("known", "mine"))

    judged = admitted(page)
    journal = judged.filter("outcome = 'journaled'").select(*KEY, "seq", F.lit("apply_error").alias("reason"))
    upserts = judged.filter("outcome = 'upsert'").drop("outcome")

    topics = settled(upserts.filter("table_name = 'topics'"))
    new_aliases = spark.createDataFrame([], "row_id long, local_id long")
    settled_topics = topics.limit(0)
    if not topics.isEmpty():
        there = state.read("rows").filter("table_name = 'topics' and present")  # the filter reaches the scan
        holders = there.select("row_id", "name", F.lit(0).alias("new")).unionByName(topics.select("row_id", "name", F.lit(1).alias("new"))).filter("name is not null")
        firsts = holders.groupBy("name").agg(F.min(F.struct("new", "row_id"))["row_id"].alias("local_id"))  # one that is there, else the least id
        new_aliases = settled(topics.join(firsts, "name").filter("row_id <> local_id").select("row_id", "local_id"))
        settled_topics = topics.join(new_aliases, "row_id", "left_semi").select(*topics.columns)
    known_as = settled(state.aliases().unionByName(new_aliases).groupBy("row_id").agg(F.min("local_id").alias("local_id")))
    waiting = settled(_renamed(_without(upserts, settled_topics), known_as))

    applied, retried = settled(waiting.limit(0)), settled(waiting.select(*KEY).limit(0))
    while True:
        wanted = settled(_opened(waiting))
        keys = wanted.select(*KEY).distinct()
        there = state.lookup("rows", keys).filter("present").select(*KEY).unionByName(applied.select(*KEY)).distinct()
        missing = wanted.join(there, KEY, "left_anti").select(F.col("child_table").alias("table_name"), F.col("child_id").alias("row_id")).distinct()
        ready = settled(_without(waiting, missing))
        if ready.isEmpty():
            break
        applied, waiting = settled(applied.unionByName(ready)), settled(_without(waiting, ready))
        children = state.lookup("links", ready).select(F.col("child_table").alias("table_name"), F.col("child_id").alias("row_id")).distinct()
        woken = settled(_without(_without(state.lookup("parked", children), retried), page))  # a row of the page replaces a parked one
        if not woken.isEmpty():
            retried = settled(retried.unionByName(woken.select(*KEY)))
            fresh = admitted(woken, new=False).filter("outcome = 'upsert'").drop("outcome")
            waiting = settled(waiting.unionByName(_renamed(fresh, known_as)))

    deletes = settled(judged.filter("outcome = 'delete'"))
    below = _descendants(state, deletes, applied)
    blocked = below.join(own, KEY, "left_semi").select(F.col("root_table").alias("table_name"), F.col("root_id").alias("row_id")).distinct()
    done = settled(_without(deletes, blocked))
    roots = done.select(F.col("table_name").alias("root_table"), F.col("row_id").alias("root_id"))
    lost = settled(_without(below.join(roots, ["root_table", "root_id"], "left_semi").select(*KEY).distinct(), done))
    as_row = lambda df, present: df.select(*KEY, "seq", F.lit(epoch).alias("epoch"), F.lit(present).alias("present"), "parents", "name", "payload")
    stored_lost = state.lookup("rows", lost).withColumn("present", F.lit(False))
    lost_here = as_row(applied.join(lost, KEY, "left_semi"), False)
    aliased = as_row(settled_topics, False)
    kept = state.lookup("rows", aliased).filter("present").drop("seq", "epoch").join(aliased.select(*KEY, "seq", "epoch"), KEY)  # a topic that is there stays as it was
    made = as_row(_without(_without(applied, lost), done), True).unionByName(as_row(done, False)).unionByName(_without(aliased, kept)).unionByName(_without(kept, lost).select(*aliased.columns))
    rows = settled(made.unionByName(lost_here).unionByName(_without(stored_lost, applied)))
    still = settled(waiting)
    links = _opened(applied.unionByName(still)).select(*KEY, "child_table", "child_id").distinct()
    superseded = state.lookup("parked", judged.filter("outcome <> 'skipped'")).select(*KEY)
    return {"rows": rows, "parked": still, "unparked": settled(superseded.unionByName(retried).distinct()), "links": settled(links), "aliases": new_aliases, "journal": settled(journal)}


def _renamed(changes: DataFrame, known_as: DataFrame) -> DataFrame:
    """Parents that are topics under their local name; links of rows to topics are few each."""
    if known_as.isEmpty():
        return changes
    opened = changes.select(*KEY, F.posexplode("parents").alias("__i", "__p")).select(*KEY, "__i", F.col("__p.table_name").alias("__t"), F.col("__p.row_id").alias("__r"))
    local = opened.join(known_as.select(F.col("row_id").alias("__r"), F.lit("topics").alias("__t"), "local_id"), ["__t", "__r"], "left")
    parents = local.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.struct(F.col("__t").alias("table_name"), F.coalesce("local_id", "__r").alias("row_id")).alias("p")))), lambda x: x["p"]).alias("__parents"))
    return changes.join(parents, KEY, "left").withColumn("parents", F.coalesce("__parents", "parents")).drop("__parents").select(*changes.columns)


def _descendants(state: Replica, roots: DataFrame, applied: DataFrame) -> DataFrame:
    """(root_table, root_id, table_name, row_id): what hangs on the roots, level by level, as far as it is there."""
    here = settled(_opened(applied).select(*KEY, "child_table", "child_id"))
    front = settled(roots.select(F.col("table_name").alias("root_table"), F.col("row_id").alias("root_id"), *KEY))
    found = None
    while not front.isEmpty():
        links = state.lookup("links", front).unionByName(here).distinct()
        reached = settled(front.join(links, KEY).select("root_table", "root_id", *KEY, "child_table", "child_id"))
        children = reached.select(F.col("child_table").alias("table_name"), F.col("child_id").alias("row_id")).distinct()
        stored = _without(state.lookup("rows", children).filter("present").select(*KEY, "parents"), applied)
        now = _opened(stored).unionByName(_opened(applied)).distinct()  # a row may have got other parents since a link was written
        front = settled(reached.join(now, [*KEY, "child_table", "child_id"], "left_semi").select("root_table", "root_id", F.col("child_table").alias("table_name"), F.col("child_id").alias("row_id")).distinct())
        if found is not None:
            front = settled(front.join(found, ["root_table", "root_id", *KEY], "left_anti"))  # a ring ends
        found = front if found is None else settled(found.unionByName(front))
    return found if found is not None else settled(roots.select(F.col("table_name").alias("root_table"), F.col("row_id").alias("root_id"), *KEY).limit(0))


def _replace(state: Replica, batch: int, kind: str, changed: DataFrame, gone: DataFrame | None = None) -> dict[int, int]:
    """Write the parts that changed; their new versions."""
    keys = changed.select(*KEY) if gone is None else changed.select(*KEY).unionByName(gone.select(*KEY))
    touched = state.buckets(keys)
    if not touched:
        return {}
    old = state.read(kind, touched)
    kept = old.unionByName(changed.select(*old.columns)).distinct() if kind == "links" else _without(old, keys.distinct()).unionByName(changed.select(*old.columns))
    placed = settled(kept.withColumn("bucket", bucket_of(state.parts)))
    placed.repartition("bucket").sortWithinPartitions("bucket", *KEY).write.mode("overwrite").partitionBy("bucket").parquet(f"{state.target}/{kind}/batch={batch}")
    left = {r[0] for r in placed.select("bucket").distinct().collect()}
    return {b: batch if b in left else -1 for b in touched}


def commit(state: Replica, batch: int, made: dict[str, DataFrame], epoch: str) -> Replica:
    """Write what a page did, and the manifest last."""
    spark, target = state.spark, state.target
    new = {"rows": _replace(state, batch, "rows", made["rows"]), "parked": _replace(state, batch, "parked", made["parked"], made["unparked"]), "links": _replace(state, batch, "links", made["links"])}
    for name in ("aliases", "journal"):
        if not made[name].isEmpty():
            made[name].write.mode("overwrite").parquet(f"{target}/{name}/batch={batch}")
    rows = []
    for kind, versions in state.versions.items():
        for bucket, version in (versions | new[kind]).items():
            if version >= 0:
                rows.append((kind, bucket, version, versions.get(bucket, -1) if new[kind].get(bucket) is not None else -1, state.parts, epoch))
            else:  # an emptied part
                rows.append(("", bucket, -1, versions.get(bucket, -1), state.parts, epoch))
    rows = rows or [("", -1, -1, -1, state.parts, epoch)]
    spark.createDataFrame(rows, "kind string, bucket int, version long, replaced long, parts int, epoch string").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/batch={batch}")
    return Replica(spark, target, batch)


def finish(state: Replica) -> DataFrame:
    """(table_name, row_id, seq, reason): parked rows with a parent that is neither there nor parked itself; it has been deleted."""
    parked = state.read("parked")
    there = state.read("rows").filter("present").select(*KEY).unionByName(parked.select(*KEY)).distinct()
    lost = _opened(parked).join(there, KEY, "left_anti").select(F.col("child_table").alias("table_name"), F.col("child_id").alias("row_id")).distinct()
    return parked.join(lost, KEY, "left_semi").select(*KEY, "seq", F.lit("parent_deleted").alias("reason"))


def retired(spark: SparkSession, target: str, since: int, upto: int) -> list[str]:
    """Parts that the batches after ``since`` up to ``upto`` replaced; only their manifests are read."""
    paths = [f"{target}/manifest/batch={b}" for b in range(since + 1, upto + 1)]
    rows = spark.read.parquet(*paths).filter("replaced >= 0 and kind <> ''").select("kind", "bucket", "replaced").collect()  # parts that these batches wrote
    return sorted(f"{target}/{r.kind}/batch={r.replaced}/bucket={r.bucket}" for r in rows)


def newest_batch(spark: SparkSession, target: str) -> int:
    try:
        return spark.read.parquet(f"{target}/manifest").agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def replicate(pages: DataFrame, target: str, checkpoint: str, dirty: DataFrame, *, expected_bytes: int = 0, epoch: str = "", schema_tag: str = "", own_tag: str = "") -> Replica:
    """Apply a stream of pages, all that are there, and return the state after them.

    Another ``epoch`` than the state's forgets the known versions, so that all comes anew; rows stay. A ``schema_tag`` beyond one's
    own (``own_tag``) stops before a page is applied: one has to be upgraded first.
    """
    spark = pages.sparkSession
    if schema_tag > own_tag:
        raise ValueError(f"the pages have schema {schema_tag}, newer than {own_tag}")
    parts = parts_for(expected_bytes)

    def merge(page: DataFrame, batch: int) -> None:
        state = Replica(spark, target, batch - 1, parts)
        commit(state, batch, apply_page(state, page.select("table_name", "row_id", "seq", "deleted", "parents", "name", "payload"), dirty, epoch), epoch)

    pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return Replica(spark, target, newest_batch(spark, target), parts)


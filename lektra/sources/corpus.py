"""The corpus model as DataFrames over the tables of a directory: collections, items, assets, texts, dialogues, vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.functions.text import one_line
from lektra.operators.settling import fresh_path
from lektra.sources import index

#: Paths of stored indexes, by application and folder.
_INDEXES: dict[tuple[str, str], str] = {}


class Corpus:
    """Lazy tables; every property is a plan, nothing is read before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def listed(self, allowed: tuple[str, ...]) -> DataFrame:
        """(name): which of the allowed tables the folder has; settings and tables for synchronisation are never shown."""

        def there(name: str) -> bool:
            try:
                return bool(self.table(name).columns)
            except AnalysisException:  # no such path
                return False

        shown = [(n,) for n in allowed if n != "settings" and not n.startswith("sync_") and there(n)]
        return self.spark.createDataFrame(shown, "name string")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def text_index(self) -> str:
        """The path of the stored index of all documents, which is written once for a session and a folder."""
        key = self.spark.sparkContext.applicationId, self.folder
        if key not in _INDEXES:
            path = fresh_path(self.spark, "text-index")
            index.write(self.documents.select(F.col("doc_id").alias("id"), "text"), path)
            _INDEXES[key] = path
        return _INDEXES[key]

    @property
    def collections(self) -> DataFrame:
        return self.documents.groupBy(F.col("source").alias("id")).agg(F.first("source").alias("name"), F.min("doc_id").alias("created_at"), F.max("doc_id").alias("updated_at"))

    @property
    def items(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("collection_id"), one_line("text", 60).alias("title"), F.to_json(F.struct("lang")).alias("metadata"), (F.col("doc_id") % 97).alias("created_at"))

    @property
    def assets(self) -> DataFrame:
        kind = F.when(F.col("doc_id") % 3 == 0, "image").when(F.col("doc_id") % 3 == 1, "pdf").otherwise("audio")
        ending = F.when(F.col("doc_id") % 3 == 0, "png").when(F.col("doc_id") % 3 == 1, "PDF").otherwise("mp3")
        return self.documents.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("item_id"), kind.alias("type"), F.concat(F.lit("assets/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"), (F.col("doc_id") % 5).alias("sort_index"), F.col("n_chars").alias("size"), (F.col("doc_id") % 97).alias("created_at"))

    @property
    def extractions(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("asset_id"), F.col("text").alias("text_content"))

    @property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("sort_index"), "role", F.col("text").alias("content"))

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("asset_id"), "embedding", "label")

    @property
    def oplog(self) -> DataFrame:
        op = F.when(F.col("event_id") % 7 == 0, "D").when(F.col("event_id") % 3 == 0, "I").otherwise("U")
        return self.table("events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("table_name"), F.col("user_id").alias("row_id"), op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("changed_at"), "props")

"""Where queries register themselves with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lektra.sources.corpus import Corpus

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The corpus model in DuckDB, for oracles; the same mapping as in ``Corpus``.
VIEWS = {
    "items": r"""SELECT doc_id AS id, source AS collection_id, CASE WHEN length(l) > 60 THEN substring(l, 1, 60) || '…' ELSE l END AS title, '{"lang":"' || lang || '"}' AS metadata, doc_id % 97 AS created_at FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS l FROM documents)""",
    "assets": """SELECT doc_id AS id, doc_id // 4 AS item_id, CASE doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' ELSE 'audio' END AS type, 'assets/' || source || '/' || doc_id || '.' || CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'PDF' ELSE 'mp3' END AS path, doc_id % 5 AS sort_index, n_chars AS size, doc_id % 97 AS created_at FROM documents""",
    "messages": "SELECT conv_id AS conversation_id, turn AS sort_index, role, text AS content FROM conversations",
    "vectors": "SELECT vec_id AS asset_id, embedding, label FROM embeddings",
    "oplog": "SELECT event_id AS seq, event_type AS table_name, user_id AS row_id, CASE WHEN event_id % 7 = 0 THEN 'D' WHEN event_id % 3 = 0 THEN 'I' ELSE 'U' END AS op, epoch_us(ts) // 1000 AS changed_at, props FROM events",
}


def sql(text: str, *views: str) -> str:
    return ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + " " if views else "") + text


def query(oracle: str | None = None, *views: str):
    """Register a function of a Corpus under its name, with its oracle over the named views."""

    def keep(function: Callable[[Corpus], DataFrame]) -> Callable:
        if function.__name__ in QUERIES:
            raise ValueError(f"there is a query {function.__name__} already")
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Corpus(spark, sf_dir))
        if oracle is not None:
            ORACLES[function.__name__] = oracle if oracle.lstrip().upper().startswith("WITH") and not views else sql(oracle, *views)
        return function

    return keep

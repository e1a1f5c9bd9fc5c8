"""Which SQL may run: one SELECT or WITH that touches no settings; and the catalog."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.sources.corpus import Corpus

#: Tables that no statement may read, and the beginnings of names of tables that none may write.
SENSITIVE, PROTECTED = ("app_settings",), ("sync_", "trg_sync_")
#: What the parser calls statements that write rows, and the text in which it names a relation.
_WRITES = ("InsertIntoStatement", "UpdateTable", "DeleteFromTable", "MergeIntoTable")
_RELATION = re.compile(r"'?UnresolvedRelation \[([^\]]*)\]|'?UnresolvedTable(?:OrView)? \[([^\]]*)\]")


def parsed(spark: SparkSession, sql: str) -> tuple[str, set[str], set[str]]:
    """(the kind of the statement, the kinds of all its parts, the tables that it names at any depth) as Spark's parser sees them; ValueError if it is none.

    Comments and literals are the parser's matter, so a column may have the name of a command.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ValueError(f"no statement: {e.getCondition()}") from e
    shown = plan.treeString()
    parts = set(re.findall(r"^[ :+|-]*'?([A-Za-z]+)", shown, re.M))
    tables = {next(filter(None, found)).split(",")[-1].strip().strip("`").lower() for found in _RELATION.findall(shown)}
    return plan.getClass().getSimpleName(), parts, tables


def _statements(sql: str) -> list[str]:
    """The statements of a batch: cut at semicolons outside of literals, quoted names and comments."""
    parts = re.findall(r"""(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*(?:.|\n)*?\*/|[^;])+""", sql)
    return [p for p in map(str.strip, parts) if re.sub(r"--[^\n]*|/\*(?:.|\n)*?\*/", "", p).strip()]


def readable(spark: SparkSession, sql: str) -> str:
    """The statement without a last semicolon; ValueError if it isn't a single query or names a table of settings."""
    statements = _statements(sql)
    if len(statements) != 1:
        raise ValueError("only one SELECT or WITH statement may run")
    kind, parts, tables = parsed(spark, statements[0])
    if not re.match(r"(?:\s|--[^\n]*\n|/\*(?:.|\n)*?\*/|\()*(?:select|with)\b", statements[0], re.I) or parts & set(_WRITES):
        raise ValueError("only one SELECT or WITH statement may run")
    if tables & set(SENSITIVE):
        raise ValueError("a restricted table")
    return statements[0]


def writable(spark: SparkSession, sql: str) -> list[str]:
    """The statements of a batch, each INSERT, UPDATE, DELETE or MERGE on tables that aren't kept for synchronisation or settings; ValueError otherwise."""
    statements = _statements(sql)
    for statement in statements:
        kind, _, tables = parsed(spark, statement)
        if kind not in _WRITES or tables & set(SENSITIVE) or any(t.startswith(PROTECTED) for t in tables):
            raise ValueError("only insert, update and delete on corpus tables")
    return statements


def select(corpus: Corpus, sql: str, args: list | None = None) -> DataFrame:
    """Run a checked SELECT over the tables that it names, with positional parameters."""
    sql = readable(corpus.spark, sql)
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        if re.search(rf"\b{name}\b", sql, re.I):
            corpus.table(name).createOrReplaceTempView(name)
    return corpus.spark.sql(sql, args=args or [])


def described(df: DataFrame, name: str, key: str) -> DataFrame:
    """A row for each column of a table."""
    rows = [(name, f.name, f.dataType.simpleString(), f.name == key, i) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, kind string, is_key boolean, position int").select("table_name", "column_name", "kind", "is_key", F.col("position"))

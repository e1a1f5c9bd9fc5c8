"""All queries of the library, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lektra.plans import capture, catalog, geometry, knowledge, more, pages, records, relational, replicas, search, texts
from lektra.sources.corpus import Corpus

FAMILIES = (relational, texts, search, knowledge, capture, geometry, more, pages, records, replicas)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.a12_hybrid_retrieve(Corpus(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)

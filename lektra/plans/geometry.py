"""Layout operators over boxes that are derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.operators import geometry as G
from lektra.plans.catalog import query
from lektra.sources.corpus import Corpus


def _boxes(c: Corpus) -> DataFrame:
    """Blocks and regions on a page for each order."""
    rows = c.table("lineitem")
    near = G.box(F.col("l_linenumber") * 10, F.col("l_quantity"), F.col("l_quantity"), F.lit(20))
    shifted = G.box(F.col("l_linenumber") * 10 + 3, F.col("l_quantity") + 2, F.col("l_quantity"), F.lit(18))
    return rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), near.alias("a"), shifted.alias("b"))


_BOXES = "SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS part, l_linenumber * 10.0::DOUBLE AS x, l_quantity AS y, l_quantity AS w, 20.0::DOUBLE AS h, l_linenumber * 10.0::DOUBLE + 3 AS rx, l_quantity + 2 AS ry, l_quantity AS rw, 18.0::DOUBLE AS rh FROM lineitem"
_CROSSED = f"SELECT *, greatest(least(x + w, rx + rw) - greatest(x, rx), 0) * greatest(least(y + h, ry + rh) - greatest(y, ry), 0) AS i FROM ({_BOXES})"


@query(f"SELECT page, n, round(i / greatest(least(w * h, rw * rh), 1e-4), 6) AS overlap, round(i / greatest(w * h + rw * rh - i, 1e-4), 6) AS iou FROM ({_CROSSED})")
def l1_overlap_and_iou(c: Corpus) -> DataFrame:
    return _boxes(c).select("page", "n", F.round(G.overlap(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(G.iou(F.col("a"), F.col("b")), 6).alias("iou"))


def _score(i: str, x: str, y: str, w: str, h: str, rx: str, ry: str, rw: str, rh: str) -> str:
    return f"0.6 * {i} / greatest(least({w} * {h}, {rw} * {rh}), 1e-4) + 0.3 * {i} / greatest({w} * {h} + {rw} * {rh} - {i}, 1e-4) + 0.1 * greatest(1 - sqrt(({x} + {w} / 2 - {rx} - {rw} / 2) ** 2 + ({y} + {h} / 2 - {ry} - {rh} / 2) ** 2) / greatest(sqrt({w} ** 2 + {h} ** 2), sqrt({rw} ** 2 + {rh} ** 2), 1.0), 0)"


@query(f"SELECT page, n, round({_score('i', 'x', 'y', 'w', 'h', 'rx', 'ry', 'rw', 'rh')}, 6) AS score FROM ({_CROSSED})")
def l2_geometry_score(c: Corpus) -> DataFrame:
    return _boxes(c).select("page", "n", F.round(G.score(F.col("a"), F.col("b")), 6).alias("score"))


@query(
    f"WITH b0 AS ({_BOXES}), p AS (SELECT a.page, a.n AS block, b.n AS region, a.part % 3 = b.part % 3 AS same, a.part = b.part AS grouped, a.x, a.y, a.w, a.h, b.rx, b.ry, b.rw, b.rh, greatest(least(a.x + a.w, b.rx + b.rw) - greatest(a.x, b.rx), 0) * greatest(least(a.y + a.h, b.ry + b.rh) - greatest(a.y, b.ry), 0) AS i FROM b0 a JOIN b0 b ON a.page = b.page), "
    f"s AS (SELECT *, {_score('i', 'x', 'y', 'w', 'h', 'rx', 'ry', 'rw', 'rh')} AS score FROM p), t AS (SELECT *, CASE WHEN grouped AND score >= 0.15 THEN 1 WHEN same AND score >= 0.25 THEN 2 WHEN score >= 0.4 THEN 3 END AS tier FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY tier NULLS LAST, score DESC, region) AS k FROM t) SELECT page, block, CASE WHEN tier IS NOT NULL THEN region END AS region, tier FROM u WHERE k = 1"
)
def l3_match_region(c: Corpus) -> DataFrame:
    rows = _boxes(c).withColumn("category", F.col("part") % 3)
    blocks = rows.select("page", F.col("n").alias("block"), F.col("part").alias("group_id"), "category", F.col("a").alias("box"))
    return G.matched(blocks, rows.select("page", F.col("n").alias("region"), F.col("part").alias("group_id"), "category", F.col("b").alias("box")))


@query("SELECT doc_id, CASE WHEN n >= 40 AND s < 0.9 THEN 'native' WHEN n < 40 AND s >= 0.9 THEN 'image' WHEN n >= 40 THEN 'image_with_text' ELSE 'uncertain' END AS kind FROM (SELECT doc_id, n_chars % 100 AS n, (doc_id % 20) / 20.0 AS s FROM documents)")
def l9_page_classify(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", G.page_kind(F.col("n_chars") % 100, (F.col("doc_id") % 20) / 20.0).alias("kind"))


@query("SELECT document, pages, CASE WHEN a >= ceil(0.8 * pages) THEN 'native' WHEN b >= ceil(0.8 * pages) THEN 'image' WHEN c >= ceil(0.8 * pages) THEN 'image_with_text' END AS dominant, greatest(a, b, c) < ceil(0.8 * pages) AS mixed FROM (SELECT o_custkey AS document, count(*) AS pages, count_if(o_orderstatus = 'O') AS a, count_if(o_orderstatus = 'F') AS b, count_if(o_orderstatus = 'P') AS c FROM orders GROUP BY 1)")
def g19_document_profile(c: Corpus) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "native").when(F.col("o_orderstatus") == "F", "image").otherwise("image_with_text")
    return G.document_profile(c.table("orders").select(F.col("o_custkey").alias("document"), kind.alias("kind")))


@query("SELECT l_orderkey AS page, count(*) AS blocks FROM lineitem GROUP BY 1")
def g18_block_count_by_page(c: Corpus) -> DataFrame:
    return c.table("lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").alias("blocks"))


@query(f"SELECT page, n, printf('%.2f, %.2f, %.2f, %.2f', x, y, w, h) AS label FROM ({_BOXES})")
def l14_format_bbox(c: Corpus) -> DataFrame:
    return _boxes(c).select("page", "n", F.format_string("%.2f, %.2f, %.2f, %.2f", "a.x", "a.y", "a.width", "a.height").alias("label"))

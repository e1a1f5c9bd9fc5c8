"""Boxes on pages: overlap, scores and matches, as column functions over structs (x, y, width, height)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-4


def box(x, y, width, height) -> Column:
    """A box with sizes of zero or more; null parts count as zero."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.struct(zero(x).alias("x"), zero(y).alias("y"), F.greatest(zero(width), F.lit(0.0)).alias("width"), F.greatest(zero(height), F.lit(0.0)).alias("height"))


def area(a: Column) -> Column:
    return a["width"] * a["height"]


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller box that both cover."""
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(EPSILON))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(EPSILON))


def score(a: Column, b: Column) -> Column:
    """0.6 overlap, 0.3 intersection over union, 0.1 nearness of centres."""
    long = lambda x, y: F.sqrt(x * x + y * y)
    far = long(a["x"] + a["width"] / 2 - b["x"] - b["width"] / 2, a["y"] + a["height"] / 2 - b["y"] - b["height"] / 2)
    across = F.greatest(long(a["width"], a["height"]), long(b["width"], b["height"]), F.lit(1.0))
    return 0.6 * overlap(a, b) + 0.3 * iou(a, b) + 0.1 * F.greatest(1 - far / across, F.lit(0.0))


#: Regions of a page from which on a grid finds what meets; on smaller pages each block looks at all.
MANY_REGIONS = 256


def _in_cells(rows: DataFrame, box_col: str, level: str, levels: list[int]) -> DataFrame:
    """A row for each cell that a box touches, in the grid of its own size and in all coarser ones that occur: four at most in each."""
    grids = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(level))
    at = rows.withColumn("grid", F.explode(grids)).withColumn("__size", F.pow(F.lit(2.0), F.col("grid")))
    low = lambda side: F.floor(F.col(f"{box_col}.{side}") / F.col("__size"))
    high = lambda side, extent: F.floor((F.col(f"{box_col}.{side}") + F.col(f"{box_col}.{extent}")) / F.col("__size"))
    return at.withColumn("cell_x", F.explode(F.sequence(low("x"), high("x", "width")))).withColumn("cell_y", F.explode(F.sequence(low("y"), high("y", "height")))).drop("__size")


def _level(box_col: str) -> Column:
    """The power of two that a box fits into; boxes below a thousandth count as that."""
    return F.ceil(F.log2(F.greatest(F.col(f"{box_col}.width"), F.col(f"{box_col}.height"), F.lit(2.0**-10)))).cast("int")


def meeting(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs of a block (page, box, ...) and a region (r_page, r_box, ...) of its page whose boxes share an area; all other columns stay.

    Boxes lie in grids as wide as themselves, and meet in the coarser grid of the two. A pair counts in the cell that holds the corner
    of what both cover, so that it is found once.
    """
    a, b = blocks.withColumn("__a", _level("box")), regions.withColumn("__b", _level("r_box"))
    levels = sorted({r[0] for r in a.select("__a").union(b.select("__b")).distinct().collect()})  # some tens at most
    if not levels:
        levels = [0]
    left = _in_cells(a, "box", "__a", levels)
    right = _in_cells(b, "r_box", "__b", levels).withColumnsRenamed({"grid": "r_grid", "cell_x": "r_cell_x", "cell_y": "r_cell_y"})
    corner = lambda side: F.floor(F.greatest(F.col(f"box.{side}"), F.col(f"r_box.{side}")) / F.pow(F.lit(2.0), F.col("grid")))
    same = (F.col("page") == F.col("r_page")) & (F.col("grid") == F.col("r_grid")) & (F.col("cell_x") == F.col("r_cell_x")) & (F.col("cell_y") == F.col("r_cell_y"))
    once = (F.greatest("__a", "__b") == F.col("grid")) & (corner("x") == F.col("cell_x")) & (corner("y") == F.col("cell_y"))
    pairs = left.join(right, same & once & _touch()).drop("grid", "cell_x", "cell_y", "r_grid", "r_cell_x", "r_cell_y", "__a", "__b")
    return pairs


def _touch() -> Column:
    a, b = F.col("box"), F.col("r_box")
    wide = (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"])
    return wide & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def matched(blocks: DataFrame, regions: DataFrame, *, many: int = MANY_REGIONS) -> DataFrame:
    """The best region of each block (page, block, group_id, category, box) on its page, or none.

    Regions of its group count from a score of 0.15, else those of its category from 0.25, else any from 0.4. Nearness alone gives 0.1
    at most, so only boxes that share an area are scored. Pages with more than ``many`` regions go through a grid, so that no page is
    compared all with all; the others are joined by page. Boxes of one page and block are one block, with the best region of any of them.
    """
    other = regions.select(F.col("page").alias("r_page"), "region", F.col("group_id").alias("r_group"), F.col("category").alias("r_category"), F.col("box").alias("r_box"))
    large = other.groupBy("r_page").agg(F.count("*").alias("n")).filter(F.col("n") > many).select(F.col("r_page").alias("large"))
    if large.isEmpty():
        pairs = blocks.join(other, (F.col("page") == F.col("r_page")) & _touch())
    else:
        of = lambda df, key, how: df.join(large, F.col(key) == F.col("large"), how)
        few = of(blocks, "page", "left_anti").join(of(other, "r_page", "left_anti"), (F.col("page") == F.col("r_page")) & _touch())
        pairs = few.unionByName(meeting(of(blocks, "page", "left_semi"), of(other, "r_page", "left_semi")).select(few.columns))
    scored = pairs.withColumn("score", score(F.col("box"), F.col("r_box")))
    tier = F.when((F.col("group_id") == F.col("r_group")) & (F.col("score") >= 0.15), 1).when((F.col("category") == F.col("r_category")) & (F.col("score") >= 0.25), 2).when(F.col("score") >= 0.4, 3)
    # a filter on the tier would be pushed into the join, where each use of the score computes it again; rows without an order don't count instead
    order = F.when(F.col("tier").isNotNull(), F.struct("tier", -F.col("score"), "region"))
    best = scored.withColumn("tier", tier).groupBy("page", "block").agg(F.min_by(F.struct("region", "tier"), order).alias("best"))
    found = best.select(F.col("page").alias("__page"), F.col("block").alias("__block"), "best.region", "best.tier")
    return blocks.select("page", "block").distinct().join(found, (F.col("page") == F.col("__page")) & (F.col("block") == F.col("__block")), "left").select("page", "block", "region", "tier")


def page_kind(letters: Column, image_share: Column) -> Column:
    return F.when((letters >= 40) & (image_share < 0.9), "native").when((letters < 40) & (image_share >= 0.9), "image").when((letters >= 40) & (image_share >= 0.9), "image_with_text").otherwise("uncertain")


def document_profile(pages: DataFrame) -> DataFrame:
    """(document, pages, dominant, mixed): from rows (document, kind); a kind dominates with four fifths of the pages."""
    kinds = ("native", "image", "image_with_text", "uncertain")
    counts = pages.groupBy("document").agg(F.count("*").alias("pages"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    dominant = F.coalesce(*(F.when(F.col(k) >= F.ceil(0.8 * F.col("pages")), k) for k in kinds))
    return counts.select("document", "pages", dominant.alias("dominant"), dominant.isNull().alias("mixed"))


def bypassed(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, bypass): whether the layout of a page (page, width, height) is passed over: it has fewer than two regions (page, width, height), or one covers more than three fifths of it."""
    found = regions.groupBy(F.col("page").alias("of")).agg(F.count("*").alias("n"), F.max(F.greatest("width", F.lit(0)).cast("double") * F.greatest("height", F.lit(0))).alias("largest"))
    area = F.col("width").cast("double") * F.col("height")
    few = F.coalesce("n", F.lit(0)) < 2
    return pages.join(found, F.col("page") == F.col("of"), "left").select("page", (few | ((area > 0) & (F.coalesce("largest", F.lit(0.0)) > 0.6 * area))).alias("bypass"))

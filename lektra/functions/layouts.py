"""Column functions on layouts: labels and filters of blocks, boxes in pixels and in the unit square, texts of regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lektra.functions.text import _column, fragment_key, without_tags

#: The labels of each category of regions.
CATEGORIES = {
    "title": ("title", "doc_title", "paragraph_title"),
    "plain_text": ("plain_text", "text", "paragraph", "reference", "abstract", "code", "page_header", "page_footer"),
    "table": ("table", "table_caption", "table_note"),
    "figure": ("figure", "image", "chart", "figure_title", "figure_note"),
    "abandoned": ("abandoned", "vision_footnote"),
    "formula": ("formula",),
    "seal": ("seal",),
}
#: The labels that each filter of blocks lets through.
FILTERS = {
    "titles": ("title", "doc_title", "paragraph_title"),
    "text": ("plain_text", "text", "paragraph", "reference", "abstract", "code", "page_header", "page_footer"),
    "tables": ("table", "table_caption"),
    "figures": ("figure", "image", "chart", "figure_title"),
    "notes": ("note", "notes", "vision_footnote", "abandoned", "table_note", "figure_note"),
}
#: How the text of a region of each kind is written; kinds without an entry are left out.
REGION_TEXTS = {
    "title": ("## ", ""), "plain_text": ("", ""), "table": ("---\n", "\n---"), "caption": ("", ""),
    "footnote": ("Note: ", ""), "code": ("```\n", "\n```"), "reference": ("", ""),
}


def label_token(label: str | Column) -> Column:
    """Lower case with underscores; a missing label is unknown."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(_column(label))), r"[\s-]+", "_"), F.lit("unknown"))


def _alias(label: str | Column, names: dict[str, tuple[str, ...]]) -> Column:
    token = label_token(label)
    return F.coalesce(*(F.when(token.isin(*labels), name) for name, labels in names.items()))


def category(label: str | Column) -> Column:
    """The category of a label, or the label itself."""
    return F.coalesce(_alias(label, CATEGORIES), label_token(label))


def block_filter(label: str | Column) -> Column:
    """The filter that shows a block; null if only all blocks do."""
    return _alias(label, FILTERS)


def region_text(kind: str | Column, text: str | Column) -> Column:
    """The text of a region as its kind writes it; null for blank texts and for kinds that are left out."""
    core = F.trim(_column(text))
    said = F.coalesce(*(F.when(_column(kind) == k, F.concat(F.lit(before), core, F.lit(after))) for k, (before, after) in REGION_TEXTS.items()))
    return F.when(core != "", said)


def pixels_of(values: list[Column], width: Column, height: Column) -> Column:
    """A box of whole pixels from four numbers: corners or corner and size, in pixels or as shares of the page.

    Numbers in 0 to 1 are shares. The last two are the far corner if both exceed the first two, else sizes. Null without a page size.
    """
    x1, y1, c, d = (v.cast("double") for v in values)
    shares = (F.least(x1, y1, c, d) >= 0) & (F.greatest(x1, y1, c, d) <= 1)
    corner = (c > x1) & (d > y1)
    across, down = F.when(shares, width).otherwise(1), F.when(shares, height).otherwise(1)

    def far(first: Column, last: Column) -> Column:
        return F.when(corner, last).when(shares, F.least(first + last, F.lit(1.0))).otherwise(first + last)

    left, top = F.round(x1 * across).cast("int"), F.round(y1 * down).cast("int")
    wide, high = F.round(far(x1, c) * across).cast("int") - left, F.round(far(y1, d) * down).cast("int") - top
    found = F.struct(left.alias("x"), top.alias("y"), F.greatest(wide, F.lit(0)).alias("width"), F.greatest(high, F.lit(0)).alias("height"))
    return F.when((width > 0) & (height > 0), found)


def rescaled(box: Column, across: Column, down: Column) -> Column:
    """A box of whole pixels on a page of another size."""
    scaled = lambda name, by: F.round(box[name] * by).cast("int").alias(name)
    return F.struct(scaled("x", across), scaled("y", down), scaled("width", across), scaled("height", down))


def in_pixels(box: Column, width: Column, height: Column) -> Column:
    """A box of the unit square in pixels of a page; halves go up."""
    up = lambda v: F.floor(v + 0.5).cast("int")
    return F.struct(up(box["x"] * width).alias("x"), up(box["y"] * height).alias("y"), up(box["width"] * width).alias("width"), up(box["height"] * height).alias("height"))


def turned(box: Column, right: bool) -> Column:
    """A box of the unit square after a quarter turn of the page."""
    x = 1 - box["y"] - box["height"] if right else box["y"]
    y = box["x"] if right else 1 - box["x"] - box["width"]
    return F.struct(x.alias("x"), y.alias("y"), box["height"].alias("width"), box["width"].alias("height"))


def cropped(box: Column, to: Column) -> Column:
    """A box within a part of the page, in shares of that part; null if it lies outside."""
    left, top = F.greatest(box["x"], to["x"]), F.greatest(box["y"], to["y"])
    right, low = F.least(box["x"] + box["width"], to["x"] + to["width"]), F.least(box["y"] + box["height"], to["y"] + to["height"])
    inside = F.struct(((left - to["x"]) / to["width"]).alias("x"), ((top - to["y"]) / to["height"]).alias("y"), ((right - left) / to["width"]).alias("width"), ((low - top) / to["height"]).alias("height"))
    return F.when((right > left) & (low > top), inside)


def markdown_titles(text: str | Column) -> Column:
    """The titles of a page in Markdown, as keys: lines with #, and all lines of a centred block that has such a line.

    A block is what stands between ``<div ... align="center"`` and ``</div``, or the end of the page. It is found by one pass over the lines.
    """
    lines = F.transform(F.split(_column(text), "\r?\n"), lambda x: F.trim(x))
    bare = lambda line: F.trim(without_tags(line))
    name = lambda line: F.trim(F.regexp_replace(bare(line), "^#+", ""))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("headed"), none.alias("held"), none.alias("titles"))

    def step(s: Column, line: Column) -> Column:
        opens = line.startswith("<div") & F.contains(line, F.lit('align="center"'))
        closes = s["inside"] & line.startswith("</div") & ~opens
        heading = bare(line).startswith("#")
        own = F.when(name(line) != "", F.array(name(line))).otherwise(none)
        done = F.concat(s["titles"], F.when(s["headed"], s["held"]).otherwise(none))
        return (
            F.when(opens, F.struct(F.lit(True).alias("inside"), F.lit(False).alias("headed"), none.alias("held"), s["titles"].alias("titles")))
            .when(closes, F.struct(F.lit(False).alias("inside"), F.lit(False).alias("headed"), none.alias("held"), done.alias("titles")))
            .when(s["inside"], F.struct(F.lit(True).alias("inside"), (s["headed"] | heading).alias("headed"), F.concat(s["held"], own).alias("held"), s["titles"].alias("titles")))
            .otherwise(F.struct(F.lit(False).alias("inside"), F.lit(False).alias("headed"), none.alias("held"), F.concat(s["titles"], F.when(heading, own).otherwise(none)).alias("titles")))
        )

    last = F.aggregate(lines, start, step, lambda s: F.concat(s["titles"], F.when(s["inside"] & s["headed"], s["held"]).otherwise(none)))
    return F.array_distinct(F.filter(F.transform(last, lambda x: fragment_key(x)), lambda t: t != ""))


def hyphens_merged(lines: Column) -> Column:
    """Lines of text (an array): one that ends in a hyphen takes in the next one if that begins with a small letter."""
    none = F.array().cast("array<string>")

    def step(done: Column, line: Column) -> Column:
        last = F.rtrim(F.element_at(done, -1))
        joins = (F.size(done) > 0) & F.element_at(F.concat(F.array(F.lit("")), done), -1).rlike(r"-\s*$") & line.rlike(r"^\s*\p{Ll}")
        whole = F.concat(F.substring(last, F.lit(1), F.length(last) - 1), F.ltrim(line))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(whole))).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(lines, none, step)


def paragraphs_marked(lines: Column) -> Column:
    """Lines of text (an array): one that ends a sentence before one that begins with a capital gets a line feed."""
    ends = lambda line: line.rlike(r"[.!?]\s*$")

    def marked(line: Column, i: Column) -> Column:
        after = F.coalesce(F.get(lines, i + 1), F.lit(""))
        return F.when(ends(line) & after.rlike(r"^\s*\p{Lu}"), F.concat(line, F.lit("\n"))).otherwise(line)

    return F.transform(lines, marked)

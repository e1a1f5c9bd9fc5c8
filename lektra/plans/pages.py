"""Layouts of pages: labels, boxes, texts and titles, over boxes made of the lines of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lektra.functions import layouts as L
from lektra.functions.text import preview
from lektra.plans.catalog import query
from lektra.sources.corpus import Corpus

_LABELS = ("Doc Title", "text", "page-header", "Table Caption", "table_note", "IMAGE", "figure_note", "vision footnote", "formula", "stamp")
_LABEL_SQL = "['Doc Title','text','page-header','Table Caption','table_note','IMAGE','figure_note','vision footnote','formula','stamp'][l_partkey % 10 + 1]"
_TOKEN_SQL = f"regexp_replace(lower(trim({_LABEL_SQL})), '[\\s-]+', '_', 'g')"


def _case(names: dict[str, tuple[str, ...]]) -> str:
    whens = " ".join(f"WHEN t IN ({', '.join(repr(x) for x in labels)}) THEN '{name}'" for name, labels in names.items())
    return f"CASE {whens} END"


def _label():
    return F.get(F.array(*map(F.lit, _LABELS)), (F.col("l_partkey") % 10).cast("int"))


@query(f"SELECT l_orderkey, l_linenumber, coalesce({_case(L.CATEGORIES)}, t) AS category, {_case(L.FILTERS)} AS shown_by FROM (SELECT *, {_TOKEN_SQL} AS t FROM lineitem)")
def l4_category_and_filter(c: Corpus) -> DataFrame:
    return c.table("lineitem").select("l_orderkey", "l_linenumber", L.category(_label()).alias("category"), L.block_filter(_label()).alias("shown_by"))


@query(f"SELECT filter, count(*) AS blocks FROM (SELECT unnest(['all', {_case(L.FILTERS)}]) AS filter FROM (SELECT {_TOKEN_SQL} AS t FROM lineitem)) WHERE filter IS NOT NULL GROUP BY 1")
def l4_blocks_by_filter(c: Corpus) -> DataFrame:
    rows = c.table("lineitem").select(F.explode(F.array(F.lit("all"), L.block_filter(_label()))).alias("filter"))
    return rows.filter("filter is not null").groupBy("filter").agg(F.count("*").alias("blocks"))


_VIEWS = "SELECT l_orderkey AS layout, 'layout-block-' || (l_linenumber * 1000000 + l_partkey) AS id, CASE WHEN l_partkey % 3 = 0 THEN 'unknown' ELSE l_returnflag END AS label, CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber * 1000000 + l_partkey + 1 ELSE CAST(l_quantity AS INT) END AS ord, CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE l_linenumber % 3 + 1 END AS page, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE CAST(l_suppkey % 7 AS INT) END AS group_id, CASE WHEN l_linenumber % 2 = 0 THEN 640 ELSE 1000 END AS width FROM lineitem"


@query(f"SELECT *, row_number() OVER (PARTITION BY layout ORDER BY page, ord, group_id, id, label) AS shown FROM ({_VIEWS})")
def l5_block_views_with_defaults(c: Corpus) -> DataFrame:
    """Blocks as the view shows them: ids, defaults for what is missing, sorted by page, order, group and id."""
    blocks = c.table("lineitem").select(
        F.col("l_orderkey").alias("layout"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("index"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_returnflag")).alias("label"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_quantity").cast("int")).alias("order"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_linenumber") % 3 + 1).alias("page"),
        F.when(F.col("l_partkey") % 2 != 0, (F.col("l_suppkey") % 7).cast("int")).alias("group_id"), F.when(F.col("l_linenumber") % 2 == 0, 640).alias("image_width"), F.lit(1000).alias("layout_width"),
    )
    return block_views(blocks).select("layout", "id", "label", F.col("order").alias("ord"), "page", "group_id", "width", "shown")


def block_views(blocks: DataFrame) -> DataFrame:
    """(layout, id, label, order, page, group_id, width, shown) from blocks with their index in the layout; one window over a layout."""
    page = F.when(F.col("page") >= 1, F.col("page")).otherwise(1)
    made = blocks.select(
        "layout", F.concat(F.lit("layout-block-"), F.col("index").cast("string")).alias("id"), F.when(F.coalesce("label", F.lit("")) == "", "unknown").otherwise(F.col("label")).alias("label"),
        F.coalesce(F.col("order"), F.col("index") + 1).alias("order"), page.alias("page"), F.coalesce("group_id", F.lit(0)).alias("group_id"), F.coalesce("image_width", "layout_width").alias("width"),
    )
    return made.withColumn("shown", F.row_number().over(Window.partitionBy("layout").orderBy("page", "order", "group_id", "id", "label")).cast("long"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(x1 AS INT) END AS x, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(greatest(round(CASE WHEN c > a AND d > b THEN c ELSE CASE WHEN s THEN least(a + c, 1) ELSE a + c END END * m) - x1, 0) AS INT) END AS width FROM (SELECT *, round(a * m) AS x1 FROM (SELECT *, CASE WHEN s THEN 512 ELSE 1 END AS m FROM (SELECT *, least(a, b, c, d) >= 0 AND greatest(a, b, c, d) <= 1 AS s FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_discount AS a, l_tax AS b, CASE WHEN l_partkey % 3 = 0 THEN l_quantity ELSE l_quantity / 64 END AS c, l_quantity / 128 AS d FROM lineitem))))")
def l11_boxes_in_pixels(c: Corpus) -> DataFrame:
    wide = F.when(F.col("l_suppkey") % 11 == 0, 0).otherwise(512)
    third = F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") / 64)
    box = L.pixels_of([F.col("l_discount"), F.col("l_tax"), third, F.col("l_quantity") / 128], wide, F.lit(256))
    return c.table("lineitem").select("l_orderkey", "l_linenumber", box["x"].alias("x"), box["width"].alias("width"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_quantity * 1.5) AS INT) AS x, CAST(round(l_linenumber * 0.25) AS INT) AS y, CAST(round(100 * 1.5) AS INT) AS width, CAST(round(l_quantity * 0.25) AS INT) AS height FROM lineitem")
def l12_rescaled_boxes(c: Corpus) -> DataFrame:
    box = F.struct(F.col("l_quantity").cast("int").alias("x"), F.col("l_linenumber").alias("y"), F.lit(100).alias("width"), F.col("l_quantity").cast("int").alias("height"))
    return c.table("lineitem").select("l_orderkey", "l_linenumber", L.rescaled(box, F.lit(1.5), F.lit(0.25)).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


_UNIT = "SELECT l_orderkey, l_linenumber, l_quantity / 64 AS x, l_linenumber / 8.0 AS y, 0.125 AS w, 0.0625 AS h FROM lineitem"


def _unit_boxes(c: Corpus) -> DataFrame:
    box = F.struct((F.col("l_quantity") / 64).alias("x"), (F.col("l_linenumber") / 8).alias("y"), F.lit(0.125).alias("width"), F.lit(0.0625).alias("height"))
    return c.table("lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))


@query(f"SELECT l_orderkey, l_linenumber, 1 - y - h AS right_x, x AS right_y, CAST(y AS DOUBLE) AS left_x, 1 - x - w AS left_y FROM ({_UNIT})")
def l13_quarter_turns(c: Corpus) -> DataFrame:
    right, left = L.turned(F.col("box"), True), L.turned(F.col("box"), False)
    return _unit_boxes(c).select("l_orderkey", "l_linenumber", right["x"].alias("right_x"), right["y"].alias("right_y"), left["x"].alias("left_x"), left["y"].alias("left_y"))


@query(f"SELECT l_orderkey, l_linenumber, CAST(floor(x * 801 + 0.5) AS INT) AS x, CAST(floor(y * 601 + 0.5) AS INT) AS y, CAST(floor(w * 801 + 0.5) AS INT) AS width, CAST(floor(h * 601 + 0.5) AS INT) AS height FROM ({_UNIT})")
def l13_to_pixels(c: Corpus) -> DataFrame:
    return _unit_boxes(c).select("l_orderkey", "l_linenumber", L.in_pixels(F.col("box"), F.lit(801), F.lit(601)).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query(f"SELECT l_orderkey, l_linenumber, (greatest(x, 0.25) - 0.25) / 0.5 AS x, (least(x + w, 0.75) - greatest(x, 0.25)) / 0.5 AS width FROM ({_UNIT}) WHERE x < 0.75 AND x + w > 0.25 AND y < 0.75 AND y + h > 0.25")
def l13_cropped(c: Corpus) -> DataFrame:
    part = F.struct(F.lit(0.25).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("width"), F.lit(0.5).alias("height"))
    return _unit_boxes(c).withColumn("b", L.cropped(F.col("box"), part)).filter("b is not null").select("l_orderkey", "l_linenumber", "b.x", "b.width")


@query("SELECT l_orderkey AS page, l_linenumber AS line, CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'title' WHEN 7 THEN 'table' WHEN 11 THEN 'footer' ELSE 'plain_text' END AS kind, CAST(round(greatest(x1 * s, 0)) AS INT) AS x, CAST(greatest(round(least((x1 + 10) * s, 1280) - greatest(x1 * s, 0)), 1) AS INT) AS width FROM (SELECT *, CASE WHEN max(x1 + 10) OVER (PARTITION BY l_orderkey) > 640 THEN 1.0 ELSE 2.0 END AS s FROM (SELECT *, l_quantity * (l_orderkey % 3) * 8 - 4 AS x1 FROM lineitem WHERE l_discount >= 0.05))")
def l10_detections(c: Corpus) -> DataFrame:
    """Detections of a model: sure ones alone, in pixels of the image if none exceeds the model's input, held inside it, with their kind."""
    x1 = F.col("l_quantity") * (F.col("l_orderkey") % 3) * 8 - 4
    raw = c.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 12).cast("int").alias("class_id"), F.col("l_discount").alias("score"), x1.alias("x1"), F.lit(1.0).alias("y1"), (x1 + 10).alias("x2"), F.lit(20.0).alias("y2"))
    return detections(raw, {0: "title", 7: "table", 11: "footer"}, least=0.05, model=(640, 640), image=(1280, 960)).select("page", "line", "kind", "box.x", "box.width")


def detections(raw: DataFrame, kinds: dict[int, str], *, least: float, model: tuple[int, int], image: tuple[int, int]) -> DataFrame:
    """(page, line, kind, box, score) from corners of detections; whether a page is scaled is decided by all its sure detections."""
    sure = raw.filter((F.col("score") >= least) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    beyond = F.max(((F.col("x2") > model[0]) | (F.col("y2") > model[1])).cast("int")).over(Window.partitionBy("page")) > 0
    scaled = sure.withColumn("beyond", beyond)
    across, down = (F.when(F.col("beyond"), 1.0).otherwise(i / m) for i, m in zip(image, model))
    left, top = F.greatest(F.col("x1") * across, F.lit(0.0)), F.greatest(F.col("y1") * down, F.lit(0.0))
    right, low = F.least(F.col("x2") * across, F.lit(float(image[0]))), F.least(F.col("y2") * down, F.lit(float(image[1])))
    size = lambda v: F.greatest(F.round(v), F.lit(1.0)).cast("int")
    box = F.struct(F.round(left).cast("int").alias("x"), F.round(top).cast("int").alias("y"), size(right - left).alias("width"), size(low - top).alias("height"))
    kind = F.coalesce(*(F.when(F.col("class_id") == k, v) for k, v in kinds.items()), F.lit("plain_text"))
    return scaled.select("page", "line", kind.alias("kind"), box.alias("box"), "score")


@query("SELECT l_orderkey, l_linenumber, CASE l_partkey % 8 WHEN 0 THEN '## ' || t WHEN 1 THEN '---' || chr(10) || t || chr(10) || '---' WHEN 2 THEN 'Note: ' || t WHEN 3 THEN '```' || chr(10) || t || chr(10) || '```' WHEN 4 THEN t ELSE t END AS text FROM (SELECT *, trim(' ' || l_returnflag || ' ' || l_linestatus || ' ') AS t FROM lineitem) WHERE l_partkey % 8 < 6 AND l_suppkey % 9 <> 0")
def x24_region_texts(c: Corpus) -> DataFrame:
    """Texts of regions of every kind; figures and headers, and blank texts, are left out."""
    kinds = F.array(*map(F.lit, ("title", "table", "footnote", "code", "caption", "reference", "figure", "header")))
    text = F.when(F.col("l_suppkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit(" "), "l_linestatus", F.lit(" ")))
    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", L.region_text(F.get(kinds, (F.col("l_partkey") % 8).cast("int")), text).alias("text"))
    return rows.filter("text is not null")


@query("SELECT doc_id, unnest(['title of ' || source, 'centre ' || lang, 'below ' || doc_id, 'last']) AS title FROM documents")
def x23_markdown_titles(c: Corpus) -> DataFrame:
    page = F.concat(
        F.lit("# Title <b>of</b>  "), "source", F.lit("\nplain text\n<div class=\"x\" align=\"center\">\n## Centre "), "lang", F.lit("\nBelow "), F.col("doc_id").cast("string"),
        F.lit("\n</div>\n<div align=\"center\">\nno heading here\n</div>\n#\n  ### Last\n# title of "), "source", F.lit("\n<div align=\"center\">\nopen without a heading"),
    )
    return c.documents.select("doc_id", F.explode(L.markdown_titles(page)).alias("title"))


@query("SELECT doc_id, ['one ' || source || lang, 'Two-', 'Three.' || chr(10), 'Four five' , 'six'] AS lines FROM documents")
def w9_hyphens_and_paragraphs(c: Corpus) -> DataFrame:
    lines = F.array(F.concat(F.lit("one "), "source", F.lit("-  ")), F.col("lang"), F.lit("Two-"), F.lit("Three."), F.lit("Four fi-"), F.lit("ve"), F.lit("six"))
    return c.documents.select("doc_id", L.paragraphs_marked(L.hyphens_merged(lines)).alias("lines"))


_LAYOUTS = "SELECT l_orderkey AS layout, l_linenumber AS place, CASE WHEN l_partkey % 3 = 0 THEN 'unknown' ELSE l_returnflag END AS label, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE l_linestatus END AS content, l_quantity AS x, CAST(0 AS DOUBLE) AS y, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_linenumber AS INT) END AS page FROM lineitem"


@query(_LAYOUTS)
def n5_layout_parse(c: Corpus) -> DataFrame:
    """Blocks from their JSON with defaults for what is missing or of another type; text that is no array gives none."""
    line = F.struct(
        F.col("l_linenumber").alias("place"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_returnflag")).alias("label"), F.when(F.col("l_suppkey") % 2 != 0, F.col("l_linestatus")).alias("content"),
        F.struct(F.col("l_quantity").alias("x"), F.lit("wide").alias("y")).alias("bbox"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_linenumber")).alias("page"),
    )
    rows = c.table("lineitem").select(F.col("l_orderkey").alias("layout"), F.concat(F.lit("["), F.to_json(line), F.lit("]")).alias("blocks"))
    return parsed_blocks(rows.union(c.spark.createDataFrame([(-1, "{}"), (-2, "no json"), (-3, None)], "layout long, blocks string"))).select("layout", "place", "label", "content", "x", "y", "page")


def parsed_blocks(layouts: DataFrame) -> DataFrame:
    """(layout, place, label, content, x, y, width, height, page) of each block of a column ``blocks`` of JSON."""
    whole = F.when(F.col("blocks").rlike(r"^\s*\["), F.from_json("blocks", "array<struct<place:int,label:string,content:string,bbox:map<string,string>,page:int>>"))
    rows = layouts.select("layout", F.explode(whole).alias("b")).filter("b is not null")
    number = lambda name: F.coalesce(F.try_to_number(F.col("b.bbox")[name], F.lit("999999999999.999999")).cast("double"), F.lit(0.0)).alias(name)
    return rows.select("layout", "b.place", F.coalesce("b.label", F.lit("unknown")).alias("label"), F.coalesce("b.content", F.lit("")).alias("content"), number("x"), number("y"), number("width"), number("height"), "b.page")


@query("SELECT doc_id, CASE WHEN length(l) > 120 THEN rtrim(substring(l, 1, 119)) || '…' ELSE l END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS l FROM documents)")
def l5_block_preview(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", preview("text").alias("preview"))


@query("SELECT l_orderkey AS page, 'region' AS part, CAST(l_linenumber AS BIGINT) AS place, 'r' || l_linenumber AS said FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_orderkey, 'block', l_linenumber, 'part ' || l_partkey FROM lineitem UNION ALL SELECT l_orderkey, 'text', 0, string_agg('part ' || l_partkey, chr(10) ORDER BY l_linenumber, 'part ' || l_partkey) FROM lineitem GROUP BY 1")
def s17_layout_response_parts(c: Corpus) -> DataFrame:
    """The answer of a layout service for each page: its regions, its blocks in their order, and the text of the page."""
    block = F.struct(F.col("l_linenumber").alias("order"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("content"), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("r"), F.col("l_linenumber").cast("string"))).alias("region"))
    said = c.table("lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.to_json(F.struct(F.collect_list(block).alias("blocks"))).alias("said"))  # the lines of one page
    blocks = F.array_sort(F.from_json("said", "blocks array<struct<order:int,content:string,region:string>>")["blocks"])
    pages = said.select("page", blocks.alias("blocks"))
    each = pages.select("page", F.explode("blocks").alias("b"))
    regions = each.filter("b.region is not null").select("page", F.lit("region").alias("part"), F.col("b.order").cast("long").alias("place"), F.col("b.region").alias("said"))
    shown = each.select("page", F.lit("block"), F.col("b.order").cast("long"), "b.content")
    return regions.union(shown).union(pages.select("page", F.lit("text"), F.lit(0).cast("long"), F.array_join(F.transform("blocks", lambda b: b["content"]), "\n")))

"""Entities and triples: parse, name, suppress, replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektra.functions.text import entity_key, squeezed

#: Aliases of entity types.
TYPES = {
    "person": ("PER", "PERSON", "PERSONA"),
    "place": ("LOC", "LOCATION", "PLACE", "LUGAR", "GPE"),
    "organization": ("ORG", "ORGANIZATION", "ORGANISATION", "INSTITUTION", "ORGANIZACIÓN", "INSTITUCIÓN"),
    "date": ("DATE", "FECHA"),
    "misc": ("MISC", "OTHER", "OTRO"),
}


def entity_type(alias: Column) -> Column:
    """The canonical type of an alias; null for others."""
    out = F.lit(None).cast("string")
    for name, aliases in TYPES.items():
        out = F.when(F.upper(F.trim(alias)).isin(*aliases), name).otherwise(out)
    return out


ENTITY = "array<struct<value:string,type:string,confidence:double,start:int,end:int>>"


def parsed_entities(results: DataFrame, default: float = 0.95) -> DataFrame:
    """(item_id, value, type, confidence, start, end): from rows (item_id, text, result as JSON).

    Unknown types go; a span that is missing is sought in the text; of equal values of a type the first stays.
    """
    rows = results.select("item_id", "text", F.posexplode(F.from_json("result", ENTITY)).alias("place", "e"))
    found = F.expr("instr(lower(text), lower(e.value))")
    given = F.col("e.start").isNotNull() & (F.col("e.end") >= F.col("e.start"))
    rows = rows.select(
        "item_id", "place", F.col("e.value").alias("value"), entity_type(F.col("e.type")).alias("type"), F.greatest(F.least(F.coalesce("e.confidence", F.lit(default)), F.lit(1.0)), F.lit(0.0)).alias("confidence"),
        F.when(given, F.col("e.start")).when(found > 0, found - 1).otherwise(0).alias("start"), F.when(given, F.col("e.end")).when(found > 0, found - 1 + F.length("e.value")).otherwise(0).alias("end"),
    )
    first = Window.partitionBy("item_id", entity_key("value"), "type").orderBy("place")
    return rows.filter("type is not null and value is not null").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "place")


def unprotected(found: DataFrame, protected: DataFrame) -> DataFrame:
    """Entities that no protected one of their item shields, by an equal value of the type or an overlapping span."""
    shield = protected.select(F.col("item_id").alias("p_item"), entity_key("value").alias("p_key"), F.col("type").alias("p_type"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    same = (F.col("item_id") == F.col("p_item")) & (F.col("type") == F.col("p_type"))
    met = (entity_key("value") == F.col("p_key")) | ((F.col("start") < F.col("p_end")) & (F.col("p_start") < F.col("end")))
    return found.join(shield, same & met, "left_anti")


def parsed_triples(results: DataFrame) -> DataFrame:
    """(item_id, subject, predicate, object) from rows (item_id, result as JSON); blank parts and repeats go."""
    kind = "array<struct<subject:string,predicate:string,object:string,sujeto:string,predicado:string,objeto:string>>"
    rows = results.select("item_id", F.posexplode(F.from_json("result", kind)).alias("place", "t"))
    parts = {a: squeezed(F.coalesce(f"t.{a}", f"t.{b}")) for a, b in (("subject", "sujeto"), ("predicate", "predicado"), ("object", "objeto"))}
    rows = rows.select("item_id", "place", *(v.alias(k) for k, v in parts.items())).filter("subject <> '' and predicate <> '' and object <> ''")
    first = Window.partitionBy("item_id", *(F.lower(k) for k in parts)).orderBy("place")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "place")


def replaced(old: DataFrame, new: DataFrame, scope: str, automatic: Column) -> DataFrame:
    """Automatic rows of the scopes that occur in ``new`` give way to it; others stay."""
    scopes = new.select(F.col(scope).alias("__k")).distinct()
    gone = old.filter(automatic).join(scopes, F.col(scope) == F.col("__k"), "left_anti")
    return old.filter(~automatic).unionByName(gone).unionByName(new)


def geocoded(entities: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Pending places become resolved or not_found by a gazetteer (key, latitude, longitude); other types skipped."""
    rows = entities.withColumn("__key", entity_key("value")).join(gazetteer.withColumnRenamed("key", "__key"), "__key", "left")
    status = F.when(F.col("type") != "place", "skipped").when(F.col("latitude").isNotNull(), "resolved").otherwise("not_found")
    return rows.withColumn("geo_status", F.when(F.col("geo_status") == "pending", status).otherwise(F.col("geo_status"))).drop("__key")


def pending_places(entities: DataFrame) -> DataFrame:
    """Places that still have to be located; those that a user deleted are left out."""
    return entities.filter((F.col("type") == "place") & (F.col("geo_status") == "pending") & (F.col("source").isNull() | (F.col("source") != "manual_deleted")))


def reviewed(answers: DataFrame, candidates: DataFrame, protected: DataFrame) -> DataFrame:
    """(item_id, value, type, confidence, start, end): the entities that a reviewer's answer (item_id, text, review) names.

    The JSON may stand in a fence with words around. An entity takes the span of the first candidate of its item with an equal value
    and type, and the greater confidence; others are sought in the text. Protected ones go.
    """
    body = F.regexp_extract("review", r"(?s)([\[{].*[\]}])", 1)
    whole = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    found = parsed_entities(answers.select("item_id", "text", whole.alias("result"))).withColumn("__key", entity_key("value"))
    known = candidates.select(F.col("item_id").alias("c_item"), entity_key("value").alias("c_key"), F.col("type").alias("c_type"), F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("confidence").alias("confidence")).alias("c"))
    known = known.groupBy("c_item", "c_key", "c_type").agg(F.min("c").alias("c"))
    met = found.join(known, (F.col("item_id") == F.col("c_item")) & (F.col("__key") == F.col("c_key")) & (F.col("type") == F.col("c_type")), "left")
    made = met.select("item_id", "value", "type", F.greatest(F.col("confidence"), F.col("c.confidence")).alias("confidence"), F.coalesce("c.start", "start").alias("start"), F.coalesce("c.end", "end").alias("end"))
    return unprotected(made, protected)


def replaced_in(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """All old rows of the scopes (item, or item and asset) that occur in ``new`` give way to it."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").select(*old.columns).unionByName(new)


def unsuppressed(candidates: DataFrame, guards: DataFrame, *, width: int | None = None) -> DataFrame:
    """The candidates that no guard of their group suppresses, by an equal value or by a span that overlaps.

    Both have group, value, start and end (exclusive). Equal values are a semi join. Spans are dealt to bins as wide as a span is on
    average, or ``width``, so that a span is in few bins, and meet there; of guards that are alike one is enough. A null group, value or bound suppresses nothing.
    """
    at = lambda df, side: df.withColumn(f"__{side}_bin", F.explode_outer(F.when(F.col(f"__{side}_end").isNotNull() & F.col(f"__{side}_start").isNotNull(), F.sequence(F.floor(F.col(f"__{side}_start") / width), F.floor(F.greatest(F.col(f"__{side}_end") - 1, F.col(f"__{side}_start")) / width)))))
    keyed = candidates.withColumns({"__c_group": F.col("group"), "__c_value": F.col("value"), "__c_start": F.col("start").cast("long"), "__c_end": F.col("end").cast("long")})
    others = guards.select(F.col("group").alias("__g_group"), F.col("value").alias("__g_value"), F.col("start").cast("long").alias("__g_start"), F.col("end").cast("long").alias("__g_end"))
    if width is None:
        mean = keyed.select((F.col("__c_end") - F.col("__c_start")).alias("n")).unionByName(others.select((F.col("__g_end") - F.col("__g_start")).alias("n"))).agg(F.avg("n")).first()[0]
        width = max(int(mean or 1), 1)
    by_value = keyed.join(others.select("__g_group", "__g_value").distinct(), (F.col("__c_group") == F.col("__g_group")) & (F.col("__c_value") == F.col("__g_value")), "left_anti")
    spans = at(others.select("__g_group", "__g_start", "__g_end").distinct(), "g").filter("__g_bin is not null")
    meet = (F.col("__c_group") == F.col("__g_group")) & (F.col("__c_bin") == F.col("__g_bin")) & (F.col("__c_start") < F.col("__g_end")) & (F.col("__g_start") < F.col("__c_end"))
    places = at(by_value.select("__c_group", "__c_start", "__c_end").distinct(), "c").filter("__c_bin is not null")
    hit = places.join(spans, meet, "left_semi").select(F.col("__c_group").alias("__h_group"), F.col("__c_start").alias("__h_start"), F.col("__c_end").alias("__h_end")).distinct()
    left = by_value.join(hit, (F.col("__c_group") == F.col("__h_group")) & (F.col("__c_start") == F.col("__h_start")) & (F.col("__c_end") == F.col("__h_end")), "left_anti")
    return left.select(*candidates.columns)

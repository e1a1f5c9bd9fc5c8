"""Operator 3: URL filters by a ratio of character language models, in DataFrame functions alone.

Rules on hosts and paths judge the URLs that they fit. Two variable-order Markov models over characters, one of the
allowed and one of the blocked URLs, judge the rest: the counts of all character sequences up to a length are
interpolated with their shorter ends (Witten-Bell), and a URL's score is the log-likelihood difference by character,
against a threshold that is set on labelled URLs which the models haven't seen.

Each sequence carries what it adds to the score of its own shorter end, so that the sum over all sequences of a URL is
the sum over its characters of the longest known context, and scoring is one join with a table that the alphabet
bounds (34 symbols, four at most: 1.4 million rows, proven whatever the input) and one sum for each row.

Defined results: a null URL, or one without ``://``, has an empty host and path and is judged by the models
like any other; rows with equal ids are judged row by row; without labelled URLs of both kinds all scores are 0 and
the rest is allowed; an empty table gives an empty table; extra columns stay behind.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektra.llm.common import settled

#: The longest sequences that are counted: three symbols of context and the symbol itself.
ORDER = 4
#: Symbols of the models: a to z, one for digits, / . - _, one for all else, and the marks of start and end.
ALPHABET = 34
#: One labelled URL of this many sets the threshold and isn't counted.
HELD_OUT = 5


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of the path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def symbols() -> Column:
    text = F.translate(F.concat("host", "path"), string.ascii_uppercase, string.ascii_lowercase)
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[^a-z0/._-]", "~")
    return F.concat(F.lit("^"), text, F.lit("$"))


def sequences(rows: DataFrame) -> DataFrame:
    """A row for each sequence of up to ORDER symbols, at each place."""
    at = F.explode(F.sequence(F.lit(1), F.length("symbols")))
    placed = rows.withColumn("at", at)
    each = F.explode(F.array(*(F.when(F.col("at") + n - 1 <= F.length("symbols"), F.col("symbols").substr(F.col("at"), F.lit(n))) for n in range(1, ORDER + 1))))
    return placed.withColumn("sequence", each).filter(F.col("sequence").isNotNull()).drop("at")


def model(labelled: DataFrame) -> DataFrame:
    """(sequence, adds): from rows with symbols and label, allow or block."""
    counts = sequences(labelled.select("symbols", "label")).groupBy("sequence").agg(*(F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(x) for x in ("allow", "block")))
    counts = settled(counts)
    levels, shorter = [], None
    for n in range(1, ORDER + 1):
        level = counts.filter(F.length("sequence") == n).withColumn("context", F.expr(f"left(sequence, {n - 1})"))
        totals = level.groupBy("context").agg(*(f(x) for x in ("allow", "block") for f in (lambda c: F.sum(c).alias(f"{c}_n"), lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))))
        level = level.join(totals, "context")
        if shorter is None:
            level = level.withColumns({f"{x}_shorter": F.lit(1.0 / ALPHABET) for x in ("allow", "block")})
        else:
            ends = shorter.select(F.col("sequence").alias("end"), *(F.col(f"{x}_p").alias(f"{x}_shorter") for x in ("allow", "block")))
            level = level.withColumn("end", F.expr("substring(sequence, 2)")).join(ends, "end").drop("end")
        for x in ("allow", "block"):
            whole = F.col(f"{x}_n") + F.col(f"{x}_kinds")
            level = level.withColumn(f"{x}_p", F.when(whole == 0, F.col(f"{x}_shorter")).otherwise((F.col(x) + F.col(f"{x}_kinds") * F.col(f"{x}_shorter")) / whole))
        shorter = settled(level.select("sequence", "allow_p", "block_p", (F.log(F.col("allow_p") / F.col("block_p")) - F.log(F.col("allow_shorter") / F.col("block_shorter"))).alias("adds")))
        levels.append(shorter.select("sequence", "adds"))
    return reduce(DataFrame.unionByName, levels)


def threshold(scored: DataFrame) -> float:
    """The score that tells held-out allowed from held-out blocked URLs best, each kind weighing the same."""
    bins = F.greatest(F.least(F.round(F.col("score") * 100), F.lit(1000)), F.lit(-1000)).cast("int")
    counts = scored.groupBy(bins.alias("bin")).agg(*(F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(x) for x in ("allow", "block"))).orderBy("bin").collect()  # 2001 rows at most
    allow, block = sum(r.allow for r in counts), sum(r.block for r in counts)
    if not allow or not block:
        return 0.0
    best, below_allow, below_block, found = -1.0, 0, 0, []
    for r in counts:
        right = (allow - below_allow) / allow + below_block / block
        if right > best + 1e-12:
            best, found = right, []
        if abs(right - best) <= 1e-12:
            found.append(r.bin)
        below_allow, below_block = below_allow + r.allow, below_block + r.block
    lower = max([r.bin for r in counts if r.bin < found[0]], default=found[0])
    return (lower + found[0]) / 200


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of each row."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = by_rules(rules)
    rows = settled(rows.withColumns({"rule": name, "label": verdict, "symbols": symbols(), "row": F.monotonically_increasing_id()}))
    held = F.pmod(F.xxhash64("host", "path"), F.lit(HELD_OUT)) == 0
    adds = model(rows.filter(F.col("label").isNotNull() & ~held))
    joined = sequences(rows.select("row", "symbols")).join(F.broadcast(adds), "sequence", "left")
    scores = joined.groupBy("row").agg(F.sum(F.coalesce("adds", F.lit(0.0))).alias("sum"))
    scored = settled(rows.join(scores, "row", "left").withColumn("score", F.coalesce(F.col("sum") / F.length("symbols"), F.lit(0.0))))
    least = threshold(scored.filter(F.col("label").isNotNull() & held))
    own = F.when(F.col("score") >= least, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "score", F.lit(least).alias("threshold"))

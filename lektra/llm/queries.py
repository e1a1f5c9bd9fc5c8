"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.llm import alignment, bpe, decontamination, filteraudit, licenses, nndescent, quality, secrets, sharding, simhash, substrings, tokenfiles, urls
from lektra.llm.common import fresh_path, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "quality")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 40)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), path, end_id=2)
    return tokenfiles.read(spark, path)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "words", "edits", "item_words")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scanned(table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scanned(table(spark, sf_dir, "documents")))


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of each document as a digest, which is made of them where they are composed."""
    found = alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE), told=lambda text: hashlib.sha256(text.encode()).hexdigest())
    return found.select("doc_id", *alignment.COUNTS, F.coalesce("groups", F.lit("")).alias("groups_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of operator 2 that its contract fixes."""
    found = quality.counted(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *quality.COUNTS[:5], quality.base_failed().alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of operator 3 that its contract fixes."""
    found = urls.judged(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def shard_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law of operator 4 promises, and its sizes, as sums: slots without gaps, shards of near equal bytes."""
    found = sharding.sharded(table(spark, sf_dir, "documents"), 40)
    shards = found.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    mean, most = F.sum("bytes") / 40, F.max(F.struct("bytes"))["bytes"]
    sums = shards.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.count_if((F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("gapless"), F.count("*").alias("shards"), (most <= 1.2 * mean).alias("even"))
    largest = found.agg(F.max("size").alias("largest"))
    return sums.crossJoin(largest).select("rows", "bytes", (F.col("gapless") == F.col("shards")).alias("gapless"), (F.col("even") | (F.col("largest") * 20 > F.col("bytes") / 40)).alias("even"))  # one row each


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of operator 9 that its contract fixes."""
    return op9_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 10 that its contract fixes."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


OPERATORS = (op1_bpe_pair_index, op2_quality_rules, op3_url_filter, op4_sharding, op5_token_files, op6_simhash, op7_decontamination, op8_substring_dedup, op9_secret_scan, op10_license_scan, op11_nn_descent, op12_token_alignment, op13_filter_audit)
PARTS = (base_counts, url_rules, shard_sums, secret_counts, license_phrases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS + PARTS}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT said, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (said) WHERE first < doc_id),
taken AS (SELECT doc_id, list(i) AS spots FROM gone GROUP BY 1),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(spots), 0) AS n_removed, CASE WHEN spots IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(spots, i)), lambda i: w[i]) END AS k FROM d LEFT JOIN taken USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""

_COUNTS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, said FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM windows JOIN twice USING (doc_id, said)) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
counts AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts"""

_URLS = """
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
rules AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) r(rule, on_host, on_path, ruled)),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled FROM h JOIN rules ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, on_path) GROUP BY 1)
SELECT page_id, host, path, rule, ruled FROM h LEFT JOIN fits USING (page_id)"""

_SECRETS = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

_LICENSES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
found AS (SELECT doc_id, i - 1 AS place, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM each),
sums AS (SELECT doc_id, count(*) AS n, min(place) AS low, max(place) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found WHERE label IS NOT NULL GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN sums USING (doc_id)"""

_AUDIT = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT o FROM (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t) WHERE contains(o, 'A') AND contains(o, 'B') AND contains(o, 'C') AND contains(o, 'D') AND contains(o, 'E')),
cells AS (SELECT part, o, step, substring(o, step, 1) AS letter, n, good, toxic, a::INT + b::INT + c::INT + d::INT + e::INT AS failing,
  CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
  coalesce(least(CASE WHEN a THEN strpos(o, 'A') END, CASE WHEN b THEN strpos(o, 'B') END, CASE WHEN c THEN strpos(o, 'C') END, CASE WHEN d THEN strpos(o, 'D') END, CASE WHEN e THEN strpos(o, 'E') END), 9) AS first
  FROM g, orders, unnest(range(1, 6)) s(step)),
sums AS (SELECT part, o AS filter_order, step::INT AS step, letter, sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND first < step THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND failing = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost FROM cells GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM sums"""

_SHARDS = "SELECT count(*) AS rows, CAST(sum(coalesce(strlen(text), 0) + 16) AS BIGINT) AS bytes, true AS gapless, true AS even FROM documents"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries, or the parts of them, that it can express."""
    return {"op8_substring_dedup": _SUBSTRINGS, "op13_filter_audit": _AUDIT, "base_counts": _COUNTS, "url_rules": _URLS, "shard_sums": _SHARDS, "secret_counts": _SECRETS, "license_phrases": _LICENSES}

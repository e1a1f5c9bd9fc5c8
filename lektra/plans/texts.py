"""Text and number functions over the tables."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.functions import numbers as N
from lektra.functions import text as T
from lektra.functions.notes import sanitized_html
from lektra.functions.udfs import chunked, repaired, unicode_nfc
from lektra.plans.catalog import query
from lektra.sources.corpus import Corpus

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_WORDS = rf"""SELECT doc_id, source, regexp_replace(w, '^[''’-]+|[''’-]+$', '', 'g') AS word FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’-]*')) AS w FROM documents)"""
_KEPT = rf"length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+([.,][0-9]+)?') AND word NOT IN ({_STOP})"


@query(f"WITH w AS ({_WORDS}) SELECT word, count(*) AS count FROM w WHERE {_KEPT} AND source = 'src1' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def o7_topk_words(c: Corpus) -> DataFrame:
    return frequencies(c.documents.filter("source = 'src1'")).orderBy(F.desc("count"), "word").limit(50)


def frequencies(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


@query(f"WITH w AS ({_WORDS}) SELECT word, count(*) AS count FROM w WHERE {_KEPT} GROUP BY 1")
def g15_word_frequency(c: Corpus) -> DataFrame:
    return frequencies(c.documents)


@query(f"WITH w AS ({_WORDS}) SELECT count(DISTINCT word) AS words, count(*) AS tokens FROM w WHERE {_KEPT}")
def g16_corpus_totals(c: Corpus) -> DataFrame:
    return frequencies(c.documents).agg(F.count("*").alias("words"), F.sum("count").alias("tokens"))


@query(f"WITH w AS ({_WORDS}) SELECT doc_id, count(*) AS n FROM w WHERE {_KEPT} GROUP BY 1")
def x3_tokenize(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", F.size(T.words("text")).cast("long").alias("n")).filter("n > 0")


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(l, '(?im)^[ ]*(hablante|speaker)[ ]*[0-9]+[ ]*:[ ]*', '', 'g'), '(?m)^[ ]*\p{Lu}[\p{L}\p{M}''’.-]*([ ]\p{Lu}[\p{L}\p{M}''’.-]*){0,2}[ ]*:[ ]*', '', 'g') AS text FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Speaker ' || turn || ': ' || text WHEN 1 THEN 'Ana María: ' || text ELSE text END AS l FROM conversations)")
def x1_strip_speaker_labels(c: Corpus) -> DataFrame:
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Speaker "), F.col("turn").cast("string"), F.lit(": "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Ana María: "), "text")).otherwise(F.col("text"))
    return c.table("conversations").select("conv_id", "turn", T.without_speakers(line).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def x2_nfc(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", unicode_nfc("text").alias("text"))


@query("SELECT DISTINCT unnest(string_split_regex('  el la, uno;dos  la ', '[ ,;]+')) AS word EXCEPT SELECT ''")
def x5_parse_stopwords(c: Corpus) -> DataFrame:
    return c.spark.sql("SELECT '  el la, uno;dos  la ' AS raw").select(F.explode(F.array_distinct(F.filter(F.split("raw", "[ ,;]+"), lambda w: w != ""))).alias("word"))


@query(r"SELECT doc_id, CASE WHEN strpos(lower(text), 'thing') > 0 THEN CASE WHEN length(text) <= 80 THEN text ELSE substring(text, greatest(least(greatest(strpos(lower(text), 'thing') - 1 - 40, 0), length(text) - 80), 0) + 1, 80) END ELSE CASE WHEN length(text) <= 80 THEN text ELSE substring(text, 1, 80) END END AS snippet FROM documents")
def x8_snippet_window(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.snippet(F.col("text"), T.question_terms("the thing?"), 80).alias("snippet"))


@query("SELECT doc_id, substring(text, 1, 500) AS head FROM documents")
def x10_truncate_chars(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", F.substring("text", 1, 500).alias("head"))


_LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length(l) > 60 THEN substring(l, 1, 60) || '…' ELSE l END AS title FROM (SELECT doc_id, {_LINE} AS l FROM documents)")
def x11_one_line_title(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.one_line("text").alias("title"))


@query(f"SELECT doc_id, CASE WHEN length(l) > 120 THEN rtrim(substring(l, 1, 119)) || '…' ELSE l END AS preview FROM (SELECT doc_id, {_LINE} AS l FROM documents)")
def x12_preview(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.preview("text").alias("preview"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN substring(p_name, 1, 11) || '…' ELSE p_name END AS label FROM part")
def x13_truncate_label(c: Corpus) -> DataFrame:
    return c.table("part").select("p_partkey", T.short_label("p_name").alias("label"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(thing|the|on)', '[\\1]', 'g') AS marked FROM documents")
def x14_highlight_terms(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.highlighted(F.col("text"), ["on", "The", "thing", "the"]).alias("marked"))


@query('WITH RECURSIVE c AS (SELECT doc_id, text, -1 AS chunk, 0 AS start, 0 AS stop FROM documents UNION ALL SELECT doc_id, text, chunk + 1, stop, CAST(CASE WHEN stop + 28000 >= length(text) THEN length(text) WHEN strpos(reverse(substring(text, stop + 14001, 14000)), chr(10)) > 0 THEN stop + 28000 - strpos(reverse(substring(text, stop + 14001, 14000)), chr(10)) + 1 ELSE stop + 28000 END AS INT) FROM c WHERE stop < length(text)) SELECT doc_id, chunk, start, stop - start AS n FROM c WHERE chunk >= 0')
def x15_chunk_text(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", F.posexplode(chunked("text"))).select("doc_id", F.col("pos").alias("chunk"), "col.start", F.length("col.text").alias("n"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN regexp_extract(substring(text, 1, 300), '(?s)^(.*[.!?。！？])', 1) <> '' THEN regexp_extract(substring(text, 1, 300), '(?s)^(.*[.!?。！？])', 1) ELSE substring(text, 1, 300) END AS cut FROM documents")
def x16_sentence_truncate(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.whole_sentences("text", 300).alias("cut"))


@query('SELECT doc_id, text FROM documents')
def x17_repair_mojibake(c: Corpus) -> DataFrame:
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return c.documents.select("doc_id", repaired(broken).alias("text"))


@query(r"""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace('  «' || p_name || '», ', '^[\s.,;:!?"''()\[\]{}<>«»“”‘’*_-]+|[\s.,;:!?"''()\[\]{}<>«»“”‘’*_-]+$', '', 'g'), '\s+', ' ', 'g'))) AS key FROM part""")
def x18_normalize_entity(c: Corpus) -> DataFrame:
    return c.table("part").select("p_partkey", T.entity_key(F.concat(F.lit("  «"), "p_name", F.lit("», "))).alias("key"))


@query(f"SELECT doc_id, trim(regexp_replace(translate(lower(text), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def x20_normalize_metadata_key(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.metadata_key("text").alias("key"))


@query("SELECT DISTINCT upper(trim(event_type)) AS topic FROM events")
def x21_topic_normalise(c: Corpus) -> DataFrame:
    return c.table("events").select(T.topic_name("event_type").alias("topic")).distinct()


@query(r"SELECT page_id, lower(trim(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM pages")
def x22_strip_html_tags(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", T.fragment_key("html").alias("text"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Question' WHEN 'assistant' THEN 'Answer' ELSE role END || ': ' || text AS line FROM conversations")
def x25_remap_speakers(c: Corpus) -> DataFrame:
    names = F.create_map(F.lit("user"), F.lit("Question"), F.lit("assistant"), F.lit("Answer"))
    return c.table("conversations").select("conv_id", "turn", F.concat_ws(": ", F.coalesce(names[F.col("role")], F.col("role")), "text").alias("line"))


@query()
def x26_note_html_sanitize(c: Corpus) -> DataFrame:
    """Whole pages as notes; SQL has no HTML parser, so a test holds it against another one."""
    return c.table("pages").select("page_id", sanitized_html("html").alias("html"))


_ESCAPED = "replace(replace(replace(split_part(text, chr(10), 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN said = '' THEN '' ELSE '<p>' || said || '</p>' END
  ELSE '<p>' || said || '<p>click <strong>ok</strong></p><ul><li><a href="https://example.org/' || doc_id || '" target="_blank" rel="noopener noreferrer nofollow">a</a></li><li><a href="tel:' || doc_id || '" target="_blank" rel="noopener noreferrer nofollow">b</a></li><li><a href="#' || doc_id || '" target="_blank" rel="noopener noreferrer nofollow">c</a>"</li></ul></p>' END AS html
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim({_ESCAPED}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE {_ESCAPED} END AS said FROM documents WHERE text IS NOT NULL)""")
def x26_notes_sanitized(c: Corpus) -> DataFrame:
    """The first line of each text within what a note may hold: of every third inline only, of the others with links and lists."""
    line = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    number = F.col("doc_id").cast("string")
    inline = F.concat(F.lit("<b>"), line, F.lit("</b><em> </em><script>x('</p>')</script>"))
    block = F.concat(
        F.lit("<div>"), line, F.lit('<p><a href="javascript:alert(1)">click</a> <strong onclick="x">ok</strong><p> </p><section></section><style>p{}</style><ul><li><a href="example.org/'), number,
        F.lit('">a</a><li><a href="TEL:'), number, F.lit('">b</a><li><a href="#'), number, F.lit('">c</a>&quot;</ul></div><h2><i></i></h2>'),
    )
    return c.documents.filter("text is not null").select("doc_id", sanitized_html(F.when(F.col("doc_id") % 3 == 0, inline).otherwise(block)).alias("html"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\n[ \\t]*\\n+'), lambda p: trim(p) <> ''), lambda p: '<p>' || replace(trim(p), chr(10), '<br>') || '</p>'), '') AS html, NOT regexp_matches(text, '<[a-zA-Z/]') AS plain FROM documents")
def x27_note_plain_to_html(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.html_paragraphs("text").alias("html"), (~F.col("text").rlike("<[a-zA-Z/]")).alias("plain"))


@query("SELECT id, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS ending FROM assets", "assets")
def x29_base_name(c: Corpus) -> DataFrame:
    return c.assets.select("id", T.base_name("path").alias("name"), T.extension("path").alias("ending"))


@query("SELECT id, 'scan' || id AS stem FROM assets", "assets")
def x30_version_stem(c: Corpus) -> DataFrame:
    versioned = F.concat(F.lit("a/scan"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "_v12.png").otherwise(".png"))
    return c.assets.select("id", T.version_stem(versioned).alias("stem"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'absolute' WHEN 2 THEN 'drive' WHEN 3 THEN 'dots' WHEN 4 THEN 'outside' END AS error FROM events")
def x31_validate_rel_path(c: Corpus) -> DataFrame:
    paths = F.element_at(F.array(*map(F.lit, ("", "/etc/x", "C:/x", "assets/../x", "other/x", "assets/a/b.png"))), (F.col("event_id") % 6 + 1).cast("int"))
    return c.table("events").select("event_id", T.path_error(paths).alias("error"))


@query(r"SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v)), lambda v: v <> ''), 1, 3), ' ') AS head FROM documents")
def x35_preview_three_lines(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.three_lines("text").alias("head"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN title ELSE 'item ' || id END AS shown FROM items", "items")
def x36_title_fallback(c: Corpus) -> DataFrame:
    title = F.when(F.col("id") % 2 == 0, F.col("title")).otherwise("")
    return c.items.select("id", F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("item "), F.col("id").cast("string"))).alias("shown"))


@query("SELECT id, CASE WHEN starts_with(path, 'assets/src1/') THEN replace(path, 'assets/src1/', 'assets/moved/') ELSE path END AS path FROM assets", "assets")
def x34_path_prefix_replace(c: Corpus) -> DataFrame:
    return c.assets.select("id", F.when(F.col("path").startswith("assets/src1/"), F.replace("path", F.lit("assets/src1/"), F.lit("assets/moved/"))).otherwise(F.col("path")).alias("path"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS ms FROM events")
def m1_epoch_to_ms(c: Corpus) -> DataFrame:
    stamp = F.col("ts").cast("timestamp")
    return c.table("events").select("event_id", N.epoch_ms(F.when(F.col("event_id") % 2 == 0, F.unix_seconds(stamp)).otherwise(F.unix_millis(stamp))).alias("ms"))


@query("SELECT event_id, CASE WHEN event_id >= 3600 THEN event_id // 3600 || ':' || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(event_id // 60 AS VARCHAR) END || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS clock FROM events")
def m2_format_clock(c: Corpus) -> DataFrame:
    return c.table("events").select("event_id", N.clock(F.col("event_id")).alias("clock"))


@query("SELECT event_id, CASE WHEN m >= 1440 THEN m // 1440 || 'd' WHEN m >= 60 THEN m // 60 || 'h' WHEN m >= 1 THEN m || 'm' ELSE 'now' END AS age FROM (SELECT event_id, (max(epoch_us(ts) // 1000) OVER () - epoch_us(ts) // 1000) // 60000 AS m FROM events)")
def m3_time_ago(c: Corpus) -> DataFrame:
    rows = c.table("events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("ms").alias("now")))).select("event_id", N.age(F.col("ms"), F.col("now")).alias("age"))  # one row


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'danger' WHEN 1 THEN 'warning' WHEN 2 THEN 'danger' ELSE 'info' END AS severity FROM events")
def m14_severity_map(c: Corpus) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("Critical", "WARN", "error", "notice"))), (F.col("event_id") % 4 + 1).cast("int"))
    return c.table("events").select("event_id", N.severity(names).alias("severity"))


@query("SELECT id, CASE WHEN size >= 1048576 THEN CASE WHEN size / 1048576.0 < 10 THEN printf('%.1f', round(size / 1048576.0, 1)) ELSE printf('%.0f', round(size / 1048576.0)) END || ' MB' WHEN size >= 1024 THEN CASE WHEN size / 1024.0 < 10 THEN printf('%.1f', round(size / 1024.0, 1)) ELSE printf('%.0f', round(size / 1024.0)) END || ' KB' ELSE size || ' B' END AS size FROM assets", "assets")
def m4_format_bytes(c: Corpus) -> DataFrame:
    return c.assets.select("id", N.byte_size(F.col("size")).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 30 BETWEEN 1 AND 20 THEN event_id % 30 ELSE 6 END AS top_k FROM events")
def m6_parse_setting(c: Corpus) -> DataFrame:
    raw = F.when(F.col("event_id") % 30 == 25, "many").otherwise(F.concat(F.lit(" "), (F.col("event_id") % 30).cast("string")))
    return c.table("events").select("event_id", N.setting(raw, "bigint", 1, 20, 6).alias("top_k"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 3 AND a.vec_id <> 3")
def m7_cosine(c: Corpus) -> DataFrame:
    one = c.vectors.filter("asset_id = 3").select(F.col("embedding").alias("query"))
    return c.vectors.filter("asset_id <> 3").crossJoin(F.broadcast(one)).select(F.col("asset_id").alias("vec_id"), F.round(N.cosine(F.col("embedding"), F.col("query")), 6).alias("cosine"))  # one row


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS norm2, 1.0::DOUBLE AS norm FROM embeddings")
def m9_l2_normalize(c: Corpus) -> DataFrame:
    return c.vectors.select(F.col("asset_id").alias("vec_id"), F.round(N.dot(F.col("embedding"), F.col("embedding")), 5).alias("norm2"), F.round(N.norm(N.unit(F.col("embedding"))), 6).alias("norm"))


@query("SELECT label, d AS dim, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY 1, 2")
def g20_vector_mean(c: Corpus) -> DataFrame:
    return c.vectors.select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("SELECT event_type, round(14 + 50 * (sqrt(n) - sqrt(min(n) OVER ())) / (sqrt(max(n) OVER ()) - sqrt(min(n) OVER ())), 4) AS size FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def m11_font_scale(c: Corpus) -> DataFrame:
    counts = c.table("events").groupBy("event_type").agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(ends)).select("event_type", F.round(N.font_size(F.col("n"), F.col("least"), F.col("most")), 4).alias("size"))  # one row


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def n1_metadata_record(c: Corpus) -> DataFrame:
    record = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return c.table("events").select("event_id", F.map_filter(record, lambda k, _: k != "__reserved")["k"].cast("long").alias("k"))


@query("SELECT event_id, event_id % 5 <> 0 AS good FROM events")
def n4_parse_json_or_null(c: Corpus) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{bad"), "props")).otherwise(F.col("props"))
    return c.table("events").select("event_id", F.try_parse_json(raw).isNotNull().alias("good"))


@query("SELECT doc_id, list_distinct(string_split(lang || ',' || source || ',' || lang, ',')).len() AS n FROM documents")
def n8_dedupe_array(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", F.size(F.array_distinct(F.split(F.concat_ws(",", "lang", "source", "lang"), ","))).cast("long").alias("n"))


@query("SELECT doc_id, list_transform(list_sort(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x, i: {'i': i, 'x': x})), lambda s: s.x) AS words FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(substring(text, 1, 80) || ',' || lang || ';' || lang || '  ' || source), '[\\s,;]+'), lambda x: x <> '') AS w FROM documents)")
def x5_stopwords_of_a_field(c: Corpus) -> DataFrame:
    """What a user typed into the field of stopwords, as distinct words in their order."""
    typed = F.concat(F.substring("text", 1, 80), F.lit(","), "lang", F.lit(";"), "lang", F.lit("  "), "source")
    return c.documents.select("doc_id", T.stopword_list(typed).alias("words"))

"""Column functions on text; all stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent Spanish and English words that statistics leave out.
STOPWORDS = tuple(sorted(set("""
a al algo ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era es esa ese
eso esta este esto estos fue ha han hasta hay la las le les lo los mas me mi muy nada ni no nos o os otra otro para pero poco
por porque que se sea ser si sin sobre son su sus también te ti tiene todo todos tu un una uno unos y ya yo
about after all also an and any are as at be been but by can could did do does for from had has have he her him his how i if
in into is it its just more most my not of on one only or other our out over she so some such than that the their them then
there these they this to up very was we were what when which who will with would you your
""".split())))

#: Accented letters and what search folds them to.
ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_fold(x: str | Column) -> Column:
    """A to Z lower-cased and nothing else."""
    return F.translate(_column(x), string.ascii_uppercase, string.ascii_lowercase)


def squeezed(x: str | Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(_column(x), r"\s+", " "))


def one_line(x: str | Column, most: int = 60) -> Column:
    """One line of at most ``most`` characters, and an ellipsis if there was more."""
    line = squeezed(x)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def preview(x: str | Column, most: int = 120) -> Column:
    """One line; a longer one is cut one short, trimmed at the right and ends in an ellipsis."""
    line = squeezed(x)
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


def short_label(x: str | Column, most: int = 12) -> Column:
    return F.when(F.length(_column(x)) > most, F.concat(F.substring(_column(x), 1, most - 1), F.lit("…"))).otherwise(_column(x))


def three_lines(x: str | Column) -> Column:
    """The first three lines that aren't blank, trimmed and joined."""
    return F.array_join(F.slice(F.filter(F.transform(F.split(_column(x), "\n"), lambda v: F.trim(v)), lambda v: v != ""), 1, 3), " ")


def words(x: str | Column, stopwords: tuple[str, ...] = STOPWORDS, least: int = 3) -> Column:
    """Tokens for statistics: letters and digits with inner apostrophes and hyphens, lower-cased; no numbers, no stopwords."""
    found = F.regexp_extract_all(F.lower(_column(x)), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"), F.lit(0))
    trimmed = F.transform(found, lambda w: F.regexp_replace(w, "^['’-]+|['’-]+$", ""))
    return F.filter(trimmed, lambda w: (F.length(w) >= least) & ~w.rlike(r"^[0-9]+([.,][0-9]+)?$") & ~w.isin(*stopwords))


def folded(x: str | Column) -> Column:
    return F.translate(F.lower(_column(x)), *ACCENTS)


def index_terms(x: str | Column) -> Column:
    """Terms of the search index: letters and digits, lower-cased, without accents."""
    return F.regexp_extract_all(folded(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def without_speakers(x: str | Column) -> Column:
    """Lines without the speaker in front: a numbered one, or one to three capitalised names and a colon."""
    numbered = F.regexp_replace(_column(x), r"(?im)^[ ]*(hablante|speaker)[ ]*[0-9]+[ ]*:[ ]*", "")
    return F.regexp_replace(numbered, r"(?m)^[ ]*\p{Lu}[\p{L}\p{M}'’.-]*([ ]\p{Lu}[\p{L}\p{M}'’.-]*){0,2}[ ]*:[ ]*", "")


def search_terms_core(query: str) -> list[str]:
    """Terms of a search box: operators and syntax dropped, separators cut, equal neighbours merged."""
    text = query.translate(str.maketrans("-:,.", "    ", '"()*^'))
    found = [t for t in text.split() if t.upper() not in ("AND", "OR", "NOT", "NEAR")]
    return [t for i, t in enumerate(found) if not i or found[i - 1] != t]


def search_terms_ui(query: str) -> list[str]:
    """Terms as the front end makes them: upper-case operators dropped, syntax deleted inside a token."""
    found = (t.translate(str.maketrans("", "", '()"-*^:,./\\')) for t in query.split() if t not in ("AND", "OR", "NOT", "NEAR"))
    return [t for t in found if t]


def question_terms(question: str) -> list[str]:
    """Words of four letters or more, lower-cased, distinct, the longest first."""
    found = [w.strip(string.punctuation + "¿¡“”‘’«»…").lower() for w in question.split()]
    return sorted(dict.fromkeys(w for w in found if len(w) >= 4), key=len, reverse=True)


def anchor(text: Column, terms: list[str]) -> Column:
    """The place, from 0, of the first of ``terms`` that occurs at all; null if none does."""
    places = [F.when(F.locate(t, F.lower(text)) > 0, F.locate(t, F.lower(text)) - 1) for t in terms]
    return F.coalesce(*places, F.lit(None).cast("int"))


def snippet(text: Column, terms: list[str], most: int) -> Column:
    """A window of ``most`` characters around the first term found, within the text."""
    start = F.least(F.greatest(F.coalesce(anchor(text, terms), F.lit(0)) - most // 2, F.lit(0)), F.length(text) - most)
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, F.greatest(start, F.lit(0)) + 1, F.lit(most)))


def highlighted(text: Column, terms: list[str]) -> Column:
    """Terms in brackets, the longest first, without overlaps, in any case."""
    chosen = sorted(dict.fromkeys(t.lower() for t in terms if t), key=lambda t: (-len(t), t))
    if not chosen:
        return text
    safe = "|".join("".join(f"\\{c}" if c in r"\.[]{}()*+?^$|" else c for c in t) for t in chosen)
    return F.regexp_replace(text, f"(?i)({safe})", "[$1]")


def without_tags(x: str | Column) -> Column:
    """Each tag is a blank; an unclosed one drops what follows it."""
    return F.regexp_replace(_column(x), r"<[^>]*(>|$)", " ")


def fragment_key(x: str | Column) -> Column:
    return F.lower(squeezed(without_tags(x)))


def metadata_key(x: str | Column) -> Column:
    """Lower case, no accents, all but letters and digits a blank."""
    return F.trim(F.regexp_replace(folded(x), "[^a-z0-9]+", " "))


def topic_name(x: str | Column) -> Column:
    return F.upper(F.trim(_column(x)))


def base_name(x: str | Column) -> Column:
    return F.element_at(F.split(_column(x), r"[/\\]"), -1)


def extension(x: str | Column) -> Column:
    return F.lower(F.regexp_extract(base_name(x), r"\.([^.]+)$", 1))


def file_kind(x: str | Column) -> Column:
    """image, pdf or audio by the name's ending; null for others."""
    end = extension(x)
    return F.when(end.isin("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "gif"), "image").when(end == "pdf", "pdf").when(end.isin("mp3", "wav", "m4a", "ogg", "flac", "aac"), "audio")


def version_stem(x: str | Column) -> Column:
    """The file name without its ending and its version."""
    return F.regexp_replace(F.regexp_replace(base_name(x), r"\.[^.]+$", ""), r"_v[0-9]+$", "")


def path_error(x: str | Column) -> Column:
    """Why a path may not be used under the assets folder; null if it may."""
    path = _column(x)
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(path.startswith("\\\\"), "unc")
        .when(path.rlike(r"(^|[/\\])\.{1,2}([/\\]|$)"), "dots")
        .when(~path.startswith("assets/"), "outside")
    )


def whole_sentences(x: str | Column, most: int) -> Column:
    """Cut to ``most`` characters, back to the last end of a sentence if there is one."""
    head = F.substring(_column(x), 1, most)
    done = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1)
    return F.when(F.length(_column(x)) <= most, _column(x)).when(done != "", done).otherwise(head)


def sensitive(key: str | Column) -> Column:
    name = F.lower(_column(key))
    return name.endswith("_api_key") | name.rlike("secret|token|password|credential")


def entity_key(x: str | Column) -> Column:
    """An entity's text without marks at its ends, squeezed and lower-cased."""
    return F.lower(squeezed(F.regexp_replace(_column(x), r"^[\s.,;:!?\"'()\[\]{}<>«»“”‘’*_-]+|[\s.,;:!?\"'()\[\]{}<>«»“”‘’*_-]+$", "")))


def html_paragraphs(x: str | Column) -> Column:
    """Plain text as HTML: paragraphs at blank lines, line breaks at single ones."""
    safe = F.replace(F.replace(F.replace(_column(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.filter(F.split(safe, r"\n[ \t]*\n+"), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(F.trim(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def search_query(x: str | Column) -> Column:
    """What a search box says, as quoted terms: operators and syntax dropped, separators cut, equal neighbours merged."""
    plain = F.translate(F.translate(_column(x), '"()*^', ""), "-:,.", "    ")
    terms = F.filter(F.split(plain, r"\s+"), lambda t: (t != "") & ~F.upper(t).isin("AND", "OR", "NOT", "NEAR"))
    once = F.filter(terms, lambda t, i: (i == 0) | (F.get(terms, i - 1) != t))
    return F.array_join(F.transform(once, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")


def terms_of(x: str | Column, least: int = 4) -> Column:
    """Words of so many letters or more, lower-cased, distinct, the longest first and then as they stand."""
    bare = F.transform(F.split(_column(x), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    words = F.array_distinct(F.filter(bare, lambda w: F.length(w) >= least))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(ranked, lambda s: s["w"])


def said_at(segments: Column, terms: list[str], offset: Column) -> Column:
    """(start, end) of the first of the segments (start, end, text) with a term, else of the one that holds a character offset; null if none."""
    has = lambda s: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(s["text"]), t))
    named = F.get(F.filter(segments, has), F.lit(0))
    none = F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    first = F.struct(F.lit(0).cast("long").alias("total"), F.lit(False).alias("done"), none.alias("at"))

    def step(a: Column, s: Column) -> Column:
        total = a["total"] + F.length(s["text"])
        here = ~a["done"] & (offset < total)
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return F.struct(total.alias("total"), (a["done"] | here).alias("done"), F.when(here, own).otherwise(a["at"]).alias("at"))

    held = F.aggregate(segments, first, step, lambda a: F.when(a["done"], a["at"]))
    return F.coalesce(F.when(named.isNotNull(), F.struct(named["start"].alias("start"), named["end"].alias("end"))), held)


def manual_value(x: str | Column) -> Column:
    """An entity as a user typed it, without quotes, dashes and white space around."""
    marks = "[\"'“”‘’«»\\-–—\\s]+"
    return F.trim(F.regexp_replace(F.trim(_column(x)), f"^{marks}|{marks}$", ""))


def in_version_family(name: Column, base: Column) -> Column:
    """Is a file a picture named ``base``, or a numbered version of it?"""
    stem, ending = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rest = F.substring(stem, F.length(base) + 1, F.length(stem))
    return ending.isin("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif") & stem.startswith(base) & ((rest == "") | rest.rlike(r"^_v[0-9]+$"))


def relative_path(path: Column, folder: str) -> Column:
    """(rel, error): a path under the assets of the application's folder, with slashes."""
    plain, prefix = F.translate(path, "\\", "/"), folder.replace("\\", "/").rstrip("/") + "/"
    rest = F.regexp_replace(F.substring(plain, F.lit(len(prefix) + 1), F.length(plain)), "^/+", "")
    error = F.when(F.trim(path) == "", "empty").when(~plain.startswith(prefix), "outside").when(~rest.startswith("assets/"), "not_under_assets")
    return F.struct(F.when(error.isNull(), rest).alias("rel"), error.alias("error"))


def between_marks(x: str | Column) -> Column:
    """(name, body): what a tool writes between ===NAME_JSON_BEGIN=== and ===NAME_JSON_END===; null without both marks."""
    pattern = r"(?s)===([A-Z_]+?)_JSON_BEGIN===\s*(.*?)\s*===\1_JSON_END==="
    name = F.regexp_extract(_column(x), pattern, 1)
    return F.when(name != "", F.struct(name.alias("name"), F.regexp_extract(_column(x), pattern, 2).alias("body")))


def clock_offset(server_ms: str | Column, local_ms: str | Column, most_ms: int = 300_000) -> Column:
    """(offset_ms, warning): server time less local time; beyond five minutes it is worth a warning."""
    offset = _column(server_ms) - _column(local_ms)
    return F.struct(offset.alias("offset_ms"), (F.abs(offset) > most_ms).alias("warning"))


def merged_metadata(own: Column, source: Column, reserved: str) -> Column:
    """A map of metadata as JSON, with the reserved entry of a source's JSON if that is an object."""
    plain = F.to_json(F.map_filter(own, lambda k, _: k != reserved))
    kept = F.get_json_object(source, f"$.{reserved}")
    entry = F.concat(F.lit(f'"{reserved}":'), kept)
    with_entry = F.when(plain == "{}", F.concat(F.lit("{"), entry, F.lit("}"))).otherwise(F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(","), entry, F.lit("}")))
    return F.when(kept.startswith("{"), with_entry).otherwise(plain)


#: Labels of what a file tells of itself, and the keys of a user that say the same.
TECHNICAL = {
    "Nombre del archivo": ("archivo", "nombre archivo", "file name"),
    "Tipo de archivo": ("tipo", "tipo archivo", "file type", "mime", "mime type"),
    "Extensión": ("extension", "ext"),
    "Asset ID": ("asset id", "archivo id"),
    "Ruta interna": ("ruta interna", "internal path", "path"),
}


def technical_metadata(file_name: Column, kind: Column, asset_id: Column, path: Column, keys: Column) -> Column:
    """Array of (label, value); entries without a value, or whose label or alias is among the user's keys, are left out."""
    taken = F.transform(keys, lambda k: metadata_key(k))
    values = (file_name, F.upper(kind), F.when(extension(file_name) != "", extension(file_name)), asset_id, path)
    entries = []
    for (label, aliases), value in zip(TECHNICAL.items(), values):
        said = F.array(metadata_key(F.lit(label)), *(metadata_key(F.lit(a)) for a in aliases))
        entries.append(F.when(value.isNotNull() & (value != "") & ~F.arrays_overlap(taken, said), F.struct(F.lit(label).alias("label"), value.alias("value"))))
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def stopword_list(x: str | Column) -> Column:
    """Distinct words of a field, lower-cased, cut at white space, commas and semicolons."""
    return F.array_distinct(F.filter(F.split(F.lower(_column(x)), r"[\s,;]+"), lambda w: w != ""))

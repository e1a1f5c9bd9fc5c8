"""Operator 9: secret scans with a trigram inverted index.

A Boolean query over trigrams is derived from the syntax tree of each rule's pattern. Each slice of a partition is
indexed once (trigram to the texts that hold it, for the trigrams that any rule asks for); a rule's query
intersects and unites postings, and only the texts that are left are searched with the pattern. A rule whose
pattern has no mandatory trigram searches every text. The index folds ASCII case, so it may let a text through
but never loses one.

Defined results: a null text counts as empty and has no spans; rows with equal ids are scanned row by row; an empty
table gives an empty table; extra columns stay behind in scans and stay as they are in redaction.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as tree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.llm.common import per_text, text_slices

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three kinds that every scan has, in the order of their listing.
BASE_RULES = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Public formats of keys.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----|(?:\s+[A-Za-z0-9+/=]{16,})*)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("aws_session", r"ASIA[A-Z0-9]{16}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?ai)bearer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("model_key", r"\bsk-(?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgEI[A-Za-z0-9_-]{50,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    # a password may hold any sign: to the last @ before the path, else over slashes (but not past a port) to the first one;
    # in the URL of a database, whose path holds none, to the last one of all
    Rule("login_url", r"(?:https?|ftp)://[^\s/:@]+:(?![0-9]{1,5}/)(?:[^\s/]*@|[^\s@]*@)|(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)://[^\s/:@]*:(?![0-9]{1,5}/)[^\s\"'<>]*@"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple

_MOST_STRINGS, _MOST_CLASS = 64, 6


def both(kind: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
    elif True in parts:
        return True
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def of_strings(strings: set[str]) -> Query:
    """What a text must hold if it holds one of these."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def walk(items) -> tuple[set[str] | None, Query]:
    """The strings that a part of a pattern matches, if they are few, and its query otherwise."""
    strings, queries, whole = {""}, [], True

    def close() -> None:
        nonlocal strings, whole
        queries.append(of_strings(strings))
        strings, whole = {""}, False

    for op, value in items:
        found, query = None, True
        if op is tree.LITERAL:
            found = {chr(value).lower() if value < 128 else chr(value)}
        elif op is tree.IN and all(k is tree.LITERAL for k, _ in value) and len(value) <= _MOST_CLASS:
            found = {chr(x).lower() if x < 128 else chr(x) for _, x in value}
        elif op is tree.SUBPATTERN:
            found, query = walk(value[3])
        elif op is tree.BRANCH:
            parts = [walk(x) for x in value[1]]
            found = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            query = both("or", [q if s is None else of_strings(s) for s, q in parts])
        elif op in (tree.MAX_REPEAT, tree.MIN_REPEAT):
            least, most, part = value
            inner, query = walk(part)
            if inner is not None and most == 1 and least == 0:
                found = inner | {""}
            elif inner is not None and least == most and len(inner) ** least <= _MOST_STRINGS:
                found = {""}
                for _ in range(least):
                    found = {a + b for a in found for b in inner}
            elif least == 0:
                query = True
            elif inner is not None:
                query = of_strings(inner)
        elif op is tree.AT:
            continue
        if found is not None and len(found) * len(strings) <= _MOST_STRINGS:
            strings = {a + b for a in strings for b in found}
        else:
            close()
            queries.append(query if found is None else of_strings(found))
    if whole:
        return strings, True
    close()
    return None, both("and", queries)


def trigram_query(pattern: str) -> Query:
    strings, query = walk(tree.parse(pattern))
    return query if strings is None else of_strings(strings)


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.order = {r.kind: i for i, r in enumerate(rules)}
        asked = set().union(*(trigrams(q) for _, _, q in self.rules))
        self.codes = {t: int.from_bytes(t.encode(), "big") for t in asked if len(t.encode()) == 3}
        self.wanted = np.array(sorted(self.codes.values()), np.int32)

    def postings(self, texts: list[str]) -> dict[int, set[int]]:
        """The texts that hold each wanted trigram."""
        raw = [t.encode("utf-8", "replace").lower() for t in texts]  # of bytes: ASCII letters only
        data = np.frombuffer(b"\xff".join(raw), np.uint8)
        if len(data) < 3 or not len(self.wanted):
            return {}
        codes = data[:-2].astype(np.int32) << 16 | data[1:-1].astype(np.int32) << 8 | data[2:]
        known = np.zeros(1 << 24, bool)
        known[self.wanted] = True
        at = np.flatnonzero(known[codes])
        ends = np.cumsum([len(r) + 1 for r in raw])
        pairs = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        found: dict[int, set[int]] = {}
        for code, text in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
            found.setdefault(code, set()).add(text)
        return found

    def candidates(self, query: Query, index: dict[int, set[int]], n: int) -> set[int] | range:
        if query is True:
            return range(n)
        if isinstance(query, str):
            return index.get(self.codes[query], set()) if query in self.codes else range(n)
        parts = [set(self.candidates(q, index, n)) for q in query[1]]
        return set.intersection(*parts) if query[0] == "and" else set.union(*parts)

    def scan(self, texts: list[str]) -> list[list[Span]]:
        """All spans of each text, by start, then by the order of the rules; offsets are code points."""
        found: list[list[Span]] = [[] for _ in texts]
        index = self.postings(texts)
        for rule, pattern, query in self.rules:
            for i in self.candidates(query, index, len(texts)):
                found[i].extend((rule.kind, *m.span()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least)
        for spans in found:
            spans.sort(key=lambda s: (s[1], self.order[s[0]], s[2]))
        return found


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def scanned(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of each row's whole text."""

    def run(texts: list[str]) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scanner(rules).scan(texts)], kind)]

    of = docs.schema[id_col].dataType.simpleString()
    return per_text(docs, run, f"`{id_col}` {of}, spans array<struct<kind:string,start:long,end:long>>", ["spans"], id_col=id_col, text_col=text_col)


def digest(found: DataFrame) -> DataFrame:
    """The spans of each document as counts and strings."""

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *(number(r.kind) for r in BASE_RULES), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at, reach = [], 0, 0
    for kind, start, end in spans:
        if start >= reach:
            out += [text[at:start], f"[{kind}]"]
        reach = at = max(reach, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with secrets masked; a column of lengths, if there is one, follows the text; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            texts = part.column(at).to_pylist()
            found = scanner(rules).scan(["" if x is None else x for x in texts])
            columns = part.columns
            columns[at] = pa.array([None if x is None else masked(x, s) if s else x for x, s in zip(texts, found)], part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    made = docs.mapInArrow(run, docs.schema)
    if length_col not in docs.columns:
        return made
    return made.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))


def base_digest(spans: list[Span]) -> str:
    """For one text: the digest of its base spans."""
    kinds = {r.kind for r in BASE_RULES}
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in kinds).encode()).hexdigest()

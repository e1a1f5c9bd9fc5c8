"""HTML of notes: a few tags are kept, others unwrapped or dropped, links made absolute and safe, empty elements removed."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lektra.functions.udfs import by_pieces

# Tags that are kept, tags that go with all that is in them, tags that become paragraphs, and schemes of links.
KEPT = frozenset(("a", "blockquote", "br", "code", "em", "h1", "h2", "h3", "i", "li", "ol", "p", "pre", "strong", "u", "ul"))
DROPPED = frozenset(("iframe", "object", "script", "style"))
PARAGRAPHS = frozenset(("article", "div", "section"))
SCHEMES = ("http:", "https:", "mailto:", "tel:")
LINK = 'target="_blank" rel="noopener noreferrer nofollow"'

#: Tags that end an open paragraph, and tags without content, as HTML has it.
_ENDS_P = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_HAS_BLOCK = re.compile(r"<(?:p|h1|h2|h3|ul|ol|blockquote|pre|li)\b", re.I)


def absolute_link(href: str | None) -> str | None:
    """A link as it is kept: an anchor as it is, one without a scheme as https, no other than http, https, mailto and tel."""
    href = (href or "").strip()
    if not href or href.startswith("#"):
        return href or None
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", href):
        href = f"https://{href}"
    scheme, rest = href.split(":", 1)
    scheme, rest = scheme.lower() + ":", re.sub(r"[\t\n\r]", "", rest)
    if scheme not in SCHEMES:
        return None
    if scheme in ("mailto:", "tel:"):
        return scheme + quote(rest, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ ")
    m = re.fullmatch(r"[/\\]*(?:([^/\\?#]*)@)?([^/\\?#@:]*|\[[0-9a-fA-F:.]+\])(?::([0-9]*))?([/\\][^?#]*)?(\?[^#]*)?(#.*)?", rest, re.S)
    if not m or not m[2] or re.search(r"[\x00-\x20#%/:<>?@\\^|]", m[2].strip("[]").replace(":", "")) or (m[3] and int(m[3]) > 65535):
        return None
    try:
        host = m[2].lower() if m[2].isascii() else m[2].encode("idna").decode()
    except UnicodeError:
        return None
    port = "" if not m[3] or int(m[3]) == {"http:": 80, "https:": 443}[scheme] else f":{int(m[3])}"
    path = _without_dots(quote((m[4] or "/").replace("\\", "/"), safe="!$%&'()*+,-./:;=@[\\]_|~^"))
    query, anchor = quote(m[5] or "", safe="!$%&()*+,-./:;=?@[\\]^_`{|}~"), quote(m[6] or "", safe="!#$%&'()*+,-./:;=?@[\\]^_{|}~")
    return f"{scheme}//{m[1] + '@' if m[1] else ''}{host}{port}{path}{query}{anchor}"


def _without_dots(path: str) -> str:
    parts: list[str] = []
    steps = path.split("/")[1:]
    for i, part in enumerate(steps):
        if part == "..":
            parts = parts[:-1]
        elif part != ".":
            parts.append(part)
        if part in (".", "..") and i == len(steps) - 1:
            parts.append("")
    return "/" + "/".join(parts)


class _Notes(HTMLParser):
    """Builds the kept elements as nested lists [tag, opening, parts]; an element is judged when it ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = [["", "", []]]
        self.dropping: str | None = None

    def handle_starttag(self, tag, attrs):
        if self.dropping:
            return
        if tag in DROPPED:
            self.dropping = tag
            return
        if tag in _ENDS_P:
            self.end_open("p", within=())
        if tag == "li":
            self.end_open("li", within=("ul", "ol"))
        if tag == "br":
            self.open[-1][2].append("<br>")
        elif tag not in _VOID:
            name = "p" if tag in PARAGRAPHS else tag
            opening = f"<{name}>" if name in KEPT else ""
            if name == "a":
                link = absolute_link(next((v for k, v in attrs if k == "href"), None))
                opening = f'<a href="{_attribute(link)}" {LINK}>' if link else ""
            self.open.append([tag, opening, []])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing

    def end_open(self, tag: str, within: tuple[str, ...]) -> None:
        """End the innermost open element of a kind, and what is open in it, unless one of ``within`` stands between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.end_at(i)
                return
            if self.open[i][0] in within:
                return

    def end_at(self, i: int) -> None:
        while len(self.open) > i:
            _, opening, parts = self.open.pop()
            if not opening:
                self.open[-1][2].extend(parts)
            elif any(p.startswith("<") for p in parts) or "".join(parts).replace("&nbsp;", "").strip():
                name = re.match(r"<(\w+)", opening)[1]
                self.open[-1][2].append(f"{opening}{''.join(parts)}</{name}>")

    def handle_endtag(self, tag):
        if self.dropping:
            if tag == self.dropping:
                self.dropping = None
        elif tag == "br":
            self.open[-1][2].append("<br>")
        else:
            self.end_open(tag, within=())

    def handle_data(self, data):
        if not self.dropping and data:
            self.open[-1][2].append(html.escape(data, quote=False).replace("\xa0", "&nbsp;"))


def _attribute(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


def sanitized(text: str) -> str:
    """Kept HTML; where no block is in it, in a paragraph."""
    parser = _Notes()
    parser.feed(text)
    parser.close()
    parser.end_at(1)
    made = "".join(parser.open[0][2]).strip()
    return made if not made or _HAS_BLOCK.search(made) else f"<p>{made}</p>"


@F.arrow_udf(StringType())
def sanitized_html(texts: pa.Array) -> pa.Array:
    """Null stays null."""
    return by_pieces(texts, sanitized)

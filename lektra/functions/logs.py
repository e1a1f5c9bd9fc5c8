"""Masking credentials in log lines; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lektra.functions.text import _column

#: What tells that a line carries a credential.
MARKERS = ("api_key", "apikey", "authorization", "bearer", "token", "password", "secret")
#: What stands for a credential, and for what was cut off.
MASK, CUT = "[redactado]", "… [truncado]"
#: Characters from which a part of such a line may be a credential by itself.
LONG = 32


def redacted(line: str | Column) -> Column:
    """A line with a marker without its credentials; other lines stay as they are.

    A part of the line (between white space) is masked if it holds a marker, follows a marker without a value of its own,
    or is a long run of token characters with a letter.
    """
    text = _column(line)
    marks = "(?i)" + "|".join(MARKERS)
    parts = F.filter(F.split(text, r"\s+"), lambda p: p != "")

    def armed(part: Column) -> Column:
        return part.rlike(marks) & ~part.rlike(r"^[^:=]*[:=].*[^\"' ]")

    def shown(part: Column, i: Column) -> Column:
        core = F.regexp_replace(part, r"^[\"',;=:]+|[\"',;=:]+$", "")
        random = core.rlike(rf"^[A-Za-z0-9_+/.=-]{{{LONG},}}$") & core.rlike("[A-Za-z]")
        after = (i > 0) & F.coalesce(armed(F.get(parts, i - 1)), F.lit(False))
        return F.when(part.rlike(marks) | after | random, MASK).otherwise(part)

    return F.when(text.rlike(marks), F.array_join(F.transform(parts, shown), " ")).otherwise(text)


def log_field(value: str | Column, most: int) -> Column:
    """A field of a log: at most so many characters, control characters blank, credentials masked."""
    text = _column(value)
    clean = F.regexp_replace(F.substring(text, 1, most), r"[\p{Cc}&&[^\n\t]]", " ")
    return redacted(F.when(F.length(text) > most, F.concat(clean, F.lit(CUT))).otherwise(clean))

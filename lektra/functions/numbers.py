"""Column functions on numbers, times and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(x: Column) -> Column:
    """Seconds since 1970 become milliseconds; what already is milliseconds stays."""
    return F.when((x > 0) & (x < 1_000_000_000_000), x * 1000).otherwise(x)


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    whole = F.floor(seconds)
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(minutes), two(rest))).otherwise(F.concat_ws(":", minutes.cast("string"), two(rest)))


def age(ms: Column, now_ms: Column) -> Column:
    """Days, hours or minutes that have gone by."""
    minutes = F.floor((now_ms - ms) / 60_000)
    return F.when(minutes >= 1440, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d"))).when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).when(minutes >= 1, F.concat(minutes.cast("string"), F.lit("m"))).otherwise("now")


def severity(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.isin("critical", "error", "danger"), "danger").when(low.isin("warning", "warn"), "warning").otherwise("info")


def byte_size(x: Column) -> Column:
    """In units of 1024, with one digit below ten and none from ten on."""
    out = F.concat(F.floor(x).cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = x / float(1024**power)
        digits = F.when(value < 10, F.format_string("%.1f", F.round(value, 1))).otherwise(F.format_string("%.0f", F.round(value, 0)))
        out = F.when(x >= 1024**power, F.concat(digits, F.lit(f" {unit}"))).otherwise(out)
    return out


def setting(raw: Column, kind: str, least: float, most: float, default: float) -> Column:
    """A number from a text, or the default if there is none or it is out of range."""
    value = F.trim(raw).try_cast(kind)
    return F.when(value.between(least, most), value).otherwise(F.lit(default).cast(kind))


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if lengths differ, or a vector is empty or zero."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size)


def unit(a: Column) -> Column:
    """Divided by its norm; null for a zero or an infinite one."""
    size = norm(a)
    return F.when((size > 0) & (size < float("inf")), F.transform(_doubles(a), lambda x: x / size))


def font_size(count: Column, least: Column, most: Column, small: float = 14.0, large: float = 64.0) -> Column:
    """Between two sizes by the square root of a count."""
    return F.when(most == least, F.lit((small + large) / 2)).otherwise(small + (large - small) * (F.sqrt(count) - F.sqrt(least)) / (F.sqrt(most) - F.sqrt(least)))


def mono(samples: str | Column, channels: int) -> Column:
    """Interleaved samples as the mean of their channels; samples that make no whole frame are left out."""
    x = F.col(samples) if isinstance(samples, str) else samples
    frames = F.floor(F.size(x) / channels).cast("int")
    means = F.transform(F.sequence(F.lit(0), frames - 1), lambda i: sum((F.get(x, i * channels + k).cast("double") for k in range(channels)), F.lit(0.0)) / channels)
    return F.when(frames > 0, means).otherwise(F.array().cast("array<double>"))


def resampled(samples: str | Column, from_rate: int, to_rate: int) -> Column:
    """Samples at another rate, linearly interpolated."""
    x = F.transform(F.col(samples) if isinstance(samples, str) else samples, lambda v: v.cast("double"))
    step = from_rate / to_rate
    n = F.ceil(F.size(x) / step).cast("int")

    def at(i: Column) -> Column:
        place = i * F.lit(step)
        low = F.floor(place).cast("int")
        part = place - low
        return F.when(low + 1 < F.size(x), F.get(x, low) * (1 - part) + F.get(x, low + 1) * part).otherwise(F.get(x, low))

    return F.when(n > 0, F.filter(F.transform(F.sequence(F.lit(0), n - 1), at), lambda v: v.isNotNull())).otherwise(x)


def ticks(most: Column, count: int = 4) -> Column:
    """Values from 0 on to the first that reaches ``most``, in steps of 1, 2 or 5 times a power of ten, of about ``count``; only 0 for none or less."""
    raw = most.cast("double") / count
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    residual = raw / magnitude
    step = F.when(residual <= 1, 1).when(residual <= 2, 2).when(residual <= 5, 5).otherwise(10) * magnitude
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(most / step).cast("long")), lambda i: F.round(i * step, 3))
    return F.when(most > 0, values).otherwise(F.array(F.lit(0.0)))


def relative_time(created: Column, now_ms: Column) -> Column:
    """(value long, unit): how far a time in seconds or milliseconds is from now, in the largest unit that it fills, cut to whole ones."""
    ms = F.when(created < 1_000_000_000_000, created * 1000).otherwise(created)
    seconds = F.floor((ms - now_ms) / 1000 + 0.5)  # a half goes up, also below zero
    units = (("second", 1, 60), ("minute", 60, 3600), ("hour", 3600, 86_400), ("day", 86_400, 2_592_000), ("month", 2_592_000, 31_536_000))
    whole = lambda size: F.struct((F.signum(seconds.cast("double")) * F.floor(F.abs(seconds) / size)).cast("long").alias("value"))
    chosen = F.struct(whole(31_536_000)["value"].alias("value"), F.lit("year").alias("unit"))
    for unit, size, below in reversed(units):
        chosen = F.when(F.abs(seconds) < below, F.struct(whole(size)["value"].alias("value"), F.lit(unit).alias("unit"))).otherwise(chosen)
    return chosen

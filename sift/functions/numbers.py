"""Counters, durations, addresses and other scalars as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def safe_number(value: Column, text: bool = False) -> Column:
    """A finite number >= 0 as DOUBLE, else NULL. Of texts, commas are dropped and blank (not empty) ones are 0."""
    if text:
        bare = F.replace(value, F.lit(","), F.lit(""))
        number = F.when(value == "", None).when(bare.rlike(r"^\s*$"), 0.0).when(bare.rlike(_NUMBER), F.trim(bare).try_cast("double"))
    else:
        number = value.cast("double")
    return F.when((number >= 0) & (number < float("inf")), number)


def interaction(value: Column) -> Column:
    """safe_number with literal zeros, which stand for "not told", as NULL."""
    return F.nullif(safe_number(value), F.lit(0.0))


def valid_stat(value: Column) -> Column:
    """NULL unless finite, else at least 0."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.greatest(F.lit(0.0), v))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def parse_duration(value: Column) -> Column:
    """Seconds of "h:m:s", "m:s" or "s"; empty parts are 0; NULL for empty or non-numeric texts."""
    parts = F.split(F.trim(value), ":")
    good = F.forall(parts, lambda p: p.rlike(_NUMBER) | p.rlike(r"^\s*$"))
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + F.coalesce(F.trim(p).try_cast("double"), F.lit(0.0)))
    return F.when((F.trim(value) != "") & good, total)


def round_duration(value: Column) -> Column:
    """Whole seconds, at least 0, of a number."""
    return F.greatest(F.lit(0.0), F.floor(value.cast("double") + 0.5).cast("double"))


def duration_label(given: Column, seconds: Column) -> Column:
    """The given text if it isn't blank, else h:mm:ss or m:ss of whole seconds, '' if unknown."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    made = F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))
    return F.when(F.trim(given) != "", F.trim(given)).when(s.isNull(), "").otherwise(made)


def _online(number: Column, unit: Column) -> Column:
    return number.try_cast("double") * F.when(unit == "亿", 1e8).when(unit == "万", 1e4).otherwise(1.0)


def strict_online(value: Column) -> tuple[Column, Column]:
    """(count, approximate) of a whole text like "1.7万+"; the count NULL and approximate false for others."""
    bare = F.replace(F.trim(value), F.lit(","), F.lit(""))
    form = r"^(\d+(?:\.\d+)?)\s*([万亿]?)\s*(\+)?$"
    part = lambda i: F.regexp_extract(bare, form, i)
    hit = bare.rlike(form)
    rounded = F.floor(_online(part(1), part(2)) + 0.5).cast("double")
    return F.when(hit, rounded), F.coalesce(hit & ((part(2) != "") | (part(3) != "")), F.lit(False))


def lenient_online(value: Column) -> Column:
    """The first number with its unit anywhere in a text, not rounded; NULL if none."""
    bare = F.regexp_replace(F.trim(value), "[,，+]", "")
    form = r"([\d.]+)\s*(万|亿)?"
    number = F.regexp_extract(bare, form, 1)
    return F.when(number.rlike(r"^(\d+\.?\d*|\.\d+)$"), _online(number, F.regexp_extract(bare, form, 2)))


def https_url(value: Column) -> Column:
    """An https address; // and http:// are read as https://; '' for anything else."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    url = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(
        raw.startswith("http://"), F.concat(F.lit("https://"), F.substring(raw, F.lit(8), F.length(raw))),
    ).otherwise(raw)
    return F.when(url.rlike(r"^https://[^/?#\s]+\S*$"), url).otherwise("")


def sigmoid_log(value: Column, anchor: float, steepness: float = 1.15) -> Column:
    """1 / (1 + exp(-k ln((x + 1) / (anchor + 1)))): one half at the anchor; NULL for NULL or negative x."""
    ratio = F.log((value + 1.0) / (anchor + 1.0))
    return F.when(value >= 0, clamp(1.0 / (1.0 + F.exp(-steepness * ratio))))


def weighted_average(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the non-NULL values by weight; NULL if none."""
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.try_divide(top, weight)


def format_count(value: Column) -> Column:
    """Short form with 亿 from 1e8 and 万 from 1e4, one decimal below ten times the unit, else thousands separated."""
    v = value.cast("double")
    half = lambda x, d: F.format_string(f"%.{d}f", F.floor(x * 10**d + 0.5) / float(10**d))
    whole = F.regexp_replace(F.regexp_replace(F.format_number(v, 3), r"0+$", ""), r"\.$", "")
    return (
        F.when(v.isNull() | F.isnan(v), "—").when(v >= 1e9, F.concat(half(v / 1e8, 0), F.lit("亿"))).when(v >= 1e8, F.concat(half(v / 1e8, 1), F.lit("亿")))
        .when(v >= 1e5, F.concat(half(v / 1e4, 0), F.lit("万"))).when(v >= 1e4, F.concat(half(v / 1e4, 1), F.lit("万"))).otherwise(whole)
    )


def format_date(ms: Column) -> Column:
    """yyyy/MM/dd in UTC of epoch milliseconds."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(ms / 86_400_000).cast("int"))
    return F.when(ms > 0, F.date_format(day, "yyyy/MM/dd")).otherwise("日期未知")


def format_score(value: Column) -> Column:
    """Percent of a score in 0..1, rounded half up."""
    return F.coalesce(F.floor(clamp(value) * 100 + 0.5).cast("int").cast("string"), F.lit("—"))


def strip_tab_count(value: Column) -> Column:
    """A tab's label without the count at its end."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\s*\d+\+?\s*$", ""))


def page_context(url: Column) -> tuple[Column, Column]:
    """(path, trimmed keyword) of a search page's address; other parameters don't matter."""
    return F.try_parse_url(url, F.lit("PATH")), F.trim(F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("keyword"))), F.lit("")))

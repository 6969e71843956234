"""Video keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sift.functions.text import half_width, strip_invisible

#: Fixed value: the form of a proper key.
PROPER_KEY = r"^BV[0-9A-Za-z]{8,24}\z"
_ANY = r"^(?:(?:(?:https?:)?//)?[^/\s]+/video/)?[Bb][Vv]([0-9A-Za-z]{8,24})(?:[/?#].*)?$"


def proper_key(value: Column) -> Column:
    """The key in its proper form, from one written with blanks, full-width or invisible characters, a prefix in other
    letter case, or as the address of its page; NULL if it names no video. Case after the prefix is kept."""
    clean = F.trim(F.regexp_replace(strip_invisible(half_width(value)), r"(?U)^\s+|\s+$", ""))
    tail = F.regexp_extract(clean, _ANY, 1)
    return F.when(F.length(tail) > 0, F.concat(F.lit("BV"), tail))

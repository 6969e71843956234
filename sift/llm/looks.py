"""One form for texts that look the same.

The canonical form maps white space to plain spaces, removes default-ignorable characters, maps letters that look alike
to one of them, applies compatibility decomposition and composes again; full case folding on demand (letter case is a
difference in looks).  Which letters look alike is taken from Unicode's confusables as the session's own ICU library
has them, for all letters and digits of all scripts.  Python sees each distinct value of a batch once, and only values
outside a set of characters that the form doesn't change.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.functions.keys import proper_key
from sift.functions.text import INVISIBLE, per_value, says_something
from sift.session import cut

# Hyphens that look alike, and letters of common fonts that Unicode's list has otherwise or not at all.
ALSO_ALIKE = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "κ": "k", "ӏ": "l", "Ԛ": "Q"}
_SPACE = re.compile(r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+")
_IGNORED = re.compile(INVISIBLE.replace("x{1", "U0001").replace("x{E", "U000E").replace("}", ""))
#: Texts of these characters without double or outer spaces are their own form, but for letters that look alike.
PLAIN = "^(?! )(?:(?!  )[\\x20-\\x7E\\u4E00-\\u9FFF\\u3041-\\u3096\\u30A1-\\u30FA\\u30FC\\u3002\\u3010\\u3011])*(?<! )$"
_PLAIN = re.compile(PLAIN)


def alike_table(skeleton) -> dict[int, str]:
    """Letter -> the letter it is mapped to, from a function that gives the skeletons of a text of lines.

    Letters, digits and Han radicals of one skeleton look alike. They are mapped to the ASCII one if there is one; where there are
    several (1, I and l) they are told apart by being a digit, a capital or neither, as ASCII ones are never mapped to
    each other; without an ASCII one, to the first, of the usual ones if possible. Characters that decompose into several are left to that."""
    letter = lambda c: unicodedata.category(c)[0] in "LN" or "\u2e80" <= c <= "\u2fdf"
    letters = [c for c in map(chr, range(0x30, 0x32000)) if letter(c) and len(unicodedata.normalize("NFKD", c)) == 1]
    classes: dict[str, list[str]] = {}
    for c, s in zip(letters, skeleton("\n".join(letters)).split("\n"), strict=True):
        classes.setdefault(s, []).append(c)
    sort = lambda c: {"Lu": 0, "Nd": 1}.get(unicodedata.category(c), 2)
    table = {}
    for members in classes.values():
        plain = [c for c in members if c.isascii()]
        first = min(members, key=lambda c: (not _PLAIN.match(c), c))
        for c in members:
            usual = unicodedata.normalize("NFKC", c)
            to = usual if usual in plain else min(plain, key=lambda p: (sort(p) != sort(c), not p.isalpha(), p), default=first)
            if c != to and not c.isascii():
                table[ord(c)] = to
    return table | {ord(c): to for c, to in ALSO_ALIKE.items()}


@lru_cache(maxsize=1)
def _table_of(application: str) -> dict[int, str]:
    checker = SparkSession.getActiveSession()._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return alike_table(checker.getSkeleton)


def look_alikes() -> dict[int, str]:
    """alike_table by the ICU library of the active session."""
    return _table_of(SparkSession.getActiveSession().sparkContext.applicationId)


def canonical(text: str, alike: dict[int, str], fold_case: bool = False) -> str:
    """The one form of a text; texts look the same iff their forms (without folding) are equal."""
    text = _IGNORED.sub("", text)
    folded = None
    while fold_case and text != folded:  # capitals become small letters of their own script before they are mapped to another
        folded = text
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()).translate(alike)
    text = unicodedata.normalize("NFKD", text.translate(alike))
    text = unicodedata.normalize("NFC", text.translate(alike)).translate(alike)
    return _SPACE.sub(" ", _IGNORED.sub("", text)).strip()


def one_form(value: Column, fold_case: bool = False) -> Column:
    """Canonical form of a text column; NULL stays NULL, blank becomes ''. Python only sees values that may change in
    more than single letters."""
    alike = look_alikes()
    single = {c: canonical(c, alike) for c in map(chr, range(0x3041, 0xA000)) if _PLAIN.match(c)}
    single = {c: to for c, to in single.items() if c != to}

    @F.pandas_udf(T.StringType())
    def form(texts: pd.Series) -> pd.Series:
        return per_value(texts, lambda t: canonical(t, alike, fold_case))

    mapped = F.translate(value, "".join(single), "".join(single.values()))
    other = F.when(~value.rlike(PLAIN), value)
    return F.coalesce(form(other), F.lower(mapped) if fold_case else mapped)


def _spellings(texts: DataFrame) -> DataFrame:
    """(field, spelling, looks): the digests of texts that say something and of which another spelling exists."""
    distinct = texts.select("field", "text").where(F.col("text").isNotNull()).distinct().where(says_something(F.col("text")))
    forms = cut(distinct.select("field", _digest("text").alias("spelling"), _digest(one_form(F.col("text"))).alias("looks")))
    several = forms.groupBy("field", "looks").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return cut(forms.join(several, ["field", "looks"]))


def _digest(text: str | Column) -> Column:
    return F.unhex(F.md5(text))


def _spelled(texts: DataFrame, spellings: DataFrame, kind: str) -> DataFrame:
    """(field, record_id, spelling) of the records of those spellings, each once; kind "inner" adds looks."""
    records = texts.where(F.col("text").isNotNull()).select("field", "record_id", _digest("text").alias("spelling"))
    return records.join(spellings if kind == "inner" else spellings.drop("looks"), ["field", "spelling"], kind).distinct()


def same_looks(texts: DataFrame) -> DataFrame:
    """(field, record_id, other_id): pairs record_id < other_id whose texts of a field look the same and differ.

    texts: (field, record_id, text), read twice; repeated rows count once, texts that are NULL or say nothing are left
    out. The form is found once per distinct text; only texts of which another spelling exists meet their records
    again, and pairs are made between different spellings only, so equal copies are never paired with each other.
    Records are joined through the pairs of spellings; hot spellings are split by adaptive skew joins."""
    spellings = _spellings(texts)
    a, b = spellings.alias("a"), spellings.alias("b")
    on = (F.col("a.field") == F.col("b.field")) & (F.col("a.looks") == F.col("b.looks")) & (F.col("a.spelling") != F.col("b.spelling"))
    pairs = a.join(b, on).select(F.col("a.field").alias("field"), F.col("a.spelling").alias("s1"), F.col("b.spelling").alias("s2"))
    records = cut(_spelled(texts, spellings, "left_semi"))
    one = records.select("field", F.col("record_id").alias("record_id"), F.col("spelling").alias("s1"))
    two = records.select("field", F.col("record_id").alias("other_id"), F.col("spelling").alias("s2"))
    return pairs.join(one, ["field", "s1"]).join(two, ["field", "s2"]).where("record_id < other_id").select("field", "record_id", "other_id")


def look_classes(texts: DataFrame) -> DataFrame:
    """(field, record_id, class_id, spellings, records, links): one row per record whose text has another spelling.

    class_id: the least record_id of those that look the same; spellings and records of the class; links: records of
    the class that are spelled otherwise than this one. The result grows with the records, not with their pairs. A
    record with several texts of a field in one class counts once for each spelling. texts as for same_looks."""
    records = cut(_spelled(texts, _spellings(texts), "inner"))
    same = records.groupBy("field", "looks", "spelling").agg(F.count(F.lit(1)).alias("_same"), F.min("record_id").alias("_first"))
    classes = same.groupBy("field", "looks").agg(F.min("_first").alias("class_id"), F.count(F.lit(1)).alias("spellings"), F.sum("_same").alias("records"))
    counted = same.drop("_first").join(classes, ["field", "looks"]).drop("looks")
    found = records.drop("looks").join(counted, ["field", "spelling"])
    return found.select("field", "record_id", "class_id", "spellings", "records", (F.col("records") - F.col("_same")).alias("links"))


def tag_forms(catalog: DataFrame) -> DataFrame:
    """(tag_id, tag, looks) of the known tags."""
    return catalog.where(F.col("tag").isNotNull()).select("tag_id", "tag", one_form(F.col("tag")).alias("looks"))


def known_tags(tags: DataFrame, catalog: DataFrame) -> DataFrame:
    """tags (tag, ...) joined to the known tags they look like: plus tag_id and known (the catalog's spelling).

    The form is found once per distinct spelling. The join isn't forced to broadcast the catalog."""
    spellings = tags.select("tag").where(F.col("tag").isNotNull()).distinct().select("tag", one_form(F.col("tag")).alias("looks"))
    found = spellings.join(tag_forms(catalog).withColumnRenamed("tag", "known"), "looks").drop("looks")
    return tags.join(found, "tag")


def video_texts(videos: DataFrame) -> DataFrame:
    """(field, record_id, text) of titles and descriptions."""
    pair = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "description")))).alias("t")
    return videos.where(F.col("record_id").isNotNull()).select("record_id", pair).select("t.field", "record_id", "t.text")


def video_tags(videos: DataFrame) -> DataFrame:
    """(record_id, video, tag): distinct tags of each record; video is the proper key or NULL."""
    return videos.where(F.col("record_id").isNotNull()).select("record_id", proper_key(F.col("bvid")).alias("video"), F.explode("tags").alias("tag"))

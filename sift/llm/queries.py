"""Queries of the llm operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions.keys import proper_key
from sift.functions.text import NOTHING, says_something
from sift.llm.cooccur import co_occurrence
from sift.llm.encode import edited, encode_corpus, prefix_tables
from sift.llm.looks import known_tags, look_classes, one_form, same_looks, tag_forms, video_tags, video_texts
from sift.llm.mix import mix_sources
from sift.llm.split import split_documents
from sift.llm.survivor import Bundle, Dependency, chosen_records, dependency_support, surviving_records
from sift.plans.sql import half
from sift.session import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tag_pairs(spark: SparkSession, d: str, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, names): videos are baskets of the tags of any of their records. names (item, tag_id, tag): known tags are
    items by tag_id, others by a negative number of their form, which is written once."""
    videos = _table(spark, d, "videos").where(F.col("record_id").isNotNull()).select(
        proper_key(F.col("bvid")).alias("basket"), F.explode_outer(F.array_distinct("tags")).alias("tag"),
    )
    rows = cut(videos.where(F.col("basket").isNotNull()).distinct())
    forms = rows.select("tag").where(F.col("tag").isNotNull()).distinct().select("tag", one_form(F.col("tag")).alias("looks")).where(F.col("looks") != "")
    forms = cut(forms)
    known = tag_forms(_table(spark, d, "tag_catalog")).groupBy("looks").agg(F.min(F.struct("tag_id", "tag")).alias("k"))
    names = forms.select("looks").distinct().join(known, "looks", "left")
    names = cut(names.select("looks", F.coalesce("k.tag_id", -1 - F.monotonically_increasing_id()).alias("item"), F.col("k.tag_id").alias("tag_id"), F.coalesce("k.tag", "looks").alias("tag")))
    items = forms.join(names.select("looks", "item"), "looks").select("tag", "item")
    baskets = rows.join(items, "tag").select("basket", "item")
    return co_occurrence(baskets, rows.select("basket").distinct().count(), min_count), names


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _tag_pairs(spark, d, 8)[0].where((F.col("item_a") > 0) & (F.col("n_ab") * F.col("n_baskets") >= 4 * F.col("n_a") * F.col("n_b")))
    return pairs.select(F.col("item_a").alias("tag_id_a"), F.col("item_b").alias("tag_id_b"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs, names = _tag_pairs(spark, d, 1)
    for c in ("a", "b"):
        pairs = pairs.join(names.select(F.col("item").alias(f"item_{c}"), F.col("tag_id").alias(f"tag_id_{c}"), F.col("tag").alias(f"tag_{c}")), f"item_{c}")
    # the two tags of a pair in order of their spelling, whatever the numbers of unknown ones are
    first = [F.when(F.col("tag_a") <= F.col("tag_b"), F.col(f"{n}_a")).otherwise(F.col(f"{n}_b")).alias(f"{n}_a") for n in ("tag", "tag_id", "n")]
    last = [F.when(F.col("tag_a") <= F.col("tag_b"), F.col(f"{n}_b")).otherwise(F.col(f"{n}_a")).alias(f"{n}_b") for n in ("tag", "tag_id", "n")]
    return pairs.select(*first, *last, "n_ab", "n_baskets", "ratio", "expected", "log10_p", "q")


def _video_records(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    """(videos with their key, trust level, time of the values)."""
    videos = _table(spark, d, "videos").withColumn("video", proper_key(F.col("bvid")))
    detail = F.col("enrichment.detail")
    level = F.when(detail == "complete", 3).when(detail == "partial", 2).when(detail == "unavailable", 1).otherwise(0)
    return videos, level, F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', fetched_at)")


def _video_bundles(level: Column) -> tuple[list[Bundle], list[Dependency]]:
    """Title, description, views and likes are each decided as TESTDATA.md has it, so they are bundles of their own and
    come first; the reading's other counters go with the views they were read with, and the running time with the
    publication (both hold throughout the data, see p4_dependencies)."""
    rest = ["favorites", "coins", "shares", "replies", "danmaku"]

    def number(name: str) -> Bundle:
        v = F.col(f"stats.{name}")
        return Bundle(name, {name: v}, F.coalesce((v > 0) & ~F.isnan(v) | (v == 0) & (level >= 2), F.lit(False)))

    def text(name: str, tier: int = 0) -> Bundle:
        return Bundle(name, {name: F.col(name)}, says_something(F.col(name)), tier)

    some = F.coalesce(*(F.when(F.col(f"stats.{m}") >= 0, F.lit(True)) for m in rest), F.lit(False))
    bundles = [
        text("title"), text("description"), number("views"), number("likes"),
        Bundle("counters", {m: F.col(f"stats.{m}") for m in rest}, some, 1),
        Bundle("author", {"name": F.col("author.name"), "mid": F.col("author.mid")}, F.col("author.mid").isNotNull(), 1),
        Bundle("publication", {"publishedAt": F.col("publishedAt"), "category": F.col("category")}, F.coalesce(F.col("publishedAt") > 0, F.lit(False)), 1),
        Bundle("enrichment", {c: F.col(f"enrichment.{c}") for c in ("detail", "detailSource", "pageCount")}, F.col("enrichment.detail").isNotNull(), 1),
        text("durationText", 1), Bundle("tags", {"tags": F.col("tags")}, F.coalesce(F.size("tags") > 0, F.lit(False)), 1),
    ]
    return bundles, [Dependency("views", "counters"), Dependency("publication", "durationText")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Read from the search that decides the four fields with the counters that depend on the views."""
    videos, level, time = _video_records(spark, d)
    bundles, deps = _video_bundles(level)
    best = chosen_records(videos, "video", "record_id", level, time, bundles[:5], deps[:1]).where("first_record <> last_record")
    rows = F.explode(F.array(*(F.struct(F.lit(b.name).alias("field"), F.col(f"{b.name}.record").alias("record_id")) for b in bundles[:4])))
    return best.select(F.col("video").alias("bvid"), rows.alias("r")).select("bvid", "r.*").where(F.col("record_id").isNotNull())


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    videos, level, time = _video_records(spark, d)
    return surviving_records(videos, "video", "record_id", level, time, *_video_bundles(level))


def p4_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """How far the dependencies between bundles, and two that are not used, hold in the data."""
    c = {n: F.col(n) for n in ("title", "description", "publishedAt", "durationText")}
    reading = F.struct(*(F.col(f"stats.{m}") for m in ("favorites", "coins", "shares", "replies", "danmaku")))
    videos = _video_records(spark, d)[0].dropDuplicates(["record_id"])
    return dependency_support(videos, "video", {
        "author.mid -> author.name": (F.col("author.mid"), F.col("author.name")), "publishedAt -> durationText": (c["publishedAt"], c["durationText"]),
        "views -> counters": (F.when(F.col("stats.views") > 0, F.col("stats.views")), reading), "title -> description": (c["title"], c["description"]),
    })


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    videos = _table(spark, d, "videos")
    tags = known_tags(video_tags(videos).select("record_id", "tag").where(F.col("tag").isNotNull()), _table(spark, d, "tag_catalog"))
    tags = tags.where(F.col("tag") != F.col("known")).select(F.lit("tags").alias("field"), "record_id", F.col("tag_id").alias("other_id")).distinct()
    return same_looks(video_texts(videos)).unionByName(tags)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_classes(video_texts(_table(spark, d, "videos")))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every record's title, description and tags in their one form, and folded for comparing."""
    videos = _table(spark, d, "videos")
    texts = videos.select(
        "record_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "description")))).alias("t"),
    ).select("record_id", "t.*")
    texts = texts.unionByName(videos.select("record_id", F.lit("tags").alias("field"), F.explode("tags").alias("text")))
    forms = texts.select("text").where(F.col("text").isNotNull()).distinct().select("text", one_form(F.col("text")).alias("form"), one_form(F.col("text"), True).alias("folded"))
    return texts.join(forms, "text", "left")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_table(spark, d, "documents"))


def p6_appended(spark: SparkSession, d: str) -> DataFrame:
    """Each document's encoding after its address was appended to the stored one."""
    docs = _table(spark, d, "documents")
    end = F.lit(None).cast("int")
    edits = docs.select("doc_id", F.concat(F.lit("\n\n"), "url").alias("new"), end.alias("start"), end.alias("end"))
    return edited(prefix_tables(docs).join(edits, "doc_id")).select("doc_id", "ids")


def p6_edited(spark: SparkSession, d: str) -> DataFrame:
    """Each document's encoding after a word in its middle was replaced in the stored one."""
    docs = _table(spark, d, "documents")
    half_way = F.floor(F.length("text") / 2).cast("int")
    edits = docs.select("doc_id", half_way.alias("start"), (half_way + 5).alias("end"), F.lit(" edited ").alias("new"))
    return edited(prefix_tables(docs).join(edits, "doc_id")).select("doc_id", "ids")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mix_sources(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))
    return report.where("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def _limits(spark: SparkSession, d: str) -> tuple[int, int]:
    row = _table(spark, d, "split_limits").orderBy("limit_name").first()
    return row["max_tokens"], row["overlap_tokens"]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_documents(_table(spark, d, "documents"), *_limits(spark, d), with_text=False)
    return pieces.where("n_pieces > 1 and piece_no = 1").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(_table(spark, d, "documents"), *_limits(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_pairs, p4_found, p4_survivors, p4_dependencies, p5_found, p5_classes, p5_forms,
        p6_ids, p6_appended, p6_edited, p7_found, p7_report, p7_mix, p8_found, p8_pieces,
    )
}

_BLANK = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_UNSEEN = "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}]"


def _sql_says(x: str) -> str:
    bare = f"lower(regexp_replace(regexp_replace({half(x)}, '{_UNSEEN}', '', 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'))"
    return f"coalesce({bare} <> '' AND {bare} NOT IN ({', '.join(repr(n) for n in NOTHING)}), false)"


def _sql_number(x: str) -> str:
    return f"coalesce(({x} > 0 AND NOT isnan({x})) OR ({x} = 0 AND level >= 2), false)"


_FIELDS = {"title": _sql_says("title"), "description": _sql_says("description"), "views": _sql_number("stats.views"), "likes": _sql_number("stats.likes")}

ORACLES = {
    "p4_found": f"""
WITH k AS (SELECT *, regexp_extract(regexp_replace(regexp_replace({half("bvid")}, '{_UNSEEN}', '', 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), '^(?:(?:(?:https?:)?//)?[^/\\s]+/video/)?[Bb][Vv]([0-9A-Za-z]{{8,24}})(?:[/?#].*)?$', 1) AS tail,
  CASE enrichment.detail WHEN 'complete' THEN 3 WHEN 'partial' THEN 2 WHEN 'unavailable' THEN 1 ELSE 0 END AS level FROM videos WHERE record_id IS NOT NULL AND bvid IS NOT NULL),
v AS (SELECT *, 'BV' || tail AS video FROM k WHERE tail <> ''),
several AS (SELECT video FROM v GROUP BY video HAVING count(DISTINCT record_id) > 1),
c AS ({" UNION ALL ".join(f"SELECT video, '{f}' AS field, level, fetched_at, record_id FROM v WHERE {says}" for f, says in _FIELDS.items())})
SELECT video AS bvid, field, first(record_id ORDER BY level DESC, fetched_at DESC, record_id DESC) AS record_id FROM c SEMI JOIN several USING (video) GROUP BY video, field""",
}

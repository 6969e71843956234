"""Queries of the search engine's operators over the test tables, with their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.config import HISTORY, MIXIN_ORDER, RESULTS_PER_PAGE, ROUTES
from sift.functions.keys import PROPER_KEY, proper_key
from sift.functions.numbers import duration_label, format_count, format_date, format_score, lenient_online, page_context, round_duration, safe_number, strip_tab_count
from sift.functions.text import compact_text, ngram_containment, normalize_text, ordered_terms, strip_html, substring_similarity, trim_all
from sift.functions.time import timestamp_ms
from sift.operators import history as H
from sift.operators import ingest as I
from sift.operators import ranking as K
from sift.operators import signals as D
from sift.operators.present import cards as result_cards
from sift.operators.readings import snapshot_readings
from sift.operators.relevance import evaluate, exact_term, matchable
from sift.plans import sql as S
from sift.plans.search import SearchResult, search, search_cards, search_many
from sift.query import Term, parse
from sift.session import cut, ensure_checkpoint_dir, remove
from sift.sources import requests as R
from sift.streaming.history import sample_stream

NOW_MS = 1_788_782_400_000  # 2026-09-07 12:00 UTC
QUERY = "网球 教程"
EXACT = {"cjk": "网球", "digits": "12", "letters": "kitchen", "mixed": "x10", "short": "4k"}
FUZZY_NEEDLE = "keybord"
SYNTAX = {"mixed": 'kitchn "4k" -server 网球训练比赛', "misspelt": "keybord", "run": "网球训练比赛", "model": 'the camera x10 pro 2017 -"机器人"'}
INTENTS = {"最新 网球": 30, "2026 网球": 90, "2017 澳网": 730, "网球": 180}
BATCH = {"a": QUERY, "b": "kitchen 4k", "c": '"机器人" -雪山'}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return I.enrich(I.merge_items(I.normalize_cards(_t(spark, d, "search_cards"))), I.normalize_details(_t(spark, d, "video_details")))


def _online(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_online(I.normalize_online(_t(spark, d, "online_samples")))


def _search(spark: SparkSession, d: str, query: str = QUERY) -> SearchResult:
    return search_cards(_t(spark, d, "search_cards"), query, NOW_MS, _t(spark, d, "video_details"), _t(spark, d, "snapshots"), _t(spark, d, "online_samples"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the quality view."""
    return result_cards(K.page_of(_search(spark, d).ranked, "quality", 1))


# ---- cleaning ---------------------------------------------------------------------------------------------------


def card_texts(spark, d):
    n = normalize_text(F.col("title"))
    return _t(spark, d, "search_cards").select("card_id", strip_html(F.col("title")).alias("clean"), n.alias("normalized"), compact_text(n).alias("compact"))


def card_items(spark, d):
    rows = I.normalize_cards(_t(spark, d, "search_cards"))
    return rows.select(
        F.col("seq.c").alias("card_id"), "key", "title", "description", F.array_join("tags", "|").alias("tags"), "category", "url", "coverUrl",
        "durationSeconds", "durationText", "publishedAt", F.col("author.name").alias("author"), F.col("author.mid").alias("mid"), "stats.views",
        "stats.likes", "stats.favorites", "stats.replies", "stats.danmaku", F.col("source.orderLabel").alias("order_label"), "source.page",
        "source.position",
    )


def detail_items(spark, d):
    rows = I.normalize_details(_t(spark, d, "video_details"))
    return rows.select(
        "key", "title", "description", "coverUrl", "durationSeconds", "durationText", "publishedAt", F.col("author.name").alias("author"),
        *(f"stats.{m}" for m in I.STATS), F.size("pages").cast("long").alias("n_pages"), "pageCount", "partial",
    )


def online_counts(spark, d):
    raw = _t(spark, d, "online_samples")
    return I.normalize_online(raw).join(raw.select("sample_id", lenient_online(F.col("total")).alias("lenient")), "sample_id").select(
        "sample_id", "total", "web", "total_approximate", "web_approximate", "total_visible", "web_visible", "lenient",
    )


def video_keys(spark, d):
    raw = trim_all(F.coalesce("bvid", F.lit("")))
    return _t(spark, d, "videos").select("record_id", raw.rlike(PROPER_KEY).alias("strict"), proper_key(F.col("bvid")).alias("key"))


def snapshot_times(spark, d):
    return _t(spark, d, "snapshots").select("snapshot_id", timestamp_ms(F.col("capturedAt")).alias("at"))


def duration_labels(spark, d):
    s = round_duration(safe_number(F.col("duration")))
    return _t(spark, d, "video_details").select("bvid", s.alias("seconds"), duration_label(F.lit(None).cast("string"), s).alias("label"))


def payload_kinds(spark, d):
    code = F.when(F.col("status") == 200, 0).when(F.col("status") == 503, -412).otherwise(-F.col("status"))
    docs = _t(spark, d, "documents").select("doc_id", "status", code.alias("code"), F.col("charset").isNull().alias("voucher"))
    return docs.select("doc_id", R.payload_kind(F.col("code"), F.col("voucher")).alias("kind"), R.structural_failure(F.col("status"), F.col("code")).alias("structural"))


def signed_requests(spark, d):
    cards = _t(spark, d, "search_cards")
    key = R.mixing_key(F.concat(F.lit("https://img.example/k/"), F.md5("bvid"), F.lit(".png")), F.concat(F.lit("https://img.example/k/"), F.md5("route"), F.lit(".png")))
    params = {"keyword": F.col("author"), "order": F.col("route"), "page": F.col("page"), "tid": F.nullif("position", F.lit(1))}
    return cards.select("card_id", R.signed_query(params, key, F.lit(1_788_782_400)).alias("signed"), R.plain_query(params).alias("plain"))


def tab_labels(spark, d):
    """Labels like those of a page's tabs, made of card titles and counts, and the context of page addresses."""
    cards = _t(spark, d, "search_cards")
    made = F.concat(F.trim(F.coalesce("typename", F.lit(""))), F.lit(" "), F.when(F.col("play") > 99, F.lit("99+")).otherwise(F.coalesce(F.col("play").cast("string"), F.lit(""))))
    path, word = page_context(F.concat(F.lit("https://video.example/search/"), "route", F.lit("?page="), F.col("page").cast("string"), F.lit("&keyword="), F.url_encode(F.col("author")), F.lit("&order=click")))
    return cards.select("card_id", strip_tab_count(made).alias("label"), path.alias("path"), word.alias("keyword"))


# ---- matching ---------------------------------------------------------------------------------------------------


def _titles(spark, d):
    n = normalize_text(F.col("title"))
    return _t(spark, d, "search_cards").select("card_id", n.alias("n")).withColumn("c", compact_text(F.col("n")))


def exact_terms(spark, d):
    return _titles(spark, d).select("card_id", *(exact_term(Term(t, t), F.col("n"), F.col("c")).alias(k) for k, t in EXACT.items()))


def fuzzy_similarity(spark, d):
    s = substring_similarity(FUZZY_NEEDLE, F.col("c"))
    return _titles(spark, d).select("card_id", F.when(s >= 0.74, F.round(s, 6)).otherwise(0.0).alias("similarity"))


def ngram_affinity(spark, d):
    return _titles(spark, d).select("card_id", F.round(ngram_containment("网球决赛", F.col("c")), 6).alias("affinity"), ordered_terms(["网球", "回放"], F.col("c")).alias("ordered"))


# ---- merging ----------------------------------------------------------------------------------------------------


def merged_items(spark, d):
    rows = I.merge_items(I.normalize_cards(_t(spark, d, "search_cards")))
    return rows.select(
        "key", "records", "title", "description", F.array_join("tags", "|").alias("tags"), "category", "coverUrl", "durationText",
        F.col("author.name").alias("author"), F.col("author.mid").alias("mid"), "durationSeconds", "publishedAt", "aid",
        *(f"stats.{m}" for m in ("views", "likes", "favorites", "replies", "danmaku")), F.size("sources").cast("long").alias("n_sources"),
    )


def pool_stats(spark, d):
    return I.pool_counters(_t(spark, d, "search_cards"))


def _by(items: DataFrame) -> dict:
    s = lambda m: F.coalesce(F.col(f"stats.{m}"), F.lit(0.0))
    return dict(zip(ROUTES, (s("views") + s("likes"), F.col("stats.views"), F.col("publishedAt"), F.col("stats.favorites"), F.col("stats.danmaku"))))


def recalled_routes(spark, d):
    items = I.merge_items(I.normalize_cards(_t(spark, d, "search_cards")))
    return I.recall_routes(items, _by(items))


def enriched_items(spark, d):
    rows = _items(spark, d)
    return rows.select(
        "key", "title", "description", F.col("author.name").alias("author"), "publishedAt", *(f"stats.{m}" for m in I.STATS),
        F.col("enrichment.detail").alias("detail"),
    )


def first_details(spark, d):
    """Details of the first 60 keys by arrival: the batched lookup of an interactive search."""
    keys = I.first_keys(_t(spark, d, "search_cards").select(F.trim("bvid").alias("key"), F.col("card_id").alias("seq")), 60)
    details = I.normalize_details(_t(spark, d, "video_details"))
    return keys.join(details.select("key", "title", F.col("stats.views").alias("views")), "key", "left").select("key", "seq", "title", "views")


def fallback_details(spark, d):
    raw = _t(spark, d, "video_details")
    gone = F.pmod("aid", F.lit(7)) == 0
    both = I.with_fallback(I.normalize_details(raw.where(~gone)), I.normalize_details(raw, "stat-fallback"))
    return both.select("key", "source", "partial", F.col("stats.views").alias("views"))


def chosen_parts(spark, d):
    part = I.select_part(F.col("pages"), 2)
    return I.normalize_details(_t(spark, d, "video_details")).select("key", part.alias("p")).select(
        "key", "p.cid", "p.page", "p.selection", F.col("p.multiPart").alias("multi_part"),
    )


def page_scans(spark, d):
    return I.scan_pages(_t(spark, d, "search_cards"))


def detail_lookups(spark, d):
    return I.lookup_counts(_t(spark, d, "search_cards").select(F.trim("bvid").alias("key")), I.normalize_details(_t(spark, d, "video_details")))


def tolerant_recall(spark, d):
    """Cards of the routes that can be read; a route whose table has no such column ends by itself."""
    cards = _t(spark, d, "search_cards")
    routes = {r: lambda r=r: cards.where(F.col("route") == r).select("card_id", "route") for r in ROUTES[:3]}
    found, errors = I.tolerant_union(routes | {"gone": lambda: cards.select("no_such_column")})
    return found.withColumn("failed", F.lit(",".join(name for name, _ in errors)))


def replaced_items(spark, d):
    """Merged items, those of an even number of records replaced by their enriched rows."""
    items = I.merge_items(I.normalize_cards(_t(spark, d, "search_cards")))
    some = I.enrich(items.where(F.col("records") % 2 == 0), I.normalize_details(_t(spark, d, "video_details")))
    return I.replace_enriched(items, some).select("key", "title", "stats.views", "stats.coins", F.col("enrichment.detail").alias("detail"))


# ---- scoring ----------------------------------------------------------------------------------------------------


def relevance(spark, d):
    rows = evaluate(matchable(_items(spark, d)), QUERY)
    r = "relevance."
    return rows.select(
        "key", F.round(r + "value", 6).alias("value"), F.round(r + "coverage", 6).alias("coverage"),
        F.round(r + "title_coverage", 6).alias("title_coverage"), F.round(r + "phrase.score", 6).alias("phrase"), F.col(r + "passes").alias("passes"),
        F.size(r + "rejection_reasons").cast("long").alias("n_reasons"),
    )


def relevance_syntax(spark, d):
    """Queries with model numbers, quoted phrases, exclusions, unspaced runs, misspellings and stop words."""
    items, out = matchable(_items(spark, d)), None
    for name, query in SYNTAX.items():
        rows = evaluate(items, query)
        told = rows.select(
            F.lit(name).alias("query_id"), "key", F.round("relevance.value", 6).alias("value"), F.round("relevance.coverage", 6).alias("coverage"),
            "relevance.passes", F.array_join("relevance.rejection_reasons", "|").alias("reasons"),
        )
        out = told if out is None else out.unionByName(told)
    return out


def quality_scores(spark, d):
    q = D.quality(_items(spark, d))
    return q.select("key", *(F.round(f"quality.{c}", 6).alias(c) for c in ("value", "raw", "completeness", "absolute", "rate")))


def growth_scores(spark, d):
    g = D.growth(_items(spark, d), NOW_MS, _t(spark, d, "snapshots"))
    return g.select("key", *(F.round(f"growth.{c}", 6).alias(c) for c in ("value", "completeness", "confidence", "observation_hours")), F.col("growth.status").alias("status"))


def timeliness_scores(spark, d):
    t = D.timeliness(_items(spark, d), QUERY, NOW_MS, _online(spark, d))
    return t.select("key", *(F.round(f"timeliness.{c}", 6).alias(c) for c in ("value", "online_count", "completeness")))


def growth_components(spark, d):
    g = D.growth(_items(spark, d), NOW_MS, _t(spark, d, "snapshots"))
    parts = [F.round(f"growth.components.{m}.{c}", 6).alias(f"{m}_{c}") for m in ("views", "likes", "coins") for c in ("per_day", "actual_per_day", "lifecycle", "observed", "value")]
    return g.select("key", *parts, F.array_join("growth.negative_reasons", "|").alias("negative"))


def timeliness_intents(spark, d):
    """Every half-life a query can ask for."""
    items, online, out = _items(spark, d), _online(spark, d), None
    for text in INTENTS:
        t = D.timeliness(items, text, NOW_MS, online)
        told = t.select(
            F.lit(text).alias("query"), "key",
            *(F.round(f"timeliness.{c}", 6).alias(c.split(".")[-1]) for c in ("value", "components.recency", "components.online")),
            F.col("timeliness.half_life_days").alias("days"),
        )
        out = told if out is None else out.unionByName(told)
    return out


# ---- ranking ----------------------------------------------------------------------------------------------------


def rank_all_views(spark, d):
    rows = _search(spark, d).ranked
    return rows.select(
        "view", F.col("position").cast("long").alias("position"), "key", F.col("rank.relevance_band").alias("band"),
        F.round("rank.band_position", 6).alias("band_position"), F.round("rank.inner_score", 6).alias("inner_score"),
        F.round("rank.signal", 6).alias("signal"),
    )


def ranking_stats(spark, d):
    return _search(spark, d).stats


def rejected_items(spark, d):
    return _search(spark, d).rejected.select("key", F.round("relevance.value", 6).alias("value"))


def shortlist(spark, d):
    return K.balanced_shortlist(_search(spark, d).ranked).select("key", F.col("turn").cast("long").alias("turn"))


def online_shortlist(spark, d):
    return K.online_shortlist(_search(spark, d).ranked).select("key", F.col("position").cast("long").alias("position"))


def page_two(spark, d):
    return K.page_of(_search(spark, d).ranked, "growth", 2).select("key", F.col("position").cast("long").alias("position"))


def shortlisted_search(spark, d):
    """Details only for the balanced shortlist, as an interactive search does it."""
    r = search_cards(_t(spark, d, "search_cards"), QUERY, NOW_MS, _t(spark, d, "video_details"), _t(spark, d, "snapshots"), _t(spark, d, "online_samples"), detail_limit=60)
    return r.ranked.select("view", "position", "key", F.col("enrichment.detail").alias("detail"))


def search_batch(spark, d):
    many = search_many(_items(spark, d), BATCH, NOW_MS, _t(spark, d, "snapshots"), _online(spark, d))
    return many.select("query_id", "view", "position", "key")


def result_page(spark, d):
    return flagship(spark, d)


def display_texts(spark, d):
    rows = I.normalize_details(_t(spark, d, "video_details"))
    share = F.try_divide(F.col("stats.likes"), F.col("stats.views"))
    return rows.select("key", format_count(F.col("stats.views")).alias("views_text"), format_date(F.col("publishedAt")).alias("date_text"), format_score(share).alias("share_text"))


# ---- history ----------------------------------------------------------------------------------------------------


def _timed(spark, d):
    return snapshot_readings(_t(spark, d, "snapshots")).select("source", "at", "reading")


def sampled_history(spark, d):
    return H.sample_history(_timed(spark, d), last=False).select("source", "at")


def kept_history(spark, d):
    return H.retain(H.sample_history(_timed(spark, d)), NOW_MS).select("source", "at")


def snapshots_of_items(spark, d):
    kept = H.sample_history(_timed(spark, d))
    found = H.snapshots_for(kept, _t(spark, d, "video_details").select(F.col("bvid").alias("key")), NOW_MS)
    return found.select("source", F.size("snapshots").cast("long").alias("n"))


def _shared_folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{os.urandom(6).hex()}"


def streamed_history(spark, d):
    """The streaming twin over the snapshots as they come, to a file sink in the shared folder.

    Readings land in four slices of time, then one of them once more, late; after each the stream is started again from
    its state and runs until it has read everything."""
    base = _shared_folder(spark)
    landed, out = f"{base}/in", f"{base}/out"
    timed = _timed(spark, d).where("at is not null")
    timed.write.parquet(f"{base}/all")
    every = spark.read.parquet(f"{base}/all")
    edges = every.approxQuantile("at", [0.25, 0.5, 0.75], 0.01) if not every.isEmpty() else []
    low = F.col("at") < edges[0] if edges else F.lit(True)
    slices = [low, *((F.col("at") >= a) & (F.col("at") < b) for a, b in zip(edges, edges[1:])), *([F.col("at") >= edges[-1]] if edges else []), low]
    for part in slices:
        every.where(part).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(timed.schema).parquet(landed)
        run = sample_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    kept = cut(spark.read.schema("source string, at long, reading long").parquet(out).select("source", "at"))
    remove(spark, base)
    return kept


def recorded_history(spark, d):
    """Three rounds of recording the enriched items into a durable store: the second comes too early and keeps nothing."""
    base = _shared_folder(spark)
    store, items = H.HistoryStore(spark, base, H.HistoryPolicy(keep_items=10_000_000)), cut(_items(spark, d))
    for minutes in (0, 20, 40):
        store.record(items, NOW_MS + minutes * 60_000)
    kept = cut(store.read().select("source", "at", "stats.views", "stats.likes"))
    remove(spark, base)
    return kept


QUERIES = {
    f.__name__: f
    for f in (
        card_texts, card_items, detail_items, online_counts, video_keys, snapshot_times, duration_labels, payload_kinds, signed_requests, tab_labels, exact_terms, fuzzy_similarity, ngram_affinity, merged_items, pool_stats,
        recalled_routes, enriched_items, first_details, fallback_details, chosen_parts, relevance, relevance_syntax, quality_scores, growth_scores, timeliness_scores, rank_all_views, ranking_stats, rejected_items, shortlist,
        online_shortlist, page_two, shortlisted_search, search_batch, result_page, display_texts, sampled_history, kept_history, snapshots_of_items, streamed_history, recorded_history,
        page_scans, detail_lookups, tolerant_recall, replaced_items, growth_components, timeliness_intents,
    )
}

_N = S.norm("title")
_MIX = f"array_to_string([substr(md5(bvid) || md5(route), x + 1, 1) for x in {list(MIXIN_ORDER[:32])}], '')"
_SCORED = f"WITH {S.ENRICHED}, {S.quality()}, {S.growth(NOW_MS)}, {S.timeliness(NOW_MS, 180)}"
_RANKED = f"{_SCORED}, {S.relevance_of(parse(QUERY))}, {S.ranked()}"
_WALK = f"""
WITH RECURSIVE one AS (
  SELECT snapshot_id, any_value(bvid) AS bvid, min(epoch_us(received_at) // 1000) AS received, any_value(CASE WHEN "capturedAt" > 0 THEN CASE WHEN "capturedAt" < 10000000000 THEN "capturedAt" * 1000 ELSE "capturedAt" END END) AS "at"
  FROM snapshots GROUP BY snapshot_id),
e AS (SELECT DISTINCT bvid AS source, "at" FROM one WHERE "at" <= received AND bvid IS NOT NULL),
k AS (SELECT source, min("at") AS "at" FROM e GROUP BY source UNION ALL SELECT * FROM (SELECT e.source, min(e."at") AS "at" FROM k JOIN e ON e.source = k.source AND e."at" >= k."at" + {HISTORY.min_interval_ms} GROUP BY e.source, k."at")),
kept AS (SELECT source, "at" FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "at" DESC) AS n FROM k) WHERE n <= {HISTORY.keep_snapshots}),
young AS (SELECT * FROM kept WHERE "at" >= {NOW_MS - HISTORY.max_age_ms})
"""


def _exact(key: str) -> str:
    t = EXACT[key]
    n, c = "n", "c"
    return {
        "cjk": f"contains({c}, '{t}')", "digits": f"regexp_matches({n}, '(^|[^0-9]){t}([^0-9]|$)')", "letters": f"regexp_matches({n}, '(^|[^a-z]){t}([^a-z]|$)')",
        "mixed": f"regexp_matches({n}, '(^|[^a-z])x[\\s._-]*1[\\s._-]*0([^a-z0-9]|$)') OR regexp_matches({c}, '(^|[^a-z])x10([^a-z0-9]|$)')",
        "short": f"regexp_matches({n}, '(^|[^a-z0-9])4[\\s._-]*k([^a-z0-9]|$)') OR regexp_matches({c}, '(^|[^a-z0-9])4k([^a-z0-9]|$)')",
    }[key]


_TITLES = f"WITH t AS (SELECT card_id, {_N} AS n, {S.compact(_N)} AS c FROM search_cards)"
_WINDOWS = " , ".join(f"list_max(list_transform(range(1, length(h) + 1), lambda i: 1 - levenshtein('{FUZZY_NEEDLE}', substr(h, i, {w})) / greatest(7, length(substr(h, i, {w})))::DOUBLE))" for w in (6, 7, 8))
_URL = "replace(replace(url_encode({}), '%7E', '~'), '+', '%20')"

ORACLES = {
    "card_texts": f"SELECT card_id, {S.strip('title')} AS clean, {_N} AS normalized, {S.compact(_N)} AS compact FROM search_cards",
    "card_items": (
        f"WITH {S.CARDS} SELECT c AS card_id, key, title, description, array_to_string(list_filter(tags, lambda t, k: list_position(tags, t) = k), "
        f"'|') AS tags, category, 'https://video.example/video/' || key AS url, \"coverUrl\", \"durationSeconds\", \"durationText\", \"publishedAt\", author, "
        f"mid, views, likes, favorites, replies, danmaku, order_label, page, position FROM cards"
    ),
    "detail_items": f"""
WITH d AS (SELECT *, list_filter(coalesce(pages, []), lambda p: p.cid IS NOT NULL) AS good FROM video_details WHERE trim(coalesce(bvid, '')) <> '')
SELECT trim(bvid) AS key, {S.strip("title")} AS title, {S.strip('"desc"')} AS description, {S.url("pic")} AS "coverUrl", duration::DOUBLE AS "durationSeconds", {S.label("duration")} AS "durationText", pubdate * 1000 AS "publishedAt",
  {S.strip("owner.name")} AS author, {", ".join(f'stat."{v}"::DOUBLE AS {k}' for k, v in S._STAT.items())}, len(good)::BIGINT AS n_pages, coalesce(videos::DOUBLE, CASE WHEN len(good) > 0 THEN len(good)::DOUBLE END) AS "pageCount", false AS partial FROM d""",
    "online_counts": f"""
WITH s AS (SELECT *, coalesce(show_switch.total, true) AS tv, coalesce(show_switch."count", true) AS wv, replace(trim(total), ',', '') AS tb, replace(trim("count"), ',', '') AS wb FROM online_samples)
SELECT sample_id, CASE WHEN tv THEN {S.strict_online("total")} END AS total, CASE WHEN wv THEN {S.strict_online('"count"')} END AS web,
  tv AND coalesce(regexp_matches(tb, '^\\d+(\\.\\d+)?\\s*([万亿]\\s*\\+?|\\+)$'), false) AS total_approximate, wv AND coalesce(regexp_matches(wb, '^\\d+(\\.\\d+)?\\s*([万亿]\\s*\\+?|\\+)$'), false) AS web_approximate,
  tv AS total_visible, wv AS web_visible,
  CASE WHEN regexp_matches(total, '[\\d.]') THEN try_cast(regexp_extract(regexp_replace(total, '[,，+]', '', 'g'), '([\\d.]+)\\s*(万|亿)?', 1) AS DOUBLE) * CASE regexp_extract(regexp_replace(total, '[,，+]', '', 'g'), '([\\d.]+)\\s*(万|亿)?', 2) WHEN '亿' THEN 100000000.0 WHEN '万' THEN 10000.0 ELSE 1.0 END END AS lenient FROM s""",
    "video_keys": f"""
WITH v AS (SELECT record_id, coalesce(bvid, '') AS raw, trim(regexp_replace({S.half("coalesce(bvid, '')")}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{206F}}\\x{{FEFF}}]', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS b FROM videos),
w AS (SELECT *, regexp_extract(b, '^(?:(?:(?:https?:)?//)?[^/\\s]+/video/)?[Bb][Vv]([0-9A-Za-z]{{8,24}})(?:[/?#].*)?$', 1) AS tail FROM v)
SELECT record_id, regexp_matches(regexp_replace(raw, '^[\\s\\x{{3000}}\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{3000}}\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g'), '^BV[0-9A-Za-z]{{8,24}}$') AS strict, CASE WHEN tail <> '' THEN 'BV' || tail END AS key FROM w""",
    "snapshot_times": 'SELECT snapshot_id, CASE WHEN "capturedAt" > 0 THEN CASE WHEN "capturedAt" < 10000000000 THEN "capturedAt" * 1000 ELSE "capturedAt" END END AS "at" FROM snapshots',
    "duration_labels": f"SELECT bvid, greatest(0.0, duration::DOUBLE) AS seconds, {S.label('duration')} AS label FROM video_details",
    "payload_kinds": (
        "SELECT doc_id, CASE WHEN status = 503 OR (status = 200 AND charset IS NULL) THEN 'risk' WHEN status = 200 THEN 'ok' ELSE 'api' END AS kind, "
        "coalesce(status IN (404, 405), false) AS structural FROM documents"
    ),
    "signed_requests": f"""
WITH c AS (SELECT *, concat_ws('&', 'keyword=' || {_URL.format("regexp_replace(author, '[!''()*]', '', 'g')")}, 'order=' || route, 'page=' || page::VARCHAR, 'tid=' || nullif(position, 1)::VARCHAR, 'wts=1788782400') AS q, {_MIX} AS k FROM search_cards)
SELECT card_id, q || '&w_rid=' || md5(q || k) AS signed, concat_ws('&', 'keyword=' || replace(url_encode(author), '%20', '+'), 'order=' || route, 'page=' || page::VARCHAR, 'tid=' || nullif(position, 1)::VARCHAR) AS plain FROM c""",
    "tab_labels": """
WITH c AS (SELECT *, trim(coalesce(typename, '')) || ' ' || CASE WHEN play > 99 THEN '99+' ELSE coalesce(play::VARCHAR, '') END AS made, route IS NOT NULL AND page IS NOT NULL AND author IS NOT NULL AS whole FROM search_cards)
SELECT card_id, trim(regexp_replace(trim(made), '\\s*[0-9]+\\+?\\s*$', '')) AS label, CASE WHEN whole THEN '/search/' || route END AS path, CASE WHEN whole THEN trim(author) ELSE '' END AS keyword FROM c""",
    "exact_terms": _TITLES + " SELECT card_id, " + ", ".join(f"({_exact(k)}) AS {k}" for k in EXACT) + " FROM t",
    "fuzzy_similarity": (
        f"{_TITLES}, u AS (SELECT card_id, c, regexp_replace(c, '[^\\x00-\\x7F]', '~', 'g') AS h FROM t), s AS (SELECT card_id, CASE WHEN contains(c, "
        f"'{FUZZY_NEEDLE}') THEN 1.0 WHEN length(h) BETWEEN 1 AND 2000 THEN greatest({_WINDOWS}) ELSE 0.0 END AS s FROM u) SELECT card_id, CASE "
        f"WHEN s >= 0.74 THEN round(s, 6) ELSE 0.0 END::DOUBLE AS similarity FROM s"
    ),
    "ngram_affinity": _TITLES + " SELECT card_id, CASE WHEN contains(c, '网球决赛') THEN 1.0 ELSE round(((contains(c, '网球'))::INT + (contains(c, '球决'))::INT + (contains(c, '决赛'))::INT) / 3.0::DOUBLE, 6) END::DOUBLE AS affinity, regexp_matches(c, '网球.*回放') AS ordered FROM t",
    "merged_items": (
        f"WITH {S.MERGED} SELECT key, records, title, description, array_to_string(tags, '|') AS tags, category, \"coverUrl\", \"durationText\", author, mid, "
        f"\"durationSeconds\", \"publishedAt\", aid, views, likes, favorites, replies, danmaku, n_sources FROM merged"
    ),
    "pool_stats": (
        "SELECT count(*) AS raw_count, count(*) FILTER (ok) AS valid_count, count(DISTINCT CASE WHEN ok THEN trim(bvid) END) AS unique_count, "
        "count(*) FILTER (NOT ok) AS ignored_count, count(*) FILTER (ok) - count(DISTINCT CASE WHEN ok THEN trim(bvid) END) AS duplicate_count FROM (SELECT *, "
        "type = 'video' AND coalesce(bvid, '') <> '' AS ok FROM search_cards)"
    ),
    "recalled_routes": f"WITH {S.MERGED}, r AS ("
    + " UNION ALL ".join(
        f"SELECT key, '{o}' AS \"order\", '{lab}' AS \"orderLabel\", row_number() OVER (ORDER BY {by} DESC NULLS LAST, key) AS n FROM merged"
        for (o, lab), by in zip(
            {"totalrank": "综合", "click": "播放", "pubdate": "最新", "stow": "收藏", "dm": "弹幕"}.items(),
            ("coalesce(views, 0) + coalesce(likes, 0)", "views", '"publishedAt"', "favorites", "danmaku"),
        )
    )
    + ') SELECT key, "order", "orderLabel", ((n - 1) // 50 + 1)::INT AS page, ((n - 1) % 50 + 1)::INT AS position FROM r WHERE n <= 150',
    "enriched_items": f'WITH {S.ENRICHED} SELECT key, title, description, author, "publishedAt", {", ".join(S.STATS)}, detail FROM items',
    "first_details": f"WITH k AS (SELECT trim(bvid) AS key, min(card_id) AS seq FROM search_cards WHERE regexp_matches(trim(bvid), '^BV[0-9A-Za-z]{{8,24}}$') GROUP BY 1 ORDER BY seq, key LIMIT 60) SELECT key, seq, {S.strip('title')} AS title, stat.\"view\"::DOUBLE AS views FROM k LEFT JOIN (SELECT bvid, title, stat FROM video_details) ON bvid = key".replace(
        S.strip("title"), f"CASE WHEN bvid IS NOT NULL THEN {S.strip('title')} END",
    ),
    "fallback_details": (
        "SELECT trim(bvid) AS key, CASE WHEN aid % 7 = 0 OR aid IS NULL THEN 'stat-fallback' ELSE 'detail' END AS source, (aid % 7 = 0 "
        "OR aid IS NULL) AS partial, stat.\"view\"::DOUBLE AS views FROM video_details"
    ),
    "chosen_parts": """
WITH d AS (SELECT trim(bvid) AS key, list_filter(list_transform(coalesce(pages, []), lambda p, i: {'cid': p.cid, 'page': coalesce(p.page, i)::INT}), lambda p: p.cid IS NOT NULL) AS good FROM video_details),
e AS (SELECT key, good, list_filter(good, lambda p: p.page = 2)[1] AS asked FROM d)
SELECT key, coalesce(asked, good[1]).cid AS cid, coalesce(asked, good[1]).page AS page, CASE WHEN len(good) > 0 THEN CASE WHEN asked IS NOT NULL THEN 'requested-page' ELSE 'first-page-fallback' END END AS selection, len(good) > 1 AS multi_part FROM e""",
    "relevance": (
        f"{_RANKED} SELECT key, round(relevance, 6) AS value, round(coverage, 6) AS coverage, round(title_coverage, 6) AS title_coverage, round(phrase, "
        f"6) AS phrase, passes, (CASE WHEN reasons = '' THEN 0 ELSE len(string_split(reasons, '|')) END)::BIGINT AS n_reasons FROM judged"
    ),
    "relevance_syntax": " UNION ALL ".join(f"SELECT * FROM (WITH {S.ENRICHED}, {S.relevance_of(parse(q), 'items')} SELECT '{name}' AS query_id, key, round(relevance, 6) AS value, round(coverage, 6) AS coverage, passes, reasons FROM judged)" for name, q in SYNTAX.items()),
    "search_batch": " UNION ALL ".join(f"SELECT * FROM ({_SCORED}, {S.relevance_of(parse(q))}, {S.ranked()} SELECT '{name}' AS query_id, view, position, key FROM ranked)" for name, q in BATCH.items()),
    "page_scans": """
WITH p AS (SELECT coalesce(route, 'unknown') AS route, coalesce(page, 1) AS page, count(*) AS raw_count, count(*) FILTER (NOT coalesce(type = 'video' AND coalesce(bvid, '') <> '', false)) AS ignored_count FROM search_cards GROUP BY 1, 2),
n AS (SELECT *, (sum(raw_count) OVER (PARTITION BY route))::BIGINT AS num_results FROM p)
SELECT *, ceil(num_results / 50.0)::BIGINT AS num_pages, page < ceil(num_results / 50.0) AS has_next FROM n""",
    "detail_lookups": """
WITH k AS (SELECT DISTINCT trim(bvid) AS key FROM search_cards WHERE bvid IS NOT NULL), g AS (SELECT key, regexp_matches(key, '^BV[0-9A-Za-z]{8,24}$') AS good, key IN (SELECT trim(bvid) FROM video_details WHERE bvid IS NOT NULL) AS there FROM k)
SELECT count(*) FILTER (good) AS requested, count(*) FILTER (good AND there) AS enriched, count(*) FILTER (good AND NOT there) AS errors, count(*) FILTER (NOT good) AS skipped FROM g""",
    "tolerant_recall": f"SELECT card_id, route, 'gone' AS failed FROM search_cards WHERE route IN ({', '.join(repr(r) for r in ROUTES[:3])})",
    "replaced_items": f"""
SELECT key, title, views, coins, detail FROM (WITH {S.ENRICHED} SELECT key, title, views, coins, detail FROM items WHERE key IN (SELECT key FROM merged WHERE records % 2 = 0))
UNION ALL SELECT key, title, views, NULL::DOUBLE, NULL FROM (WITH {S.MERGED} SELECT key, title, views FROM merged WHERE records % 2 = 1)""",
    "growth_components": f"{_SCORED}, p AS (SELECT *, "
    + ", ".join(f"{m} / age AS p_{m}, CASE WHEN s_stats.{m} IS NOT NULL AND days > 0 AND {m} >= greatest(0.0, s_stats.{m}) THEN ({m} - greatest(0.0, s_stats.{m})) / days END AS a_{m}" for m in ("views", "likes", "coins"))
    + " FROM scored_g) SELECT key, "
    + ", ".join(f"round(p_{m}, 6) AS {m}_per_day, round(a_{m}, 6) AS {m}_actual_per_day, round(l_{m}, 6) AS {m}_lifecycle, round(o_{m}, 6) AS {m}_observed, round(CASE WHEN o_{m} IS NULL THEN l_{m} WHEN l_{m} IS NULL THEN o_{m} ELSE 0.7 * o_{m} + 0.3 * l_{m} END, 6) AS {m}_value" for m in ("views", "likes", "coins"))
    + ", concat_ws('|', CASE g_status WHEN 'estimated' THEN '尚无可用历史快照，当前为发布以来平均增速的低置信度估算' WHEN 'unavailable' THEN '缺少发布时间或统计数据，暂无法估算增长' END, CASE WHEN s_at IS NOT NULL AND g_seen < g_life THEN '部分指标发生回退或缺失，未将其误判为负增长' END) AS negative FROM p",
    "timeliness_intents": " UNION ALL ".join(
        f"SELECT * FROM (WITH {S.ENRICHED}, {S.quality()}, {S.growth(NOW_MS)}, {S.timeliness(NOW_MS, days)} SELECT '{text}' AS query, key, round(timeliness, 6) AS value, round(recency, 6) AS recency, round(heat, 6) AS online, {days} AS days FROM scored)" for text, days in INTENTS.items()
    ),
    "quality_scores": (
        f"WITH {S.ENRICHED}, {S.quality()} SELECT key, round(quality, 6) AS value, round(0.65 * q_abs + 0.35 * q_rate, 6) AS raw, round(q_full, "
        f"6) AS completeness, round(q_abs, 6) AS absolute, round(q_rate, 6) AS rate FROM scored_q"
    ),
    "growth_scores": (
        f"{_SCORED} SELECT key, round(growth, 6) AS value, round((CASE WHEN g_seen > 0 THEN g_seen ELSE g_life END)::DOUBLE, 6) AS completeness, round((CASE "
        f"WHEN g_status = 'unavailable' THEN 0.0 ELSE g_trust END)::DOUBLE, 6) AS confidence, round(g_hours, 6) AS observation_hours, g_status AS status "
        f"FROM scored_g"
    ),
    "timeliness_scores": (
        f"{_SCORED} SELECT key, round(timeliness, 6) AS value, round(online, 6) AS online_count, CASE WHEN recency IS NULL THEN 0::DOUBLE ELSE 0.65 END + CASE "
        f"WHEN heat IS NULL THEN 0::DOUBLE ELSE 0.35 END AS completeness FROM scored"
    ),
    "rank_all_views": f"{_RANKED} SELECT view, position, key, band, round(band_position, 6) AS band_position, round(inner_score, 6) AS inner_score, round(signal, 6) AS signal FROM ranked",
    "ranking_stats": (
        f"{_RANKED} SELECT count(*) AS evaluated, count(*) FILTER (passes) AS accepted, count(*) FILTER (NOT passes) AS rejected, 0.35::DOUBLE AS threshold, "
        f"0.5::DOUBLE AS min_coverage, 0.05::DOUBLE AS relevance_band FROM judged"
    ),
    "rejected_items": f"{_RANKED} SELECT key, round(relevance, 6) AS value FROM judged WHERE NOT passes",
    "shortlist": f"{_RANKED} SELECT key, min(3 * (position - 1) + view_index) AS turn FROM ranked WHERE position <= 60 GROUP BY key ORDER BY turn LIMIT 60",
    "online_shortlist": f"{_RANKED} SELECT key, position FROM ranked WHERE view = 'timeliness' AND position <= 24",
    "page_two": (
        f"{_RANKED}, n AS (SELECT greatest(1, ceil(max(position) / {RESULTS_PER_PAGE}.0)) AS pages FROM ranked WHERE view = 'growth') SELECT key, position "
        f"FROM ranked, n WHERE view = 'growth' AND position > (least(2, pages) - 1) * {RESULTS_PER_PAGE} AND position <= least(2, pages) * {RESULTS_PER_PAGE}"
    ),
    "sampled_history": f"{_WALK} SELECT source, \"at\" FROM k",
    "kept_history": (
        f"{_WALK}, n AS (SELECT source FROM young GROUP BY source ORDER BY max(\"at\") DESC, source LIMIT {HISTORY.keep_items}) SELECT source, \"at\" "
        f"FROM young SEMI JOIN n USING (source)"
    ),
    "snapshots_of_items": (
        f"{_WALK} SELECT d.bvid AS source, count(y.\"at\") AS n FROM (SELECT DISTINCT bvid FROM video_details) d LEFT JOIN (SELECT * FROM young "
        f"WHERE \"at\" <= {NOW_MS}) y ON y.source = d.bvid GROUP BY d.bvid"
    ),
    "recorded_history": f"""WITH {S.ENRICHED}, r AS (SELECT key AS source, {", ".join(f"CASE WHEN {m} >= 0 AND isfinite({m}) THEN {m} END AS {m}" for m in S.STATS)} FROM items WHERE detail IN ('complete', 'partial'))
SELECT source, "at", views, likes FROM r, (SELECT unnest([{NOW_MS}, {NOW_MS + 40 * 60_000}]) AS "at") WHERE coalesce({", ".join(S.STATS)}) IS NOT NULL""",
    "streamed_history": f"{_WALK} SELECT source, \"at\" FROM k",
    "display_texts": """
WITH x AS (SELECT trim(bvid) AS key, stat."view"::DOUBLE AS v, stat."like"::DOUBLE AS l, pubdate FROM video_details)
SELECT key, CASE WHEN v IS NULL THEN '—' WHEN v >= 1e9 THEN format('{:.0f}', floor(v / 1e8 + 0.5)) || '亿' WHEN v >= 1e8 THEN format('{:.1f}', floor(v / 1e8 * 10 + 0.5) / 10) || '亿' WHEN v >= 1e5 THEN format('{:.0f}', floor(v / 1e4 + 0.5)) || '万'
  WHEN v >= 1e4 THEN format('{:.1f}', floor(v / 1e4 * 10 + 0.5) / 10) || '万' ELSE format('{:,}', v::BIGINT) END AS views_text,
  CASE WHEN pubdate > 0 THEN strftime(make_timestamp(pubdate * 1000000), '%Y/%m/%d') ELSE '日期未知' END AS date_text, CASE WHEN l / nullif(v, 0) IS NULL THEN '—' ELSE floor(greatest(0.0, least(1.0, l / v)) * 100 + 0.5)::BIGINT::VARCHAR END AS share_text FROM x""",
}

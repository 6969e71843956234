"""Raw records to canonical items: cleaning, merging of duplicates, recall routes, details, online samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sift.config import PAGE_SIZE, PAGES, ROUTE_LABELS, ROUTES
from sift.functions.keys import PROPER_KEY
from sift.functions.numbers import duration_label, https_url, interaction, parse_duration, safe_number, strict_online
from sift.functions.text import strip_html

BASE_URL = "https://video.example/video/"
STATS = ("views", "likes", "favorites", "replies", "danmaku", "coins", "shares")


def route_label(order: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in ROUTE_LABELS.items():
        label = F.coalesce(label, F.when(order == name, F.lit(text)))
    return F.coalesce(label, order, F.lit("未知"))


def clean_tags(csv: Column) -> Column:
    """Distinct cleaned tags of a list separated by commas of either width, in order of first appearance."""
    cleaned = F.transform(F.split(F.coalesce(csv, F.lit("")), "[,，]"), lambda t: strip_html(t))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def _if_there(rows: DataFrame, name: str) -> Column:
    """A column that not every source has; NULL without it."""
    return F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")


def normalize_cards(cards: DataFrame, base_url: str = BASE_URL) -> DataFrame:
    """Canonical items of search cards, one row per card; cards that aren't videos or have no key are dropped.

    Texts are stripped of markup, counters are NULL unless finite and not negative, interaction counters also when 0
    (a placeholder there). coin, share and upic (the author's picture) are optional columns. seq orders rows by arrival: route, page, position, card."""
    rows = cards.where((F.col("type") == "video") & (F.coalesce(F.col("bvid"), F.lit("")) != ""))
    key, seconds = F.trim("bvid"), parse_duration(F.col("duration"))
    encoded = F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))
    rank = F.coalesce(*(F.when(F.col("route") == r, F.lit(i)) for i, r in enumerate(ROUTES)), F.lit(len(ROUTES)))
    order = F.coalesce("route", F.lit("unknown"))
    stats = {
        "views": safe_number(F.col("play")), "likes": interaction(F.col("like")), "favorites": interaction(F.col("favorites")), "replies": safe_number(F.col("review")),
        "danmaku": safe_number(F.col("danmaku")), "coins": interaction(_if_there(rows, "coin")), "shares": interaction(_if_there(rows, "share")),
    }
    return rows.select(
        key.alias("key"), F.struct(
            rank.alias("r"), F.col("page").alias("p"), F.col("position").alias("i"), F.col("card_id").alias("c"),
        ).alias("seq"), safe_number(F.col("aid")).cast("long").alias("aid"),
        strip_html(F.col("title")).alias("title"), strip_html(F.col("description")).alias("description"), clean_tags(F.col("tag")).alias("tags"), strip_html(F.col("typename")).alias("category"),
        F.concat(F.lit(base_url), encoded).alias("url"), https_url(F.col("pic")).alias("coverUrl"), seconds.alias("durationSeconds"), duration_label(F.col("duration"), seconds).alias("durationText"),
        (safe_number(F.col("pubdate")) * 1000).cast("long").alias("publishedAt"), F.struct(
            strip_html(F.col("author")).alias("name"), safe_number(F.col("mid")).cast("long").alias("mid"),
            https_url(_if_there(rows, "upic")).alias("avatar"),
        ).alias("author"),
        F.struct(*(v.alias(k) for k, v in stats.items())).alias("stats"),
        F.struct(order.alias("order"), route_label(F.col("route")).alias("orderLabel"), F.coalesce("page", F.lit(1)).alias("page"), F.col("position")).alias("source"),
    )


def merge_items(items: DataFrame) -> DataFrame:
    """One item per key: longest title and description (first of ties), first non-empty texts, first known numbers,
    largest counters, tags and sources united in order of arrival. Rows without a key are dropped.

    Everything is a combinable aggregate but the unions of tags and sources, which are reduced to one row per distinct
    value and key first, so a hot key's arrivals never meet in one group."""
    rows = items.where(F.coalesce(F.col("key"), F.lit("")) != "")
    longest = lambda c: F.min_by(c, F.struct(-F.length(c), "seq")).alias(c)
    text = lambda c, n: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(n)
    known = lambda c, n: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(n)
    flat = rows.select("*", F.col("author.name").alias("_name"), F.col("author.mid").alias("_mid"), F.col("author.avatar").alias("_avatar"))
    base = flat.groupBy("key").agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("records"), longest("title"), longest("description"), text("category", "category"), text("coverUrl", "coverUrl"), text("durationText", "durationText"), text("_name", "_name"), text("_avatar", "_avatar"),
        known("durationSeconds", "durationSeconds"), known("publishedAt", "publishedAt"), known("_mid", "_mid"), F.min_by("aid", "seq").alias("aid"), F.min_by("url", "seq").alias("url"), *(F.max(f"stats.{m}").alias(f"_{m}") for m in STATS),
    )
    tags = rows.select("key", "seq", F.posexplode("tags").alias("i", "tag")).groupBy("key", "tag").agg(F.min(F.struct("seq", "i")).alias("at"))
    tags = tags.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda x: x.tag).alias("tags"))
    sources = rows.groupBy("key", "source").agg(F.min("seq").alias("at")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x.source).alias("sources"))
    out = base.join(tags, "key", "left").join(sources, "key", "left")
    return out.select(
        "key", "seq", "records", "aid", "title", "description", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "category", "url", "coverUrl", "durationSeconds", "durationText", "publishedAt",
        F.struct(
            F.col("_name").alias("name"), F.col("_mid").alias("mid"), F.col("_avatar").alias("avatar"),
        ).alias("author"), F.struct(*(F.col(f"_{m}").alias(m) for m in STATS)).alias("stats"), "sources",
    )


def pool_counters(cards: DataFrame) -> DataFrame:
    """One row: raw, valid, unique, ignored and duplicate card counts."""
    valid = (F.col("type") == "video") & (F.coalesce(F.col("bvid"), F.lit("")) != "")
    n = cards.agg(F.count(F.lit(1)).alias("raw_count"), F.count(F.when(valid, 1)).alias("valid_count"), F.countDistinct(F.when(valid, F.trim("bvid"))).alias("unique_count"))
    return n.select(
        "raw_count", "valid_count", "unique_count", (F.col("raw_count") - F.col("valid_count")).alias("ignored_count"),
        (F.col("valid_count") - F.col("unique_count")).alias("duplicate_count"),
    )


def scan_pages(cards: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(route, page, raw_count, ignored_count, num_results, num_pages, has_next): what a paged scan tells about each of
    its pages; the page size is clamped to 1..50. Cards without a route or page are of "unknown" and page 1."""
    size = max(1, min(page_size, PAGE_SIZE))
    valid = (F.col("type") == "video") & (F.coalesce(F.col("bvid"), F.lit("")) != "")
    per = cards.groupBy(F.coalesce("route", F.lit("unknown")).alias("route"), F.coalesce("page", F.lit(1)).alias("page")).agg(
        F.count(F.lit(1)).alias("raw_count"), F.count(F.when(~F.coalesce(valid, F.lit(False)), 1)).alias("ignored_count"),
    )
    total = per.groupBy("route").agg(F.sum("raw_count").alias("num_results"))
    pages = F.ceil(F.col("num_results") / size)
    return per.join(total, "route").select("route", "page", "raw_count", "ignored_count", "num_results", pages.alias("num_pages"), (F.col("page") < pages).alias("has_next"))


def lookup_counts(keys: DataFrame, details: DataFrame) -> DataFrame:
    """One row: requested (distinct proper keys), enriched (with a detail), errors (without) and skipped (distinct
    improper ones) of a batched lookup. keys: (key); details: (key, ...), unique."""
    good = F.col("key").rlike(PROPER_KEY)
    asked = keys.where(F.col("key").isNotNull()).select("key", good.alias("good")).distinct()
    found = asked.join(details.select("key", F.lit(True).alias("_found")), "key", "left")
    there = F.col("good") & F.col("_found").isNotNull()
    n = found.agg(F.count(F.when(F.col("good"), 1)).alias("requested"), F.count(F.when(there, 1)).alias("enriched"), F.count(F.when(~F.col("good"), 1)).alias("skipped"))
    return n.select("requested", "enriched", (F.col("requested") - F.col("enriched")).alias("errors"), "skipped")


def recall_routes(items: DataFrame, routes: dict[str, Column], pages: int = PAGES, page_size: int = PAGE_SIZE) -> DataFrame:
    """(key, order, orderLabel, page, position): the first pages of every route, by its column descending then key.

    Each route is a top-k (no global sort); only those rows are numbered."""
    top = pages * page_size
    out = None
    for i, (name, by) in enumerate(routes.items()):
        first = items.select("key", by.alias("_by")).orderBy(F.desc_nulls_last("_by"), "key").limit(top)
        n = F.row_number().over(W.orderBy(F.desc_nulls_last("_by"), "key"))
        rows = first.withColumn("_n", n).select(
            "key", F.lit(name).alias("order"), route_label(F.lit(name)).alias("orderLabel"), F.ceil(F.col("_n") / page_size).cast("int").alias("page"),
            ((F.col("_n") - 1) % page_size + 1).cast("int").alias("position"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def tolerant_union(routes: dict[str, object], required: int = 1) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The union of what the route builders give, and (route, message) of those that failed while planning; an error
    only if fewer than `required` are left."""
    out, errors = None, []
    for name, build in routes.items():
        try:
            df = build()
            df.schema  # noqa: B018
            out = df if out is None else out.unionByName(df)
        except Exception as e:  # a failing source ends its own route only
            errors.append((name, str(e).split("\n")[0]))
    if len(routes) - len(errors) < required:
        raise RuntimeError(f"all routes failed: {errors}")
    return out, errors


def clean_pages(pages: Column) -> Column:
    """Parts with a cid; the page number defaults to the place in the list."""
    made = F.transform(
        pages, lambda p,
        i: F.struct(safe_number(p.cid).cast("long").alias("cid"), F.coalesce(safe_number(p.page).cast("int"), (i + 1).cast("int")).alias("page"), strip_html(p.part).alias("part"), safe_number(p.duration).alias("durationSeconds")),
    )
    return F.coalesce(F.filter(made, lambda p: p.cid.isNotNull()), F.array().cast("array<struct<cid:bigint,page:int,part:string,durationSeconds:double>>"))


def normalize_details(details: DataFrame, source: str = "detail") -> DataFrame:
    """Authoritative records by key; zeros are real here. pageCount is `videos` or else the number of usable parts."""
    names = {"views": "view", "likes": "like", "favorites": "favorite", "replies": "reply", "danmaku": "danmaku", "coins": "coin", "shares": "share"}
    rows = details.where(F.trim(F.coalesce("bvid", F.lit(""))) != "")
    pages, seconds = clean_pages(F.col("pages")), safe_number(F.col("duration"))
    return rows.select(
        F.trim("bvid").alias("key"), safe_number(F.col("aid")).cast("long").alias("aid"), strip_html(F.col("title")).alias("title"), strip_html(F.col("desc")).alias("description"), https_url(F.col("pic")).alias("coverUrl"),
        seconds.alias("durationSeconds"), duration_label(F.lit(None).cast("string"), seconds).alias("durationText"), (safe_number(F.col("pubdate")) * 1000).cast("long").alias("publishedAt"),
        F.struct(
            strip_html(F.col("owner.name")).alias("name"), safe_number(F.col("owner.mid")).cast("long").alias("mid"),
            https_url(F.col("owner.face")).alias("avatar"),
        ).alias("author"),
        F.struct(*(safe_number(F.col(f"stat.{v}")).alias(k) for k, v in names.items())).alias("stats"), pages.alias("pages"),
        F.coalesce(
            safe_number(F.col("videos")), F.when(F.size(pages) > 0, F.size(pages).cast("double")),
        ).alias("pageCount"), F.lit(source).alias("source"), F.lit(source != "detail").alias("partial"),
    )


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Details from the primary source, and of keys it doesn't have from the fallback."""
    return primary.unionByName(fallback.join(primary.select("key"), "key", "left_anti"))


def enrich(items: DataFrame, details: DataFrame) -> DataFrame:
    """items with details merged in: empty texts and unknown numbers are filled, counters are overwritten where the
    detail knows them (zeros included), enrichment tells complete, partial or unavailable. items' other rows stay."""
    d = details.select("key", F.struct(*(F.col(c) for c in details.columns if c != "key")).alias("_d"))
    rows = items.join(d, "key", "left")
    fill = lambda c, x: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.coalesce(F.col(x), F.col(c), F.lit(""))).otherwise(F.col(c))
    new = {c: fill(c, f"_d.{c}") for c in ("title", "description", "coverUrl", "durationText")} | {c: F.coalesce(c, f"_d.{c}") for c in ("aid", "durationSeconds", "publishedAt")}
    new["author"] = F.struct(
        fill("author.name", "_d.author.name").alias("name"), F.coalesce("author.mid", "_d.author.mid").alias("mid"),
        fill("author.avatar", "_d.author.avatar").alias("avatar"),
    )
    new["stats"] = F.struct(*(F.coalesce(f"_d.stats.{m}", f"stats.{m}").alias(m) for m in STATS))
    new["pages"] = F.col("_d.pages")
    state = F.when(F.col("_d").isNull(), "unavailable").when(F.col("_d.partial"), "partial").otherwise("complete")
    new["enrichment"] = F.struct(state.alias("detail"), F.col("_d.source").alias("detailSource"), F.col("_d.pageCount").alias("pageCount"))
    return rows.withColumns(new).drop("_d")


def replace_enriched(items: DataFrame, enriched: DataFrame) -> DataFrame:
    """items with the rows of the same key in `enriched` in their place."""
    return items.join(enriched.select("key"), "key", "left_anti").unionByName(enriched, allowMissingColumns=True)


def first_keys(keys: DataFrame, limit: int) -> DataFrame:
    """(key, seq): the first `limit` distinct proper keys by seq; improper ones are skipped."""
    good = keys.where(F.col("key").rlike(PROPER_KEY)).groupBy("key").agg(F.min("seq").alias("seq"))
    return good.orderBy("seq", "key").limit(limit)


def select_part(pages: Column, wanted: int | None = None) -> Column:
    """(cid, page, part, selection, multiPart) of the requested page, or the first one."""
    first = F.try_element_at(pages, F.lit(1))
    if wanted is None:
        part, how = first, F.lit("first-page")
    else:
        asked = F.try_element_at(F.filter(pages, lambda p: p.page == wanted), F.lit(1))
        part, how = F.coalesce(asked, first), F.when(asked.isNotNull(), "requested-page").otherwise("first-page-fallback")
    return F.struct(
        part.cid.alias("cid"), part.page.alias("page"), part.part.alias("part"), F.when(part.cid.isNotNull(), how).alias("selection"),
        (F.size(pages) > 1).alias("multiPart"),
    )


def normalize_online(samples: DataFrame) -> DataFrame:
    """Online counts as strictly parsed; hidden ones are NULL. A missing switch means visible."""
    seen = {f: F.coalesce(F.col(f"show_switch.{f}"), F.lit(True)) for f in ("total", "count")}
    (total, about), (web, web_about) = strict_online(F.col("total")), strict_online(F.col("count"))
    return samples.select(
        "sample_id", F.col("bvid").alias("key"), F.when(seen["total"], total).alias("total"), F.when(seen["count"], web).alias("web"), (seen["total"] & about).alias("total_approximate"),
        (seen["count"] & web_about).alias("web_approximate"), seen["total"].alias("total_visible"), seen["count"].alias("web_visible"), "sampled_at",
    )


def latest_online(online: DataFrame) -> DataFrame:
    """(key, online): the latest sample's total, or else its web count."""
    best = F.max_by(F.coalesce("total", "web"), F.struct("sampled_at", "sample_id"))
    return online.where(F.col("key").isNotNull()).groupBy("key").agg(best.alias("online"))

import pytest
from pyspark.sql import functions as F

from sift.functions import numbers as N
from sift.operators import ingest as I
from sift.sources import requests as R

CARD = "card_id long, type string, bvid string, aid long, title string, description string, author string, mid long, typename string, pic string, duration string, play long, `like` long, favorites long, review long, danmaku long, pubdate long, tag string, route string, page int, position int, extra string"
BASE = dict(card_id=1, type="video", bvid="BV1LEAF23456", aid=321, title='<em class="keyword">银杏</em> &amp; 山茶', description="秋日植物园", author="园丁", mid=77, typename="自然", pic="//img.example/test.jpg", duration="13:7", play=13500, like=700, favorites=350, review=55, danmaku=80, pubdate=1_710_000_000, tag="银杏,山茶,秋日", route="click", page=2, position=4, extra="x")


def cards(spark, *changes):
    return spark.createDataFrame([tuple({**BASE, **c}.values()) for c in changes], CARD)


def _one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("x")).first().x


def test_cards(spark):
    rows = I.normalize_cards(cards(spark, {}, {"type": "ketang", "bvid": ""}, {"card_id": 3, "like": 0, "favorites": 0, "bvid": None}, {"card_id": 4, "bvid": "BV2", "like": 0, "favorites": 0, "title": None, "tag": None, "duration": None})).collect()
    assert sorted(r.key for r in rows) == ["BV1LEAF23456", "BV2"]
    a, b = sorted(rows, key=lambda r: r.key)
    assert (a.title, a.coverUrl, a.durationSeconds, a.tags, a.source.orderLabel, a.publishedAt) == ("银杏 & 山茶", "https://img.example/test.jpg", 787.0, ["银杏", "山茶", "秋日"], "播放", 1_710_000_000_000)
    assert (b.stats.likes, b.stats.favorites, b.stats.views, b.title, b.tags, b.durationText) == (None, None, 13500.0, "", [], "")


def test_merge(spark):
    rows = I.normalize_cards(cards(spark, {"route": "totalrank", "play": 100, "description": "short"}, {"card_id": 2, "route": "pubdate", "play": 200, "description": "a longer text", "tag": "秋日,新"}, {"card_id": 2, "route": "pubdate", "play": 200, "description": "a longer text", "tag": "秋日,新"}))
    m = I.merge_items(rows).collect()
    assert len(m) == 1 and m[0].stats.views == 200 and m[0].description == "a longer text"
    assert [s.order for s in m[0].sources] == ["totalrank", "pubdate"] and m[0].tags == ["银杏", "山茶", "秋日", "新"]
    assert I.merge_items(rows.where("false")).count() == 0
    p = I.pool_counters(cards(spark, {}, {"card_id": 2}, {"type": "ketang"})).first()
    assert tuple(p) == (3, 2, 1, 1, 1)


@pytest.mark.parametrize("text, seconds", [("13:7", 787.0), ("1:02:03", 3723.0), ("bad", None), ("", None), (None, None), ("5:", 300.0)])
def test_durations(spark, text, seconds):
    assert _one(spark, N.parse_duration(F.col("v")), text) == seconds


@pytest.mark.parametrize("text, count, about, loose", [("1.7万+", 17000, True, 17000), ("2.1亿", 210_000_000, True, 210_000_000), ("2,345+", 2345, True, 2345), ("--", None, False, None), (None, None, False, None), ("约1.5万人", None, False, 15000)])
def test_online_counts(spark, text, count, about, loose):
    value, rough = N.strict_online(F.col("v"))
    assert _one(spark, value, text) == count and _one(spark, rough, text) == about
    assert _one(spark, N.lenient_online(F.col("v")), text) == (None if loose is None else pytest.approx(loose))


def test_numbers(spark):
    text = lambda v: _one(spark, N.safe_number(F.col("v"), text=True), v)
    assert [text(v) for v in ("1,200", "", "  ", "7d", "NaN", "-1", "1e3", None)] == [1200.0, None, 0.0, None, None, None, 1000.0, None]
    assert [_one(spark, N.format_count(F.col("v")), v, "double") for v in (None, 0.0, 9999.0, 12345.0, 123456.0, 99_999_999.0, 123_456_789.0, 2e9)] == ["—", "0", "9,999", "1.2万", "12万", "10000万", "1.2亿", "20亿"]
    assert [_one(spark, N.https_url(F.col("v")), v) for v in ("//a.b/c", "http://a.b/c", "https://a.b", "ftp://a", "", None)] == ["https://a.b/c", "https://a.b/c", "https://a.b", "", "", ""]
    assert [_one(spark, N.format_score(F.col("v")), v, "double") for v in (0.825, 2.0, -1.0, None)] == ["83", "100", "0", "—"]


def test_requests(spark):
    q = R.canonical_query({"z": F.col("v"), "a": F.lit("中文 空格"), "n": F.lit(None)})
    assert _one(spark, q, "a!'()*b") == "a=%E4%B8%AD%E6%96%87%20%E7%A9%BA%E6%A0%BC&z=ab"
    kinds = [(0, True), (412, False), (0, False), (-404, False)]
    rows = spark.createDataFrame(kinds, "c int, v boolean").select(R.payload_kind(F.col("c"), F.col("v")).alias("k")).collect()
    assert [r.k for r in rows] == ["risk", "risk", "ok", "api"]


def test_enrichment(spark):
    items = I.merge_items(I.normalize_cards(cards(spark, {}, {"card_id": 2, "bvid": "BV2OTHER1234", "like": 88})))
    detail = spark.createDataFrame([("BV1LEAF23456", 1, "t", "d", "", 100, 1, None, ("o", 2, ""), (50000, 0, None, 300, 400, 1800, 260), [(101, 1, "上集", 300), (None, 2, "x", 1)])],
        "bvid string, aid long, title string, desc string, pic string, duration long, pubdate long, videos int, owner struct<name:string,mid:long,face:string>, stat struct<view:long,`like`:long,favorite:long,reply:long,danmaku:long,coin:long,share:long>, pages array<struct<cid:long,page:int,part:string,duration:long>>")
    got = {r.key: r for r in I.enrich(items, I.normalize_details(detail)).collect()}
    a, b = got["BV1LEAF23456"], got["BV2OTHER1234"]
    assert (a.stats.likes, a.stats.favorites, a.enrichment.detail, a.enrichment.pageCount, len(a.pages)) == (0.0, 350.0, "complete", 1.0, 1)
    assert (b.stats.likes, b.enrichment.detail) == (88.0, "unavailable")
    again = I.with_fallback(I.normalize_details(detail.where("false")), I.normalize_details(detail, "stat-fallback")).first()
    assert again.partial and again.source == "stat-fallback"


def test_tolerant_union(spark):
    good = lambda: spark.range(2)

    def bad():
        raise OSError("down")

    out, errors = I.tolerant_union({"a": good, "b": bad})
    assert out.count() == 2 and errors == [("b", "down")]
    with pytest.raises(RuntimeError):
        I.tolerant_union({"b": bad})


def test_optional_card_columns(spark):
    more = cards(spark, {}, {"card_id": 2, "page": 3}).withColumns({"coin": F.when(F.col("card_id") == 1, 7).otherwise(0), "share": F.lit("5"), "upic": F.when(F.col("card_id") == 2, F.lit("//img.example/a.jpg"))})
    got = I.merge_items(I.normalize_cards(more)).first()
    assert (got.stats.coins, got.stats.shares, got.author.avatar) == (7.0, 5.0, "https://img.example/a.jpg")
    plain = I.merge_items(I.normalize_cards(cards(spark, {}))).first()
    assert (plain.stats.coins, plain.stats.shares, plain.author.avatar) == (None, None, "")


def test_scans_and_lookups(spark):
    rows = cards(spark, {}, {"card_id": 2, "bvid": None}, {"card_id": 3, "page": None, "route": None, "type": None}, *({"card_id": 10 + i, "page": 1} for i in range(3)))
    got = {(r.route, r.page): tuple(r)[2:] for r in I.scan_pages(rows, 2).collect()}
    assert got == {("click", 2): (2, 1, 5, 3, True), ("click", 1): (3, 0, 5, 3, True), ("unknown", 1): (1, 1, 1, 1, False)}
    assert I.scan_pages(rows.where("false")).count() == 0
    keys = spark.createDataFrame([("BV1LEAF23456",), ("BV1LEAF23456",), ("BVabcdefgh9",), ("no",), (None,)], "key string")
    assert tuple(I.lookup_counts(keys, spark.createDataFrame([("BV1LEAF23456", 1)], "key string, x int")).first()) == (2, 1, 1, 1)
    assert tuple(I.lookup_counts(keys.where("false"), spark.createDataFrame([], "key string")).first()) == (0, 0, 0, 0)


def test_failing_routes_end_alone(spark):
    good = spark.createDataFrame([("a",)], "key string")
    found, errors = I.tolerant_union({"one": lambda: good, "two": lambda: good.select("nothing")})
    assert found.count() == 1 and [n for n, _ in errors] == ["two"]
    with pytest.raises(RuntimeError):
        I.tolerant_union({"two": lambda: good.select("nothing")})

"""Admission, signals and ranking on small items."""

import pytest
from pyspark.sql import functions as F

from sift.operators import history, ranking, signals
from sift.operators.relevance import evaluate
from sift.plans.search import search

NOW = 1_788_782_400_000
DAY = 86_400_000
SCHEMA = (
    "key string, title string, description string, tags array<string>, category string, author struct<name:string,mid:bigint>, publishedAt bigint, "
    "stats struct<views:double,likes:double,favorites:double,coins:double,shares:double,replies:double,danmaku:double>, "
    "sources array<struct<order:string,orderLabel:string,page:int,position:int>>"
)
STATS = dict(views=1000.0, likes=50.0, favorites=20.0, coins=10.0, shares=2.0, replies=5.0, danmaku=10.0)


def item(key, title="", description="", tags=(), stats=None, published=NOW - 900 * DAY, category="竞技体育", author="测试UP"):
    return (key, title, description, None if tags is None else list(tags), category, (author, 1), published, None if stats is None and key == "nostats" else {**STATS, **(stats or {})}, [])


def frame(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


CASES = [
    ("费德勒 2017 澳网 纳达尔", dict(title="费德勒 2017 澳网决赛 对阵纳达尔"), True),
    ("费德勒 2017 澳网 纳达尔", dict(title="纳达尔红土十大击球", stats={"views": 5e7}), False),
    ("RTX 5090", dict(title="RTX 4090 显卡完整评测"), False),
    ("RTX 5090", dict(title="RTX 5090 显卡完整评测"), True),
    ("MacBook Pro M4 Max", dict(title="MacBook Pro M4 review"), False),
    ("Galaxy Ultra", dict(title="Galaxy review"), False),
    ("Node.js", dict(title="NodeJS 教程"), True),
    ("GPT-4o", dict(title="GPT 4o 使用教程"), True),
    ('"RTX 5090"', dict(title="RTX-5090 显卡评测"), True),
    ("Sony A7 IV", dict(title="Sony A7 III review"), False),
    ("Wilson Pro Staff 97 v14", dict(title="Wilson Pro Staff 97 V13 网球拍"), False),
    ('"machine learning"', dict(title="Machine Learning tutorial"), True),
    ('"machine learning"', dict(title="Machine tutorial", description="Learning resources"), False),
    ("费德勒澳网纳达尔", dict(title="费德勒与纳达尔的澳网决赛"), True),
    ("费德勒 2017 澳网 -德约科维奇", dict(title="费德勒 2017 澳网决赛", tags=["德约科维奇"]), False),
    ("教程 -pro -14", dict(title="2014 Programming 教程"), True),
    ("transformr", dict(title="Transformer tutorial for beginners"), True),
    ("pro", dict(title="Programming tutorial"), False),
    ("网球", dict(title=None, description=None, tags=None, author=None, category=None), False),
]


@pytest.mark.parametrize("group", sorted({c[0] for c in CASES}))
def test_admission(spark, group):
    mine = [c for c in CASES if c[0] == group]
    rows = evaluate(frame(spark, *(item(f"k{i}", **c[1]) for i, c in enumerate(mine))), group)
    got = {r.key: r.passes for r in rows.select("key", "relevance.passes").collect()}
    assert got == {f"k{i}": c[2] for i, c in enumerate(mine)}


def test_empty_query_and_table(spark):
    rows = evaluate(frame(spark, item("a", "x")), "")
    assert rows.select("relevance.passes").first()[0] is False
    with pytest.raises(ValueError):
        search(frame(spark, item("a", "x")), " -x ", NOW)
    assert search(frame(spark), "网球", NOW).ranked.count() == 0


def test_quality_is_independent_of_date_and_missing_is_neutral(spark):
    nulls = {m: None for m in STATS}
    rows = signals.quality(frame(spark, item("old", published=1_262_304_000_000), item("new", published=NOW - DAY), item("one", stats={**nulls, "views": 1.0}), item("zero", stats={m: 0.0 for m in STATS}), item("high", stats={m: 1e6 for m in STATS}), item("nostats")))
    q = {r.key: r.quality for r in rows.select("key", "quality").collect()}
    assert q["old"].value == q["new"].value < q["high"].value
    assert q["one"].completeness < q["zero"].completeness and abs(q["one"].value - 0.5) < abs(q["zero"].value - 0.5)
    assert q["nostats"].value == 0.5 and q["nostats"].completeness == 0


def _growth(spark, snapshots, **kw):
    s = spark.createDataFrame([(i, "k", t, {**STATS, **v}) for i, (t, v) in enumerate(snapshots)], "snapshot_id long, bvid string, capturedAt long, stats struct<views:double,likes:double,favorites:double,coins:double,replies:double,danmaku:double,shares:double>")
    return signals.growth(frame(spark, item("k", **kw)), NOW, s).first().growth


def test_growth(spark):
    now = {"views": 200_000.0, "likes": 9000.0}
    g = _growth(spark, [(NOW - 6 * 3_600_000, {"views": 170_000.0, "likes": 8000.0})], stats=now)
    assert g.status == "observed" and g.observation_hours == 6
    g = _growth(spark, [((NOW - 6 * 3_600_000) // 1000, {"views": 170_000.0})], stats=now)  # seconds
    assert g.status == "observed" and g.observation_hours == 6
    g = _growth(spark, [(NOW - 300_000, {})], stats=now)
    assert g.status == "estimated" and g.confidence <= 0.35
    g = _growth(spark, [(NOW - 7_200_000, {m: 1e9 for m in STATS})], stats=now)
    assert g.status == "estimated" and "部分指标发生回退或缺失，未将其误判为负增长" not in g.positive_reasons
    assert _growth(spark, [], published=None, stats=now).status == "unavailable"


def test_timeliness(spark):
    online = spark.createDataFrame([("zero", 0.0), ("hot", 17_000.0)], "key string, online double")
    rows = signals.timeliness(frame(spark, *(item(k, published=NOW - 2 * DAY) for k in ("none", "zero", "hot"))), "网球", NOW, online)
    t = {r.key: r.timeliness for r in rows.select("key", "timeliness").collect()}
    assert 0 < t["zero"].value < t["none"].value < t["hot"].value and t["none"].value < 0.85
    assert t["none"].online_status == "unavailable" and t["hot"].online_count == 17_000
    from sift.query import parse

    assert [signals.half_life(parse(q), NOW)[0] for q in ("最新 网球", "2026 网球", "网球", "2017 澳网")] == [30, 90, 180, 730]


def test_bands_come_first_and_views_differ(spark):
    items = frame(spark, item("full", "网球教程", stats={"views": 20.0}), item("split", "教程合集", tags=["网球"], stats={"views": 9e7}), item("settled", "网球教程 一", stats={m: 1e6 for m in STATS}), item("rising", "网球教程 二"))
    snaps = spark.createDataFrame([(1, "rising", NOW - 3_600_000, {m: 0.0 for m in STATS}), (2, "settled", NOW - 3_600_000, {m: 1e6 for m in STATS})], "snapshot_id long, bvid string, capturedAt long, stats struct<views:double,likes:double,favorites:double,coins:double,replies:double,danmaku:double,shares:double>")
    ranked = search(items, "网球教程", NOW, snaps).ranked.select("view", "position", "key", "rank.relevance_band").collect()
    for view in ("quality", "growth", "timeliness"):
        mine = sorted((r for r in ranked if r.view == view), key=lambda r: r.position)
        assert [r.relevance_band for r in mine] == sorted((r.relevance_band for r in mine), reverse=True)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
    at = {(r.view, r.key): r.position for r in ranked}
    assert at["quality", "settled"] < at["quality", "rising"]


def test_shortlist_pages_and_numbers(spark):
    rows = spark.createDataFrame([(v, i, p, k) for i, (v, ks) in enumerate([("quality", "ab"), ("growth", "bc"), ("timeliness", "ca")]) for p, k in enumerate(ks, 1)], "view string, view_index int, position int, key string")
    assert [r.key for r in ranking.balanced_shortlist(rows, 3).collect()] == ["a", "b", "c"]
    many = spark.range(1, 26).select(F.lit("quality").alias("view"), F.col("id").alias("position"))
    assert [ranking.page_of(many, "quality", p).count() for p in (1, 2, 9)] == [24, 1, 1]
    assert ranking.page_numbers(5, 10) == [1, "…", 3, 4, 5, 6, 7, "…", 10]


def test_history_interval_and_retention(spark):
    m = 60_000
    rows = spark.createDataFrame([("a", 0), ("a", 30 * m), ("a", 61 * m), ("a", 61 * m), (None, 5), ("b", None)], "source string, at long")
    from sift.config import HistoryPolicy

    kept = history.sample_history(rows, HistoryPolicy(min_interval_ms=60 * m))
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 0), ("a", 61 * m)]
    assert history.sample_history(rows.where("false")).count() == 0
    some = spark.createDataFrame([(k, t) for k, t in (("old", 1), ("a", 9000), ("b", 9500), ("c", 9900))], "source string, at long")
    left = history.retain(some, 10_000, HistoryPolicy(keep_items=2, max_age_ms=5000))
    assert sorted(r.source for r in left.collect()) == ["b", "c"]


def test_history_shards_equal_walk(spark):
    import random

    import numpy as np

    from sift.config import HistoryPolicy

    rng = random.Random(3)
    times = sorted({rng.randrange(0, 5_000_000) for _ in range(900)})
    rows = spark.createDataFrame([("hot", t) for t in times] + [("cold", 5)], "source string, at long")
    for interval in (1, 7000, 90_000, 10_000_000):
        got = history.sample_history(rows, HistoryPolicy(min_interval_ms=interval), last=False, shard_rows=60)
        assert sorted(r.at for r in got.where("source = 'hot'").collect()) == history.keep_from(np.array(times), None, interval).tolist()


def test_stream_equals_batch(spark, tmp_path):
    from sift.streaming.history import sample_stream

    rows = spark.createDataFrame([("a", NOW + 900_000 * i, i) for i in range(9)] + [("b", NOW - 5 * DAY, 100), ("b", None, 101)], "source string, at long, reading long")
    rows.where("reading < 5").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/*"))

    def run():
        q = sample_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    rows.where("reading >= 5").coalesce(1).write.parquet(str(tmp_path / "in/2"))
    run()
    got = {(r.source, r.at) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.source, r.at) for r in history.sample_history(rows, last=False).collect()}


def test_positions_equal_a_sort(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(f"k{i:03}", {"value": rng.choice([0.31, 0.42, 0.4201, 0.99, 1.0])}, *({"value": rng.choice([0.0, 0.5, 0.5, 0.7])} for _ in range(3)), "x") for i in range(200)]
    kind = "key string, relevance struct<value:double>, quality struct<value:double>, growth struct<value:double>, timeliness struct<value:double>, position string"
    scored = spark.createDataFrame(rows, kind).drop("position")
    got = ranking.rank_views(scored).collect()
    assert len(got) == 600
    for view in ("quality", "growth", "timeliness"):
        mine = sorted((r for r in got if r.view == view), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, 201))
        order = [(-r["rank"].relevance_band, -r["rank"].inner_score, -r.relevance.value, -r["rank"].signal, -r.quality.value, r.key) for r in mine]
        assert order == sorted(order)
    page = ranking.page_of(ranking.rank_views(scored), "growth", 99)
    assert sorted(r.position for r in page.collect()) == list(range(193, 201))
    assert ranking.rank_views(scored.where("false")).count() == 0


def test_history_store(spark, tmp_path):
    minute, kind = 60_000, "key string, enrichment struct<detail:string>, stats struct<views:double,likes:double,favorites:double,replies:double,danmaku:double,coins:double,shares:double>, extra int"
    none = [None] * 6
    items = spark.createDataFrame([("a", ("complete",), (1.0, *none), 1), ("b", ("unavailable",), (1.0, *none), 1), (None, ("complete",), (1.0, *none), 1), ("c", ("partial",), (None, *none), 1), ("d", None, None, 1)], kind)
    store = history.HistoryStore(spark, str(tmp_path / "store"), history.HistoryPolicy(keep_snapshots=2, max_age_ms=1000 * minute))
    assert store.read().count() == 0
    (tmp_path / "store" / "v9").mkdir(parents=True)  # left half-written by a lost writer
    for t in (0, 20, 30, 61):
        store.record(items, (1000 + t) * minute)
    assert [(r.source, r.at // minute - 1000, r.stats.views) for r in store.read().orderBy("at").collect()] == [("a", 30, 1.0), ("a", 61, 1.0)]
    store.record(items.where("false"), 5000 * minute)
    assert store.read().count() == 0


def test_half_lives():
    from sift.query import parse

    now = 1_788_782_400_000  # in 2026
    days = {q: signals.half_life(parse(q), now)[0] for q in ("最新 网球", "latest 2026", "2026 网球", "2017 澳网", "2025 网球", "2030 网球", "网球", "2026 2017")}
    assert list(days.values()) == [30, 30, 90, 730, 180, 180, 180, 90]

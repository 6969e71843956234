"""Spikes and the regular grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sift.operators.grid import regular_grid
from sift.operators.readings import METRICS, shard_by_time, snapshot_readings
from sift.operators.spikes import flag_spikes

HOUR = 3_600_000
T0 = 1_787_000_400_000 // HOUR * HOUR
READING = "reading long, source string, at long, " + ", ".join(f"{m} double" for m in METRICS) + ", extra string"


def series(source, views, likes=None, start=0, first_id=0, step=HOUR, base=None):
    out = []
    for i, v in enumerate(views):
        rest = (base or 100) + 7 * i
        like = likes[i] if likes else 50.0 + 3 * i
        out.append((first_id + i, source, T0 + start + i * step, v, like, *(float(rest + k) for k in range(5)), "x"))
    return out


def found(spark, rows, **kw):
    return {(r.reading, r.metric, r.kind) for r in flag_spikes(spark.createDataFrame(rows, READING), ["views", "likes"], **kw).collect()}


def test_spikes(spark):
    grow = [1000.0 + 20 * i for i in range(30)]
    spiked, stuck, lasting, bad, slow = list(grow), list(grow), list(grow), list(grow), [500.0] * 30
    spiked[10], spiked[20], spiked[21] = 25_000.0, 60.0, 61.0
    stuck[12:18] = [stuck[11]] * 6
    for i in range(15, 30):
        lasting[i] += 900
    bad[3], bad[4], bad[5], bad[6], bad[7] = -1.0, 1234.5, 9e15, None, float("nan")
    rows = series("a", spiked) + series("b", stuck, first_id=100) + series("c", lasting, first_id=200) + series("d", bad, first_id=300) + series("e", slow, first_id=400, base=10**6)
    rows += [(900, "a", None, -5.0, None, None, None, None, None, None, None), (901, "z", T0, None, None, None, None, None, None, None, None)]
    got = found(spark, rows)
    assert got == (
        {(10, "views", "outlier"), (20, "views", "outlier"), (21, "views", "outlier")} | {(i, "views", "stuck") for i in range(112, 118)}
        | {(i, "views", "impossible") for i in (303, 304, 305, 307)} | {(900, "views", "impossible")}
    )


def test_spikes_in_noise_and_rounding(spark):
    rng = np.random.default_rng(1)
    noisy = [float(round(50_000 * (1 + 0.01 * e))) for e in rng.standard_normal(60)]
    noisy[30] = 65_000.0
    round_ = [float(round((20_000 + 13 * i) / 100) * 100) for i in range(60)]
    got = found(spark, series("n", noisy) + series("r", round_, first_id=100))
    assert {g for g in got if g[1] == "views"} == {(30, "views", "outlier")}


def test_sketches_merge_and_tell_quartiles():
    from sift.operators.spikes import merged, quartiles, sketch

    rng = np.random.default_rng(7)
    group, values = rng.integers(0, 5, 4000), rng.standard_normal(4000) * 10.0 ** rng.integers(-3, 3, 4000)
    whole = sketch(group, values)
    parts = [sketch(group[k::3], values[k::3]) for k in range(3)]
    keys, counts = merged(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
    assert np.array_equal(keys, whole[0]) and np.array_equal(counts, whole[1])
    got = quartiles(keys, counts, 6)
    for g in range(5):
        v = np.sort(values[group == g])
        assert got[g, 2] == len(v) and got[g, :2] == pytest.approx([v[int(np.ceil(q * len(v))) - 1] for q in (0.25, 0.75)], rel=0.011)
    assert np.isnan(got[5, 0]) and got[5, 2] == 0 and np.isnan(quartiles(keys[:0], counts[:0], 1)[0, 0])


def test_dips_of_small_counts_ends_and_varying_sources(spark):
    rng = np.random.default_rng(3)
    flat = [1000.0 + i for i in range(30)]
    dips = [52.0] * 30
    dips[9], dips[20] = 0.0, 1.0
    last, moved = list(flat), list(flat)
    last[29] = 2400.0  # alone, and faster than ever before
    noisy = [float(round(16_000 * (1 + 0.04 * e))) for e in rng.standard_normal(40)]
    noisy[15:25] = [noisy[15]] * 10
    rows = series("dips", flat, dips) + series("last", last, first_id=100) + series("noisy", noisy, first_id=200)
    # the same jump where the other metrics move along is growth
    along = series("along", moved, first_id=300, base=1000)
    rows += along[:-1] + [(*along[-1][:3], *(v * 2.4 for v in along[-1][3:10]), "x")]
    # others of a varying source vary as well
    vary = rng.standard_normal((40, 5)) * 40 + 1000
    rows = [(*r[:5], *map(float, np.round(vary[r[0] - 200])), "x") if r[1] == "noisy" else r for r in rows]
    got = found(spark, rows)
    assert {g for g in got if g[2] == "outlier" and not 200 <= g[0] < 300} == {(9, "likes", "outlier"), (20, "likes", "outlier"), (129, "views", "outlier")}
    assert {r for r, m, k in got if (m, k) == ("views", "stuck")} == set(range(216, 225))


def test_spikes_empty_short_and_sharded(spark):
    assert found(spark, []) == set()
    assert found(spark, series("s", [1.0, 900.0, 2.0])) == set()
    views = [1000.0 + 20 * i for i in range(400)]
    for i in (50, 199, 200, 201, 333):
        views[i] = 99_999.0 + i
    whole = found(spark, series("h", views))
    assert found(spark, series("h", views), shard_rows=100, halo=20) == whole == {(i, "views", "outlier") for i in (50, 199, 200, 201, 333)}


def test_runs_across_shards_are_judged_whole(spark):
    # The reviewer's case: 10 counts of true movement over 200 equal readings; then runs over several whole shards, at
    # the end of the series, with one jump of the others, and of a source that only as a whole counts as rounded.
    def source(name, views, others, first_id):
        return [(first_id + i, name, T0 + i * HOUR, float(v), 5.0, *(float(o + k) for k in range(5)), "x") for i, (v, o) in enumerate(zip(views, others))]

    grow, n = [1000 + i // 20 for i in range(600)], 600
    cases = {
        "crossing": ([v if not 200 <= i < 400 else 1010 for i, v in enumerate(grow)], [1000 + i // 20 for i in range(n)]),
        "long": ([1000 + 3 * min(i, 110) if i < 480 else 1000 + 3 * i for i in range(n)], [1000 + 3 * i for i in range(n)]),
        "open": ([1000 + 3 * min(i, 180) for i in range(n)], [1000 + 3 * i for i in range(n)]),
        "jump": ([1000 + 3 * min(i, 180) for i in range(n)], [1000 + 3 * min(i, 180) + (900 if i > 420 else 0) for i in range(n)]),
        "rounded": ([(20_000 + 13 * i) // 100 * 100 if i > 50 else 20_001 + 13 * i for i in range(n)], [20_000 + 13 * i for i in range(n)]),
    }
    rows = [r for k, (name, (v, o)) in enumerate(cases.items()) for r in source(name, v, o, 1000 * k)]
    whole = found(spark, rows)
    assert {r // 1000 for r, m, kind in whole if (m, kind) == ("views", "stuck")} == {0, 1, 2} and len(whole) > 600
    assert found(spark, rows, shard_rows=100, halo=20) == whole == found(spark, rows, shard_rows=250, halo=64)


def test_shards_cover_rows_once(spark):
    rows = spark.createDataFrame([("h", i, i) for i in range(1000)] + [("c", 1, 1)], "source string, at long, v int")
    s = shard_by_time(rows, 100, 3)
    assert s.where("not halo").count() == 1001 and s.where("source = 'c' and shard = 0").count() == 1
    own = {r.shard: (r.a, r.b) for r in s.where("not halo and source = 'h'").groupBy("shard").agg(F.min("at").alias("a"), F.max("at").alias("b")).collect()}
    halo = {r.shard: sorted(x.at for x in s.where(f"halo and shard = {r.shard}").collect()) for r in s.select("shard").distinct().collect()}
    assert len(own) == 10
    for k, (a, b) in own.items():
        assert halo[k] == ([a - 3, a - 2, a - 1] if k else []) + ([b + 1, b + 2, b + 3] if k < 9 else [])


def _pchip(t, v, x):
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    m = np.empty(len(t))
    m[0], m[-1] = d[0], d[-1]
    for k in range(1, len(t) - 1):
        w0, w1 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
        m[k] = 0 if d[k - 1] * d[k] <= 0 else (w0 + w1) / (w0 / d[k - 1] + w1 / d[k])
    k = np.clip(np.searchsorted(t, x, "right") - 1, 0, len(t) - 2)
    s = (x - t[k]) / h[k]
    return (2 * s**3 - 3 * s**2 + 1) * v[k] + (s**3 - 2 * s**2 + s) * h[k] * m[k] + (3 * s**2 - 2 * s**3) * v[k + 1] + (s**3 - s**2) * h[k] * m[k + 1]


@pytest.mark.parametrize("shard_rows", [10_000, 7])
def test_grid_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(2)
    at = np.sort(rng.choice(np.arange(40 * HOUR // 1000), 60, replace=False)) * 1000 + T0 + 500_000
    views = np.cumsum(rng.integers(0, 50, 60)).astype(float)
    rows = [(i, "g", int(t), float(v), *([None] * 6), "x") for i, (t, v) in enumerate(zip(at, views))]
    got = {r.slot_ms: r for r in regular_grid(spark.createDataFrame(rows, READING), long_gap_ms=10**12, shard_rows=shard_rows).collect()}
    slots = np.arange(at[0] // HOUR, at[-1] // HOUR + 1) * HOUR
    assert sorted(got) == slots.tolist()
    inside = slots[slots >= at[0]]
    assert [got[s].views for s in inside.tolist()] == pytest.approx(_pchip(at.astype(float), views, inside.astype(float)).tolist(), abs=1e-6)
    assert all(got[s].n_readings == int(((at // HOUR) == s // HOUR).sum()) for s in slots.tolist()) and got[slots[0]].views is None
    assert np.all(np.diff([got[s].views for s in inside.tolist()]) >= -1e-9)  # shape is kept


def test_grid_gaps_and_cases(spark):
    rows = [(1, "a", T0, 10.0, *([None] * 6), "x"), (2, "a", T0 + 3 * HOUR, 40.0, *([None] * 6), "x"), (3, "a", T0 + 40 * HOUR, 50.0, *([None] * 6), "x"),
            (4, "a", T0 + 41 * HOUR, *([None] * 7), "x"), (5, "b", T0 + 5, None, 7.0, *([None] * 5), "x"), (6, "c", None, 1.0, *([None] * 6), "x"), (7, "a", T0, 20.0, *([None] * 6), "x")]
    got = regular_grid(spark.createDataFrame(rows, READING))
    a = {(r.slot_ms - T0) // HOUR: r for r in got.where("source = 'a'").collect()}
    assert sorted(a) == list(range(41)) and (a[0].views, a[3].views, a[40].views) == (15.0, 40.0, 50.0)  # equal times: mean
    assert [a[i].status for i in (0, 1, 2, 3, 4, 39, 40)] == ["read", "filled", "filled", "read", "gap", "gap", "read"]
    assert 15 < a[1].views < a[2].views < 40 and a[4].views is None
    assert [(r.slot_ms, r.likes) for r in got.where("source = 'b'").collect()] == [(T0, None)]
    assert got.where("source = 'c'").count() == 0 and regular_grid(spark.createDataFrame([], READING)).count() == 0


def test_snapshot_readings(spark):
    kind = "snapshot_id long, bvid string, capturedAt long, stats struct<views:double,likes:double,favorites:double,coins:double,replies:double,danmaku:double,shares:double>, received_at timestamp_ntz"
    import datetime as dt

    when = dt.datetime(2026, 9, 1)
    ms = 1_788_220_800_000
    s = (1.0, 2.0, None, None, None, None, None)
    rows = [(1, "a", ms - 5, s, when), (1, "a", ms - 5, s, when + dt.timedelta(days=1)), (2, "a", (ms - 5000) // 1000, s, when), (3, "a", ms + 1, s, when), (4, "a", 0, None, when), (5, None, ms, s, when), (None, "a", ms, s, when), (6, "a", None, s, when)]
    got = {r.reading: (r.at, r.views) for r in snapshot_readings(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (ms - 5, 1.0), 2: (ms - 5000, 1.0), 3: (None, 1.0), 4: (None, None), 6: (None, 1.0)}


def test_p2_found_interpolates(spark, tmp_path):
    from sift.plans.quality import p2_found

    stats = "named_struct('views', {0}D, 'likes', 1D, 'favorites', 1D, 'coins', 1D, 'replies', 1D, 'danmaku', 1D, 'shares', 1D)"
    row = "select {0}L as snapshot_id, 'a' as bvid, {1}L as capturedAt, " + stats + " as stats, timestamp_ntz'2030-01-01 00:00:00' as received_at"
    spark.sql(" union all ".join(row.format(i, T0 + h * HOUR) for i, h in enumerate((0, 3, 30, 31)))).write.parquet(f"{tmp_path}/snapshots.parquet")
    found_ = p2_found(spark, str(tmp_path))
    assert sorted((r.slot_ms - T0) // HOUR for r in found_.collect()) == [1, 2, *range(4, 30)]
    assert "FlatMapGroupsInPandas" in found_._jdf.queryExecution().optimizedPlan().toString()  # the solver isn't pruned away


def test_grid_shards_see_far_readings(spark):
    # likes are known only at the far ends, over many shards; and a stretch of a long gap is in pieces
    n, none = 300, [None] * 5
    rows = [(i, "h", T0 + i * HOUR // 3, float(i), 5.0 if i == 0 else 95.0 if i == n - 1 else None, *none, "x") for i in range(n)]
    rows += [(n, "g", T0, 1.0, None, *none, "x"), (n + 1, "g", T0 + 10_000 * HOUR, 2.0, None, *none, "x"), (n + 2, "g", T0 + 10_000 * HOUR + 1, float("nan"), None, *none, "x")]
    grids = [{(r.source, r.slot_ms): tuple(r) for r in regular_grid(spark.createDataFrame(rows, READING), long_gap_ms=200 * HOUR, shard_rows=k).collect()} for k in (10_000, 20)]
    assert grids[0] == grids[1] and len(grids[0]) == 100 + 10_001
    likes = [grids[0]["h", T0 + h * HOUR][5] for h in range(100)]
    assert likes[0] == 5.0 and all(a < b for a, b in zip(likes, likes[1:])) and likes[50] == pytest.approx(5 + 90 * 150 / 299)
    assert {grids[0]["g", T0 + h * HOUR][3] for h in range(1, 10_000)} == {"gap"} and grids[0]["g", T0 + 10_000 * HOUR][2] == 2


def test_shards_of_shards(spark, monkeypatch):
    from sift.operators import readings

    monkeypatch.setattr(readings, "PARTS", 4)  # so that a source must be cut again and again
    rows = spark.createDataFrame([("h", i, i) for i in range(200)], "source string, at long, v int")
    s = shard_by_time(rows, 10, 1)
    own = s.where("not halo").groupBy("shard").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n")).orderBy("shard").collect()
    assert [r.shard for r in own] == list(range(len(own))) and max(r.n for r in own) <= 20 and sum(r.n for r in own) == 200
    assert all(x.b + 1 == y.a for x, y in zip(own, own[1:])) and s.where("halo").count() == 2 * (len(own) - 1)



"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.operators.grid import regular_grid
from sift.operators.readings import METRICS, snapshot_readings
from sift.operators.spikes import flag_spikes
from sift.session import cut


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return cut(snapshot_readings(spark.read.parquet(f"{d}/snapshots.parquet")))


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_spikes(_readings(spark, d), ["views", "likes"]).withColumnRenamed("reading", "snapshot_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).select("snapshot_id", "metric")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid, its values rounded to thousandths."""
    grid = regular_grid(_readings(spark, d))
    return grid.select(F.col("source").alias("bvid"), "slot_ms", "n_readings", "status", *(F.round(m, 3).alias(m) for m in METRICS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_grid(spark, d).where(F.col("status") != "read").select("bvid", "slot_ms")


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p2_found": p2_found, "p2_grid": p2_grid}

_READINGS = """
WITH raw AS (
  SELECT snapshot_id, bvid, stats, epoch_us(received_at) // 1000 AS received,
         CASE WHEN capturedAt > 0 THEN CASE WHEN capturedAt < 10000000000 THEN capturedAt * 1000 ELSE capturedAt END END AS t
  FROM snapshots WHERE snapshot_id IS NOT NULL AND bvid IS NOT NULL),
one AS (SELECT snapshot_id, any_value(bvid) AS bvid, any_value(stats) AS stats, any_value(t) AS t, min(received) AS received FROM raw GROUP BY snapshot_id),
usable AS (
  SELECT bvid, t // 3600000 AS slot FROM one WHERE t <= received
  AND coalesce(stats.views, stats.likes, stats.favorites, stats.coins, stats.replies, stats.danmaku, stats.shares) IS NOT NULL),
"""

_SLOPE = """CASE WHEN {d0} IS NULL THEN {d1} WHEN {d1} IS NULL THEN {d0} WHEN {d0} * {d1} <= 0 THEN 0
    ELSE 3 * ({h0} + {h1}) / ((2 * {h1} + {h0}) / {d0} + ({h1} + 2 * {h0}) / {d1}) END"""

_GRID = (
    _READINGS
    + f"""
means AS (SELECT bvid, t, {", ".join(f"avg(stats.{m}) AS {m}" for m in METRICS)} FROM one WHERE t <= received AND coalesce({", ".join(f"stats.{m}" for m in METRICS)}) IS NOT NULL GROUP BY bvid, t),
known AS ({" UNION ALL ".join(f"SELECT bvid, '{m}' AS metric, t, {m} AS v FROM means WHERE {m} IS NOT NULL" for m in METRICS)}),
near AS (SELECT bvid, metric, t, v, t - lag(t) OVER w AS h0, (v - lag(v) OVER w) / (t - lag(t) OVER w) AS d0, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM known WINDOW w AS (PARTITION BY bvid, metric ORDER BY t)),
secant AS (SELECT *, nt - t AS h1, (nv - v) / (nt - t) AS d1 FROM near),
slope AS (SELECT *, {_SLOPE.format(h0="h0", d0="d0", h1="h1", d1="d1")} AS m FROM secant),
spans AS (SELECT bvid, metric, t, v, nt, nv, m AS m0, lead(m) OVER (PARTITION BY bvid, metric ORDER BY t) AS m1 FROM slope),
span AS (SELECT bvid, min(slot) AS a, max(slot) AS b FROM usable GROUP BY bvid),
grid AS (SELECT bvid, unnest(range(a, b + 1)) AS slot FROM span),
n AS (SELECT bvid, slot, count(*) AS n FROM usable GROUP BY bvid, slot),
wanted AS (SELECT bvid, slot, slot * 3600000 AS s, metric FROM grid CROSS JOIN (SELECT unnest([{", ".join(f"'{m}'" for m in METRICS)}]) AS metric)),
found AS (SELECT w.bvid, w.slot, w.metric, p.*, (w.s - p.t) / (p.nt - p.t) AS x, w.s FROM wanted w ASOF JOIN spans p ON w.bvid = p.bvid AND w.metric = p.metric AND w.s >= p.t),
curve AS (
  SELECT bvid, slot, metric, CASE WHEN s = t THEN v WHEN nt - t <= 43200000 THEN greatest(least(
    (2 * x ** 3 - 3 * x ** 2 + 1) * v + (x ** 3 - 2 * x ** 2 + x) * (nt - t) * m0 + (3 * x ** 2 - 2 * x ** 3) * nv + (x ** 3 - x ** 2) * (nt - t) * m1,
    greatest(v, nv)), least(v, nv)) END AS y FROM found),
wide AS (SELECT bvid, slot, {", ".join(f"round(max(y) FILTER (metric = '{m}'), 3) AS {m}" for m in METRICS)} FROM curve GROUP BY bvid, slot)
SELECT g.bvid, g.slot * 3600000 AS slot_ms, coalesce(n.n, 0) AS n_readings,
  CASE WHEN n.n > 0 THEN 'read' WHEN coalesce({", ".join(METRICS)}) IS NOT NULL THEN 'filled' ELSE 'gap' END AS status, {", ".join(METRICS)}
FROM grid g LEFT JOIN n USING (bvid, slot) LEFT JOIN wide USING (bvid, slot)"""
)

ORACLES = {
    "p2_grid": _GRID,
    "p2_found": _READINGS
    + """
span AS (SELECT bvid, min(slot) AS a, max(slot) AS b FROM usable GROUP BY bvid),
grid AS (SELECT bvid, unnest(range(a, b + 1)) AS slot FROM span)
SELECT g.bvid AS bvid, g.slot * 3600000 AS slot_ms FROM grid g ANTI JOIN usable u ON g.bvid = u.bvid AND g.slot = u.slot
""",
}

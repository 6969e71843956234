"""Irregular readings onto a regular grid by shape-preserving monotone cubic interpolation.

Between two neighbouring readings of a metric the curve is the cubic Hermite with Fritsch-Carlson (weighted harmonic)
slopes, which needs one reading more on either side.  Readings meet in one exchange by source, all metrics in one row;
a source with very many readings is cut into time shards, which exchange halo readings: of each metric the two known
last before and first after the shard, however far away they are.  Gaps longer than a limit are marked, not filled, and
leave the solver as one row a stretch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.functions.time import HOUR_MS
from sift.operators.readings import METRICS, largest_source, shard_by_time

#: Readings of one source in a shard; readings of a task.
SHARD_ROWS, TASK_ROWS = 20_000, 40_000
#: Slots further than this between readings stay unfilled.
LONG_GAP_MS = 12 * HOUR_MS
#: Slots of one row of a long gap.
STRETCH = 4096


def _slopes(t: np.ndarray, v: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Slope of the curve at each reading; at an end of a segment the secant of the only interval."""
    h = np.diff(t).astype(float)
    h[seg[1:] != seg[:-1]] = np.nan
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.diff(v) / h
        h0, h1, d0, d1 = np.append(np.nan, h), np.append(h, np.nan), np.append(np.nan, d), np.append(d, np.nan)
        w0, w1 = 2 * h1 + h0, h1 + 2 * h0
        inner = np.where(d0 * d1 <= 0, 0.0, (w0 + w1) / (w0 / d0 + w1 / d1))
    return np.where(np.isnan(h0), d1, np.where(np.isnan(h1), d0, inner))


def _values(at: np.ndarray, v: np.ndarray, seg: np.ndarray, row: np.ndarray, when: np.ndarray, of: np.ndarray, limit: int) -> np.ndarray:
    """The curve of one metric at times `when` of segments `of`; row: the last reading of any metric not after it, or
    -1. NaN where the metric has no reading on a side within the limit."""
    out = np.full(len(when), np.nan)
    some = np.flatnonzero(~np.isnan(v))
    if not len(some):
        return out
    t, v, s = at[some], v[some], seg[some]
    slope = _slopes(t, v, s)
    a = np.searchsorted(some, row, "right") - 1  # the metric's last reading not after the time
    a0 = np.maximum(a, 0)
    b = np.minimum(a0 + 1, len(some) - 1)
    here = (a >= 0) & (row >= 0) & (s[a0] == of)
    exact = here & (t[a0] == when)
    out[exact] = v[a0[exact]]
    k = np.flatnonzero(here & ~exact & (b > a0) & (s[b] == of) & (t[b] - t[a0] <= limit))
    p, q = a0[k], b[k]
    h = (t[q] - t[p]).astype(float)
    x = (when[k] - t[p]) / h
    y = (2 * x**3 - 3 * x**2 + 1) * v[p] + (x**3 - 2 * x**2 + x) * h * slope[p] + (3 * x**2 - 2 * x**3) * v[q] + (x**3 - x**2) * h * slope[q]
    out[k] = np.clip(y, np.minimum(v[p], v[q]), np.maximum(v[p], v[q]))
    return out


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of all whole numbers of ranges; empty where last < first."""
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def one_a_time(at: np.ndarray, seg: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each time of each segment, mean of the known values at that time)."""
    starts = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(seg) != 0))) if len(at) else np.zeros(0, int)
    if len(starts) == len(at):
        return starts, values
    known = np.add.reduceat(~np.isnan(values), starts, axis=0)
    with np.errstate(invalid="ignore"):
        return starts, np.where(known > 0, np.add.reduceat(np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf), starts, axis=0) / known, np.nan)


def solve(at: np.ndarray, seg: np.ndarray, values: np.ndarray, halo: np.ndarray, step: int, limit: int) -> tuple[np.ndarray, ...]:
    """(segment, first slot, last slot, readings, values) of the slots that segments own, in rows of one slot or of a
    stretch of a long gap. Readings are in order of segment and time."""
    starts, values = one_a_time(at, seg, values)
    many = np.diff(np.append(starts, len(at)))
    at, seg, halo = at[starts], seg[starts], halo[starts]
    slot = at // step
    new = np.append(True, (np.diff(slot) != 0) | (np.diff(seg) != 0)) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    n = np.add.reduceat(many, first) if len(first) else many
    own, n = first[~halo[first]], n[~halo[first]]
    same = lambda a, b: (b >= 0) & (b < len(at)) & (seg[a] == seg[np.clip(b, 0, max(len(at) - 1, 0))])
    row = np.where(at[own] == slot[own] * step, own, np.where(same(own, own - 1), own - 1, -1))
    end = np.flatnonzero(~halo & np.append(new[1:], True)) if len(at) else own
    end = end[same(end, end + 1)]
    short = at[end + 1] - at[end] <= limit if len(end) else np.zeros(0, bool)
    which, filled = _ranges(slot[end[short]] + 1, slot[end[short] + 1] - 1) if len(end) else (own[:0], own[:0])
    gaps = end[~short]
    pieces, piece = _ranges(np.zeros(len(gaps), int), -(-(slot[gaps + 1] - slot[gaps] - 1) // STRETCH) - 1) if len(gaps) else (own[:0], own[:0])
    low = slot[gaps[pieces]] + 1 + piece * STRETCH
    high = np.minimum(low + STRETCH - 1, slot[gaps[pieces] + 1] - 1) if len(gaps) else low
    by = np.concatenate([own, end[short][which]]).astype(int)
    one = np.concatenate([slot[own], filled])
    rows = np.concatenate([row, end[short][which]]).astype(int)
    curves = np.stack([_values(at, v, seg, rows, one * step, seg[by], limit) for v in values.T], axis=1)
    empty = np.full((len(low), values.shape[1]), np.nan)
    return (
        np.concatenate([seg[by], seg[gaps[pieces]]]), np.concatenate([one, low]), np.concatenate([one, high]),
        np.concatenate([n, np.zeros(len(filled) + len(low), int)]), np.concatenate([curves, empty]),
    )


def _halo(sharded: DataFrame, metrics: list[str]) -> DataFrame:
    """The halo rows of shards (source, shard, at, <metrics>): of each metric the two known readings before and after."""
    kind = sharded.schema["source"].dataType.simpleString()

    def tell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable", ignore_index=True)
        starts, values = one_a_time(pdf["at"].to_numpy(), np.zeros(len(pdf), int), pdf[metrics].to_numpy(float))
        at = pdf["at"].to_numpy()[starts]
        parts = [pd.DataFrame({"k": -1, "at": at[[0]], "v": 0.0, "n": 1})]  # that there is a reading, whatever it says
        for k, v in enumerate(values.T):
            some = np.flatnonzero(~np.isnan(v))
            some = np.unique(np.append(some[:2], some[-2:]))
            parts.append(pd.DataFrame({"k": k, "at": at[some], "v": v[some], "n": 1}))
        return pd.concat(parts).assign(source=key[0], shard=key[1])[["source", "shard", "k", "at", "v"]]

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shards, out = np.sort(pdf["shard"].unique()), []
        for k, rows in pdf.groupby("k"):
            rows = rows.sort_values("at", kind="stable")
            shard, at, v = rows["shard"].to_numpy(), rows["at"].to_numpy(), rows["v"].to_numpy()
            before, after = np.searchsorted(shard, shards, "left"), np.searchsorted(shard, shards, "right")
            for j in (before - 2, before - 1, after, after + 1):
                ok = (j >= 0) & (j < len(at)) & ((j >= after) | (k >= 0))
                out.append(pd.DataFrame({"shard": shards[ok], "at": at[j[ok]], **{m: v[j[ok]] if i == k else np.nan for i, m in enumerate(metrics)}}))
        return pd.concat(out).assign(source=key[0])[["source", "shard", "at", *metrics]]

    told = sharded.groupBy("source", "shard").applyInPandas(tell, f"source {kind}, shard int, k int, at long, v double")
    return told.groupBy("source").applyInPandas(chain, f"source {kind}, shard int, at long, " + ", ".join(f"{m} double" for m in metrics))


def regular_grid(
    readings: DataFrame, metrics: list[str] = METRICS, step_ms: int = HOUR_MS, long_gap_ms: int = LONG_GAP_MS, shard_rows: int = SHARD_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(source, slot_ms, n_readings, status, <metrics>): one row per source and slot of step_ms, from the slot of the
    source's first usable reading to that of its last.

    A reading is usable if its source and time are known and one metric at least isn't NULL. Values are those at the
    slot's start: a reading taken exactly then, else interpolated between the metric's readings around it (readings at
    one time count as their mean, NaN as unknown), else NULL: before the metric's first or after its last reading, or
    within a gap longer than long_gap_ms. status: 'read' (readings in the slot), 'filled' (none, but a metric at least
    has readings on both sides within the limit), 'gap' (none, and no metric could be filled). Extra columns are
    ignored; an empty table gives an empty grid. readings is read more than once."""
    some = F.coalesce(*(F.col(m) for m in metrics)).isNotNull()
    usable = readings.where(F.col("source").isNotNull() & F.col("at").isNotNull() & some).select("source", "at", *(F.col(m).cast("double").alias(m) for m in metrics))
    total, most = largest_source(usable)
    if most > shard_rows:  # slots aren't divided between shards
        sharded = shard_by_time(usable.withColumn("_at", F.col("at")).withColumn("at", F.floor(F.col("at") / step_ms)), shard_rows, 0, most)
        sharded = sharded.select("source", "shard", F.col("_at").alias("at"), *metrics)
        rows = sharded.withColumn("halo", F.lit(False)).unionByName(_halo(sharded, metrics).withColumn("halo", F.lit(True)))
    else:
        rows = usable.withColumns({"shard": F.lit(0), "halo": F.lit(False)})
    rows = rows.withColumn("_task", F.pmod(F.xxhash64("source", "shard"), F.lit(max(1, -(-total // task_rows)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "shard", "at"], kind="stable", ignore_index=True)
        new = ((pdf["source"] != pdf["source"].shift()) | (pdf["shard"] != pdf["shard"].shift())).to_numpy()
        seg, first, last, n, values = solve(pdf["at"].to_numpy(), np.cumsum(new) - 1, pdf[metrics].to_numpy(float), pdf["halo"].to_numpy(bool), step_ms, long_gap_ms)
        out = pd.DataFrame(values, columns=metrics)
        out.insert(0, "source", pdf["source"].to_numpy()[np.flatnonzero(new)][seg])
        return out.assign(first=first, last=last, n=n)

    schema = f"source {usable.schema['source'].dataType.simpleString()}, " + ", ".join(f"{m} double" for m in metrics) + ", first long, last long, n long"
    solved = rows.groupBy("_task").applyInPandas(run, schema)
    status = F.when(F.col("n") > 0, "read").when(F.coalesce(*(F.col(m) for m in metrics)).isNotNull(), "filled").otherwise("gap")
    slots = solved.withColumn("slot", F.explode(F.sequence("first", "last")))
    return slots.select("source", (F.col("slot") * step_ms).alias("slot_ms"), F.col("n").alias("n_readings"), status.alias("status"), *metrics)

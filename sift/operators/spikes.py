"""Implausible readings of counters, judged against the same source's normal behaviour.

1. Each source's readings are put in order of time.  A source with very many readings is cut into time shards at
   quantiles of its own times; neighbouring shards exchange halo readings, so no task holds a whole hot source. Runs of
   equal values that cross shards are chained through all of them, so they are judged as in one piece.
2. Per source and metric, deviations from neighbouring readings and rates of change per hour go into quantile sketches,
   bucketed by hour of day: counts in logarithmic bins (1 % wide), which merge by adding - buckets into the whole day,
   shards into the source.  Interquartile ranges are the source's normal spread.
3. A reading is flagged when it leaves the expanded fences on the same side of the readings before and after it (a
   passing outlier; a change that lasts leaves only one side), when at an end of the series its change outruns what the
   source's own rates allow in the time elapsed, when it repeats a value while the source's other metrics show that the
   counter moved on (zero variance), or when no counter can have the number.

All readings of a task are judged together, source by source only where a run of repeats is suspicious.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.functions.time import HOUR_MS
from sift.operators.readings import METRICS, largest_source, shard_by_time
from sift.session import cut

#: Readings of one source that one shard may hold, halo readings from each side, readings per task.
SHARD_ROWS, HALO, TASK_ROWS = 20_000, 64, 40_000
#: Fences in interquartile ranges; least log deviation; widths of neighbourhoods.
FENCE, LEAST, WIDTHS = 4.0, 0.02, (3, 5)
#: Least log deviation at an end of a series: against other metrics that stay put (and for a high first or low last
#: reading), and against others that move along, for a high last reading. There a low first reading is how counters start.
END_ALONE, END_ALONG = 0.5, 2.3
#: Expanded fence of rates of change, in interquartile ranges beyond the upper quartile.
RATE_FENCE = 8.0
#: Hours of a bucket of the day, and deviations in it from which its own sketch counts.
BUCKET_HOURS, BUCKET_LEAST = 6, 12
SLOTS = 24 // BUCKET_HOURS
#: Repeats that make a run; log odds from which few counts of other metrics prove that a run is stuck.
LEAST_REPEATS, LEAST_ODDS = 2, 9.0
#: A source varies from reading to reading if its spread is so many counts (or units, if it rounds).
VARIES = 5.0
#: No counter reaches this.
TOO_LARGE = 1e12
#: Share of the readings that must be round for a source to count as rounded.
ROUNDED_SHARE = 0.9
#: Sketches: ratio of neighbouring bins, least magnitude told from zero, room for bins.
BIN_RATIO, BIN_LEAST, BIN_ROOM = 1.02, 1e-7, 8192


def sketch(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantile sketch of each group: (group and bin in one number, count). Sketches merge by adding counts."""
    with np.errstate(divide="ignore"):
        size = np.ceil(np.log(np.abs(values) / BIN_LEAST) / np.log(BIN_RATIO))
    bins = np.sign(values) * np.clip(size, 0, BIN_ROOM // 2 - 1)
    return np.unique(group.astype(np.int64) * BIN_ROOM + bins.astype(np.int64) + BIN_ROOM // 2, return_counts=True)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    return keys[at], np.add.reduceat(counts, at)


def quartiles(keys: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """groups x (lower quartile, upper quartile, number); NaN quartiles of groups without values."""
    out = np.full((groups, 3), np.nan)
    out[:, 2] = 0
    if not len(keys):
        return out
    group, bins = keys // BIN_ROOM, keys % BIN_ROOM - BIN_ROOM // 2
    value = np.sign(bins) * BIN_LEAST * BIN_RATIO ** (np.abs(bins) - 0.5)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    total = np.add.reduceat(counts, starts)
    up_to = np.cumsum(counts)
    before = up_to[starts] - counts[starts]
    for k, q in enumerate((0.25, 0.75)):
        out[group[starts], k] = value[np.searchsorted(up_to, before + np.maximum(np.ceil(q * total), 1))]
    out[group[starts], 2] = total
    return out


def _shifted(x: np.ndarray, seg: np.ndarray, k: int) -> np.ndarray:
    """The value k places before (after, if negative) in the same segment, else NaN."""
    out = np.full(len(x), np.nan)
    if 0 < abs(k) < len(x):
        here, there = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
        out[here] = np.where(seg[here] == seg[there], x[there], np.nan)
    return out


def _median(columns: list[np.ndarray]) -> np.ndarray:
    """Row medians of the known values; NaN without any."""
    rows = np.sort(np.stack(columns, axis=1), axis=1)  # NaN last
    n = rows.shape[1] - np.isnan(rows).sum(axis=1)
    at = np.arange(len(rows))
    return (rows[at, np.maximum((n - 1) // 2, 0)] + rows[at, n // 2 * (n > 0)]) / 2


def _unit(v: np.ndarray, digits: int) -> np.ndarray:
    """The unit of each value's last digit if that many digits are kept, tens or more."""
    return np.maximum(10.0, 10.0 ** (np.floor(np.log10(np.maximum(v, 1.0))) + 1 - digits))


def _unit_of(v: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """The unit to which each value is rounded, by kept_digits; 1 where it isn't."""
    unit = np.where(digits > 0, _unit(v, np.where(digits > 0, digits, 2)), 10.0 ** np.maximum(-digits, 0))
    return np.where(digits == 0, 1.0, unit)


def round_counts(v: np.ndarray, seg: np.ndarray | None = None, segs: int = 1) -> np.ndarray:
    """Segments x (how many values could be rounded, how many have two and three digits, how many are multiples of 10,
    100, 1000 and 10000); parts of a source add up."""
    some = v >= 10
    v, seg = v[some], (np.zeros(len(v), int) if seg is None else seg)[some]
    units = [_unit(v, 2), _unit(v, 3), 10.0, 100.0, 1e3, 1e4]
    return np.stack([np.bincount(seg, minlength=segs), *(np.bincount(seg, np.mod(v, u) == 0, segs) for u in units)], axis=1).astype(int)


def kept_digits(counts: np.ndarray) -> np.ndarray:
    """How each segment rounds, by its round_counts: to so many digits (2 or 3), to a power of ten (minus its exponent),
    or not at all (0)."""
    counts = np.atleast_2d(counts)
    enough = (counts[:, :1] >= 4) & (counts[:, 1:] >= ROUNDED_SHARE * np.maximum(counts[:, :1], 1))
    return np.where(enough[:, 0], 2, np.where(enough[:, 1], 3, -enough[:, 2:].sum(axis=1)))


@dataclass
class Normal:
    """What is normal for each segment and metric. spread: segments x metrics x (whole day, then each bucket), the
    interquartile range of log deviations, 0 where unknown; rate: the same of the fastest plausible log change an hour,
    infinite where unknown; digits: segments x metrics, as of kept_digits."""

    spread: np.ndarray
    rate: np.ndarray
    digits: np.ndarray


def bucket_of(at: np.ndarray) -> np.ndarray:
    return at % (24 * HOUR_MS) // (BUCKET_HOURS * HOUR_MS)


def told_sketches(values: np.ndarray, at: np.ndarray, seg: np.ndarray, own: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per metric the sketches of log deviations and of rates. Groups are segment x bucket. own: readings that count
    (a shard's halo readings count in the shard that owns them)."""
    out, bucket = [], bucket_of(at)
    for v in values.T:
        some = np.flatnonzero(_possible(v))
        x, s, t = np.log1p(v[some]), seg[some], at[some]
        group = s * SLOTS + bucket[some]
        with np.errstate(invalid="ignore", divide="ignore"):
            four = np.sort(np.stack([_shifted(x, s, k) for k in (2, 1, -1, -2)], axis=1), axis=1)
            off = x - (four[:, 1] + four[:, 2]) / 2
            rate = (x - _shifted(x, s, 1)) / (np.maximum(t - _shifted(t.astype(float), s, 1), 60_000.0) / HOUR_MS)
        off[np.isnan(four[:, 3])] = np.nan
        out.append([sketch(group[k], y[k]) for y in (off, rate) for k in [~np.isnan(y) & own[some]]])
    return out


def normal(told: list, segs: int, digits: np.ndarray) -> Normal:
    """From the sketches of told_sketches, merged over shards."""
    spread, rate = np.zeros((segs, len(told), 1 + SLOTS)), np.full((segs, len(told), 1 + SLOTS), np.inf)
    for k, both in enumerate(told):
        for which, (keys, counts) in enumerate(both):
            day = merged(keys // BIN_ROOM // SLOTS * BIN_ROOM + keys % BIN_ROOM, counts)
            for table, at in ((quartiles(*day, segs)[:, None], slice(0, 1)), (quartiles(keys, counts, segs * SLOTS).reshape(segs, SLOTS, 3), slice(1, None))):
                known = table[:, :, 2] >= (1 if at.start == 0 else BUCKET_LEAST)
                width = table[:, :, 1] - table[:, :, 0]
                if which == 0:
                    spread[:, k, at] = np.where(known, width, 0.0)
                else:
                    rate[:, k, at] = np.where(known, np.maximum(table[:, :, 1] + RATE_FENCE * width, 0.0), np.inf)
    return Normal(spread, rate, digits)


def _beyond(
    y: np.ndarray, at: np.ndarray, seg: np.ndarray, spread: np.ndarray, own_floor: np.ndarray, digits: np.ndarray, rate: np.ndarray, along: np.ndarray,
    least: float,
) -> np.ndarray:
    """Which log values leave the fences on the same side of the medians before and after them."""
    hit = np.zeros(len(y), bool)
    near = {k: _shifted(y, seg, k) for w in range(1, max(WIDTHS) + 1) for k in (w, -w)}
    first, last = np.isnan(near[1]), np.isnan(near[-1])
    times = at.astype(float)
    with np.errstate(invalid="ignore"):
        hours = np.where(last, times - _shifted(times, seg, 1), _shifted(times, seg, -1) - times) / HOUR_MS
        outrun = np.maximum(END_ALONE, np.where(first | last, rate * hours, 0.0))
    over_least = np.where(last, np.where(along, np.maximum(END_ALONG, outrun), outrun), np.where(first, END_ALONE, least))
    under_least = np.where(first, np.where(along, np.inf, outrun), np.where(last, END_ALONE, least))
    for width in WIDTHS:
        before, after = (_median([near[sign * k] for k in range(1, width + 1)]) for sign in (1, -1))
        before, after = np.where(first, after, before), np.where(last, before, after)
        low, high = np.minimum(before, after), np.maximum(before, after)
        end = np.where(first, near[-1], near[1])  # the only neighbour of an end
        low, high = np.where(first | last, np.fmin(low, end), low), np.where(first | last, np.fmax(high, end), high)
        level = np.exp(low)
        with np.errstate(invalid="ignore"):
            step = _unit_of(level - 1, digits) / level  # of the level, not of the reading: it may be 0
            over_fence = FENCE * np.maximum(1.0 / level, np.maximum(spread, own_floor))
            under_fence = FENCE * np.maximum(step, spread)
            hit |= (y - high > np.maximum(np.maximum(over_least, least), over_fence)) | (low - y > np.maximum(np.maximum(under_least, least), under_fence))
    return hit


def outliers(v: np.ndarray, at: np.ndarray, seg: np.ndarray, spread: np.ndarray, rate: np.ndarray, digits: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Passing outliers among possible values in order of segment and time.

    Of each value: spread, the segment's interquartile range of log deviations; rate, its fastest plausible log change
    an hour; digits, to which it rounds; along: whether other metrics move along with it. Coarse deviations are taken
    out first, so that they don't bend the neighbours' medians. Segments of under four values have no outliers."""
    x, bad = np.log(v + 1.0), np.zeros(len(v), bool)
    spread = np.maximum(spread, 0.002)
    floor = _unit_of(v, digits) / (v + 1.0)

    def beyond(keep: np.ndarray, least: float) -> np.ndarray:
        keep = keep[np.bincount(seg[keep], minlength=int(seg[-1]) + 1 if len(seg) else 0)[seg[keep]] >= 4]
        return keep[_beyond(x[keep], at[keep], seg[keep], spread[keep], floor[keep], digits[keep], rate[keep], along[keep], least)]

    some = beyond(np.arange(len(v)), LEAST)
    if len(some):
        suspicious = np.isin(seg, np.unique(seg[some]))
        for least in (1.0, 0.3, 0.1, LEAST):
            bad[beyond(np.flatnonzero(suspicious & ~bad), least)] = True
    return bad


def progress(start: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Growth of the other metrics since the start of a run, absolute and relative, at each of the readings."""
    o, start = others[:, ~np.isnan(start)], start[~np.isnan(start)]
    grown = np.where(np.isnan(o), 0.0, o - start).sum(axis=1)
    known = np.where(np.isnan(o), 0.0, start).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return grown, np.maximum(np.where(known > 0, grown / known, 0.0), 0.0)


def extent(start: np.ndarray, others: np.ndarray) -> list:
    """[repeats, greatest relative progress, its largest step as (from, to), growth at the end] over repeats of a run."""
    grown, relative = progress(start, others)
    if not len(relative):
        return [0, 0.0, 0.0, 0.0, 0.0]
    top = np.concatenate([[0.0], np.maximum.accumulate(relative)])
    k = int(np.argmax(np.diff(top)))
    return [len(relative), float(top[-1]), float(top[k]), float(top[k + 1]), float(grown[-1])]


def joined(one: list, two: list) -> list:
    """Extent of a run from those of two parts. A step of over half of the whole is the largest of its part, so the
    largest step is exact wherever it matters."""
    low, high = max(two[2], one[1]), two[3]
    step = (low, high) if high - low > one[3] - one[2] else (one[2], one[3])
    return [one[0] + two[0], max(one[1], two[1]), *step, two[4] if two[0] else one[4]]


def _stuck_repeats(value: float, start: np.ndarray, relative: np.ndarray, run: list, after: tuple | None, unit: float, spread: float) -> np.ndarray:
    """Which repeats of a run are stuck. relative: the greatest relative progress up to each of them; run: extent of the
    whole run; after: (value, other metrics) of the reading that ends it."""
    repeats, top, low, high, steps = run
    if repeats < LEAST_REPEATS or value <= 0 or not np.nansum(start) > 0:
        return np.zeros(len(relative), bool)
    moved, last = value * relative, value * top
    strict = max(12.0, 3.0 * unit, 4.0 * spread * value)
    if after is not None:
        rise, total = after[0] - value, value * max(top, float(progress(start, after[1][None])[1][0]))
        capped = lambda m: np.minimum(m, rise * (m / total if total > 0 else 0.0 * m))
        moved, last = capped(moved), capped(last)
        enough = last >= max(6.0, 1.6 * unit, 2.0 * spread * value)
    else:
        enough = last >= strict and value * high - value * low <= 0.6 * last  # one jump of the others is no progress
    if repeats == LEAST_REPEATS:
        enough = enough and last >= strict
    if repeats > LEAST_REPEATS and spread * value >= VARIES * unit and repeats * np.log(spread * value / unit) >= LEAST_ODDS and top >= 0.25 * spread:
        return np.ones(len(relative), bool)  # one value again and again where no two readings agree, while the others vary
    if enough and steps < 6:  # few counts elsewhere: the odds that none of them would have been this metric's
        rest = float(progress(start, after[1][None])[0][0]) if after is not None else 0.0
        enough = after is not None and steps > 0 and steps * np.log1p((after[0] - value) / unit / max(rest, steps)) >= LEAST_ODDS
    return moved >= max(1.0, 0.5 * unit) if enough else np.zeros(len(relative), bool)


def _runs(w: np.ndarray, seg: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of equal values of a segment."""
    edges = np.flatnonzero((np.diff(w) != 0) | (False if seg is None else np.diff(seg) != 0))
    return np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(w) - 1]])


def stuck(v: np.ndarray, seg: np.ndarray, others: np.ndarray, clean: np.ndarray, spread: np.ndarray, segs: int, around: dict | None = None) -> np.ndarray:
    """Repeats of a value while the counter must have moved on.

    v: readings in order of segment and time; others: readings x other metrics (NaN unknown); spread: of each segment.
    A run of equal values is stuck if its value times the relative growth of the other metrics over the run, and the
    catching-up at the reading after it in proportion to the other metrics' progress, both exceed what counting noise
    and rounding explain. around: of a shard (one segment), what lies beyond its ends (_around); None for whole series."""
    flagged = np.zeros(len(v), bool)
    at = np.flatnonzero(clean)
    if not len(at):
        return flagged
    w, s = v[at], seg[at]
    digits = np.full(1, around["digits"]) if around else kept_digits(round_counts(w, s, segs))
    unit = _unit_of(w, digits[s])
    starts, ends = _runs(w, s)
    if around:
        look = range(len(starts))
    else:  # runs in which the others' progress is worth the least that any run needs
        some = np.flatnonzero((ends - starts >= LEAST_REPEATS) & (w[starts] > 0))
        length = (ends - starts)[some]
        first = np.repeat(starts[some], length)
        each = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(length) - length, length)
        base, now = others[at[first]], others[at[each]]
        both = ~np.isnan(base) & ~np.isnan(now)
        known = np.where(both, base, 0.0).sum(axis=1)
        relative = np.where(both, now - base, 0.0).sum(axis=1) / np.maximum(known, 1e-9)
        top = np.maximum.reduceat(relative, np.cumsum(length) - length) if len(length) else np.zeros(0)
        value = w[starts[some]]
        u, usual = unit[starts[some]], spread[s[starts[some]]]
        varies = (length > LEAST_REPEATS) & (usual * value >= VARIES * u) & (top >= 0.25 * usual)
        look = some[varies | (value * top >= np.maximum(np.maximum(6.0, 1.6 * u), 2.0 * usual * value))]
    for r in look:
        a, b = starts[r], ends[r]
        head = around["head"] if around and a == 0 else None  # a run that began before this shard
        start = np.array(head["start"]) if head else others[at[a]]
        mine = at[a if head else a + 1 : b + 1]
        if not len(mine):
            continue
        relative = np.maximum.accumulate(progress(start, others[mine])[1])
        run, after = extent(start, others[mine]), (w[b + 1], others[at[b + 1]]) if b + 1 < len(w) and s[b + 1] == s[b] else None
        if head:
            relative, run = np.maximum(relative, head["before"][1]), joined(head["before"], run)
        if around and after is None:
            run = joined(run, around["rest"])
            after = around["after"] and (around["after"][0], np.array(around["after"][1]))
        flagged[mine] = _stuck_repeats(w[a], start, relative, run, after, unit[a], spread[s[a]])
    return flagged


def _possible(values: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (values >= 0) & (values < TOO_LARGE) & (values == np.floor(values))


def _moving_along(values: np.ndarray, possible: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """readings x metrics: whether at an end of a segment the other metrics may change like this one between it and its
    neighbour: the median change is a third of it at least, of those so large that such a change would be six counts."""
    out = np.ones(values.shape, bool)
    new = np.flatnonzero(np.diff(seg) != 0)
    n = len(seg)
    for end, near in ((np.concatenate([[0], new + 1]), 1), (np.concatenate([new, [n - 1]]), -1)):
        other = np.clip(end + near, 0, n - 1)
        end, other = end[seg[other] == seg[end]], other[seg[other] == seg[end]]
        end, other = end[end != other], other[end != other]
        if not len(end):
            continue
        x = [np.log1p(np.where(possible[i], values[i], np.nan)) for i in (end, other)]
        change = x[0] - x[1]
        for k in range(values.shape[1]):
            with np.errstate(invalid="ignore", over="ignore"):
                told = np.where(np.exp(np.fmin(*x)) * np.expm1(np.abs(change[:, [k]])) >= 6, change, np.nan)
                rest = _median([np.full(len(end), np.nan), *(told[:, j] for j in range(values.shape[1]) if j != k)])
                out[end, k] = ~(np.abs(rest) < np.abs(change[:, k]) / 3)
    return out


def cleaned(values: np.ndarray, at: np.ndarray, seg: np.ndarray, usual: Normal) -> tuple[np.ndarray, np.ndarray]:
    """(possible, clean): readings x metrics masks of the numbers a counter can have, and of those no outliers."""
    possible, bucket = _possible(values), 1 + bucket_of(at)
    clean, along = np.zeros(values.shape, bool), _moving_along(values, possible, seg)
    for k in range(values.shape[1]):
        some = np.flatnonzero(possible[:, k])
        s, b = seg[some], bucket[some]
        spread = np.maximum(usual.spread[s, k, 0], usual.spread[s, k, b])
        rate = np.where(np.isfinite(usual.rate[s, k, b]), np.maximum(usual.rate[s, k, 0], usual.rate[s, k, b]), usual.rate[s, k, 0])
        clean[some, k] = ~outliers(values[some, k], at[some], s, spread, rate, usual.digits[s, k], along[some, k])
    return possible, clean


def judge(values: np.ndarray, at: np.ndarray, seg: np.ndarray, metrics: list[str], judged: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each judged metric of whole sources' readings, in order of source (seg: 0, 1, ...) and time: (impossible,
    outlier, stuck) masks."""
    segs = int(seg[-1]) + 1 if len(seg) else 0
    digits = np.stack([kept_digits(round_counts(v[p], seg[p], segs)) for v in values.T for p in [_possible(v)]], axis=1)
    usual = normal(told_sketches(values, at, seg, np.ones(len(at), bool)), segs, digits)
    possible, clean = cleaned(values, at, seg, usual)
    out, usable = {}, np.where(clean, values, np.nan)
    for name in judged:
        k = metrics.index(name)
        rest = [j for j in range(len(metrics)) if j != k]
        out[name] = (~possible[:, k] & ~np.isnan(values[:, k]), possible[:, k] & ~clean[:, k], stuck(values[:, k], seg, usable[:, rest], clean[:, k], usual.spread[:, k, 0], segs))
    return out


def _edges(w: np.ndarray, others: np.ndarray) -> dict | None:
    """Of a shard's clean values in order: its first reading, the first that differs from it, and the value and start of
    its last run, each as (value, other metrics); None without values."""
    if not len(w):
        return None
    starts, _ = _runs(w)
    row = lambda i: [float(w[i]), others[i].tolist()]
    return {"counts": round_counts(w)[0].tolist(), "first": row(0), "differs": row(starts[1]) if len(starts) > 1 else None, "last": row(starts[-1])}


def _around(edges: list[dict | None]) -> list[dict | None]:
    """For each shard of a source in order what surrounds it: digits, where the run it begins in started (head, if one
    goes on), and the reading that ends its last run (after)."""
    out: list[dict | None] = [None] * len(edges)
    digits = int(kept_digits(np.sum([e["counts"] for e in edges if e], axis=0))[0]) if any(edges) else 0
    open_ = None
    for i, e in enumerate(edges):
        if e:
            goes_on = open_ is not None and open_[0] == e["first"][0]
            out[i] = {"digits": digits, "head": {"start": open_[1]} if goes_on else None}
            open_ = open_ if goes_on and not e["differs"] else e["last"]
    first = differs = None  # the first reading after a shard, and the first after it that differs from that one
    for i in range(len(edges) - 1, -1, -1):
        if e := edges[i]:
            out[i]["after"] = first if first and first[0] != e["last"][0] else differs
            differs = e["differs"] or (first if first and first[0] != e["first"][0] else differs)
            first = e["first"]
    return out


def _extents(w: np.ndarray, others: np.ndarray, around: dict | None) -> dict | None:
    """Extents of a shard's part of the run that goes on from before (head) and of the run that it leaves open (tail);
    through: whether they are one run."""
    if around is None:
        return None
    starts, ends = _runs(w)
    head, through = around["head"], bool(around["head"]) and len(starts) == 1
    return {
        "head": extent(np.array(head["start"]), others[: ends[0] + 1]) if head else None, "through": through,
        "tail": None if through else extent(others[starts[-1]], others[starts[-1] + 1 :]),
    }


def _measured(around: list[dict | None], extents: list[dict | None]) -> list[dict | None]:
    """around with the extents of the open runs before each shard (head's before) and after it (rest)."""
    none = [0, 0.0, 0.0, 0.0, 0.0]
    before, rest = none, none
    for a, e in zip(around, extents):
        if e:
            if a["head"]:
                a["head"]["before"] = before
            before = joined(before, e["head"]) if e["through"] else e["tail"]
    for a, e in zip(reversed(around), reversed(extents)):
        if e:
            a["rest"] = rest
            rest = (joined(e["head"], rest) if e["through"] else e["head"]) if e["head"] else none
    return around


def _stuck_across_shards(clean: DataFrame, judged: list[str], metrics: list[str], found: str) -> DataFrame:
    """(reading, metric, kind) of the stuck readings of sources in several shards, as if each source were one.

    clean: (source, shard, at, reading, usable array<double>, spread array<double>), each shard's own readings. Shards
    tell about their ends, a source's shards are chained (a few numbers a shard), twice: where the runs that cross
    boundaries start and end, then how far they go."""
    kinds = clean.schema["source"].dataType.simpleString()
    by, of = ["source", "shard"], f"source {kinds}, shard int, told string"

    def series(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, dict]:
        pdf = pdf.sort_values(["at", "reading"], kind="stable", ignore_index=True)
        values = np.array(pdf["usable"].tolist(), float).reshape(len(pdf), len(metrics))
        return pdf, values, {m: (metrics.index(m), [j for j in range(len(metrics)) if metrics[j] != m]) for m in judged}

    def told(key: tuple, what: dict) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]], "shard": [key[1]], "told": [json.dumps(what)]})

    def ends(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, values, which = series(pdf)
        has = ~np.isnan(values)
        return told(key, {m: _edges(values[has[:, k], k], values[has[:, k]][:, rest]) for m, (k, rest) in which.items()})

    def extents(key: tuple, pdf: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
        _, values, which = series(pdf)
        has, around = ~np.isnan(values), json.loads(context["told"].iloc[0])
        return told(key, {m: [around[m], _extents(values[has[:, k], k], values[has[:, k]][:, rest], around[m])] for m, (k, rest) in which.items()})

    def chained(step):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("shard", ignore_index=True)
            each = [json.loads(t) for t in pdf["told"]]
            out = {m: step([e[m] for e in each]) for m in judged}
            return pdf.assign(told=[json.dumps({m: out[m][i] for m in judged}) for i in range(len(pdf))])

        return run

    def flags(key: tuple, pdf: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
        pdf, values, which = series(pdf)
        around, out = json.loads(context["told"].iloc[0]), []
        for m, (k, rest) in which.items():
            if around[m]:
                has = ~np.isnan(values[:, k])
                hit = stuck(values[:, k], np.zeros(len(pdf), int), values[:, rest], has, np.array([pdf["spread"].iloc[0][k]]), 1, around[m])
                out.append(pd.DataFrame({"reading": pdf["reading"][hit], "metric": m, "kind": "stuck"}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"reading": pdf["reading"][:0], "metric": "", "kind": ""})

    context = cut(clean.groupBy(by).applyInPandas(ends, of).groupBy("source").applyInPandas(chained(_around), of))
    context = clean.groupBy(by).cogroup(context.groupBy(by)).applyInPandas(extents, of)
    context = cut(context.groupBy("source").applyInPandas(chained(lambda each: _measured([a for a, _ in each], [e for _, e in each])), of))
    return clean.groupBy(by).cogroup(context.groupBy(by)).applyInPandas(flags, found)


def _flag_hot(readings: DataFrame, judged: list[str], metrics: list[str], shard_rows: int, halo: int, found: str) -> DataFrame:
    """flag_spikes of sources of more than shard_rows readings of known time."""
    kind = {c: readings.schema[c].dataType.simpleString() for c in ("reading", "source")}
    sharded = cut(shard_by_time(readings, shard_rows, halo))

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(["at", "reading"], kind="stable", ignore_index=True)
        return pdf, pdf[metrics].to_numpy(float), pdf["at"].to_numpy(), np.zeros(len(pdf), int)

    def tell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, values, at, seg = ordered(pdf)
        own = ~pdf["halo"].to_numpy(bool)
        parts = [pd.DataFrame({"k": k, "which": which, "key": keys, "n": n}) for k, both in enumerate(told_sketches(values, at, seg, own)) for which, (keys, n) in enumerate(both)]
        for k, v in enumerate(values[own].T):
            parts.append(pd.DataFrame({"k": k, "which": 2, "key": range(7), "n": round_counts(v[_possible(v)])[0]}))
        return pd.concat(parts).assign(source=key[0])[["source", "k", "which", "key", "n"]]

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")

        def pick(k: int, which: int) -> tuple[np.ndarray, np.ndarray]:
            rows = pdf[(pdf["k"] == k) & (pdf["which"] == which)]
            return rows["key"].to_numpy(), rows["n"].to_numpy()

        digits = np.stack([kept_digits(pick(k, 2)[1]) for k in range(len(metrics))], axis=1)
        usual = normal([[pick(k, 0), pick(k, 1)] for k in range(len(metrics))], 1, digits)
        return pd.DataFrame({"source": [key[0]], "spread": [usual.spread.ravel()], "rate": [usual.rate.ravel()], "digits": [usual.digits.ravel()]})

    merged_ = sharded.groupBy("source", "shard").applyInPandas(
        tell, f"source {kind['source']}, k int, which int, key long, n long",
    ).groupBy("source", "k", "which", "key").agg(F.sum("n").alias("n"))
    usual_ = merged_.groupBy("source").applyInPandas(learn, f"source {kind['source']}, spread array<double>, rate array<double>, digits array<int>")

    def clean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, values, at, seg = ordered(pdf)
        tables = [np.array(pdf[c].iloc[0].tolist(), float).reshape(1, len(metrics), -1) for c in ("spread", "rate", "digits")]
        usual = Normal(tables[0], tables[1], tables[2][:, :, 0].astype(int))
        possible, fine = cleaned(values, at, seg, usual)
        usable, which = np.where(fine, values, np.nan), [metrics.index(m) for m in judged]
        wrong = np.where(possible, np.where(fine, "", "outlier"), np.where(np.isnan(values), "", "impossible"))[:, which]
        out = pdf[["source", "shard", "at", "reading"]].assign(usable=list(usable), spread=[usual.spread[0, :, 0]] * len(pdf), wrong=wrong.tolist())
        return out[~pdf["halo"].to_numpy(bool)]

    schema = f"source {kind['source']}, shard int, at long, reading {kind['reading']}, usable array<double>, spread array<double>, wrong array<string>"
    cleaned_ = cut(sharded.join(usual_, "source").groupBy("source", "shard").applyInPandas(clean, schema))
    wrong = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col("wrong")[i].alias("kind")) for i, m in enumerate(judged))))
    single = cleaned_.select("reading", wrong.alias("c")).select("reading", "c.*").where("kind <> ''")
    return single.unionByName(_stuck_across_shards(cleaned_.drop("wrong"), judged, metrics, found))


def flag_spikes(readings: DataFrame, judged: list[str], metrics: list[str] = METRICS, shard_rows: int = SHARD_ROWS, halo: int = HALO, task_rows: int = TASK_ROWS) -> DataFrame:
    """(reading, metric, kind) of every implausible stored value; kind: impossible, outlier or stuck.

    readings: (reading, source, at, <metrics>), one row per reading; it is read more than once. Values NULL are no case;
    negative, fractional, infinite, NaN and astronomically large ones are impossible whether or not the time is known;
    readings without a known time or source are judged as numbers only. Series of under four values have no outliers. Readings of
    equal times are ordered by id. An empty table gives an empty result; other columns are ignored."""
    readings = readings.select("reading", "source", "at", *(F.col(m).cast("double").alias(m) for m in metrics))
    # NaN is told apart from NULL here, as pandas can't.
    numbers = readings.select(
        "reading", (F.col("at").isNotNull() & F.col("source").isNotNull()).alias("judged"),
        F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in judged))).alias("c"),
    ).select("reading", "judged", "c.*")
    impossible = (F.col("v") < 0) | (F.col("v") >= TOO_LARGE) | (F.col("v") != F.floor("v"))
    numbers = numbers.where(F.col("v").isNotNull() & (F.isnan("v") | (~F.col("judged") & impossible))).select("reading", "metric", F.lit("impossible").alias("kind"))
    schema = f"reading {readings.schema['reading'].dataType.simpleString()}, metric string, kind string"
    dated = readings.where(F.col("at").isNotNull() & F.col("source").isNotNull())
    total, most = largest_source(dated)
    if most > shard_rows:
        hot = cut(dated.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > shard_rows).select("source"))
        numbers = numbers.unionByName(_flag_hot(dated.join(hot, "source", "left_semi"), judged, metrics, shard_rows, halo, schema))
        dated = dated.join(hot, "source", "left_anti")
    tasks = max(1, -(-total // task_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "at", "reading"], kind="stable", ignore_index=True)
        seg = np.cumsum((pdf["source"] != pdf["source"].shift()).to_numpy()) - 1
        found = []
        for name, masks in judge(pdf[metrics].to_numpy(float), pdf["at"].to_numpy(), seg, metrics, judged).items():
            for kind, mask in zip(("impossible", "outlier", "stuck"), masks):
                found.append(pd.DataFrame({"reading": pdf["reading"].to_numpy()[mask], "metric": name, "kind": kind}))
        return pd.concat(found, ignore_index=True)

    rows = dated.withColumn("_task", F.pmod(F.xxhash64("source"), F.lit(tasks)))
    return numbers.unionByName(rows.groupBy("_task").applyInPandas(run, schema))

"""Items that appear together, with surprise against a fitted bipartite configuration null.

Pair counts are exact: a basket's distinct items are cut into blocks, each pair of blocks is one small task row, and
pairs are added up per Arrow batch before they are shuffled.  The null is the maximum-entropy bipartite graph with the
observed item frequencies and basket sizes in expectation; p(item, basket) = x y / (1 + x y) depends only on the item's
frequency and the basket's size, so it is fitted on the two histograms.  An item pair's count under the null is then
Poisson-binomial, a sum of binomials over basket sizes, whose tail is found exactly; false discoveries are controlled
over all possible pairs.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sift.session import cut

#: Items per block of a basket. Pairs of two blocks are made in one row.
BLOCK = 256
#: Numbers of a matrix held at a time.
CELLS = 4_000_000
#: Ranges of p-values in which ranks are found; one task each.
RANGES = 200


def pair_counts(baskets: DataFrame, item_type: str = "long", block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, n_ab), item_a < item_b, of distinct (basket, item) rows.

    A basket of k items becomes ceil(k / block) blocks; each block meets every other block of its basket once."""
    sizes = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > 1)
    placed = baskets.join(sizes, "basket").withColumn("_n", F.ceil(F.col("_k") / block).cast("int"))
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("item"), F.col("_n")).cast("int"))
    copies = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(F.least("_b", j).alias("lo"), F.greatest("_b", j).alias("hi")))
    rows = placed.select("basket", "item", "_b", F.explode(copies).alias("c"))
    rows = rows.groupBy("basket", "c.lo", "c.hi").agg(
        F.sort_array(F.collect_list(F.when(F.col("_b") == F.col("c.lo"), F.col("item")))).alias("left"),
        F.sort_array(F.collect_list(F.when(F.col("_b") == F.col("c.hi"), F.col("item")))).alias("right"),
    )
    rows = rows.select(F.when(F.col("lo") == F.col("hi"), F.lit(True)).otherwise(False).alias("same"), "left", "right")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pd.DataFrame:
            both = np.concatenate(held, axis=1)
            order = np.lexsort(both[::-1])
            both = both[:, order]
            new = np.r_[True, (np.diff(both[0]) != 0) | (np.diff(both[1]) != 0)]
            at = np.flatnonzero(new)
            return pd.DataFrame({"item_a": both[0, at], "item_b": both[1, at], "n": np.diff(np.r_[at, both.shape[1]])})

        for frame in frames:
            for same, left, right in zip(frame["same"], frame["left"], frame["right"]):
                if same:
                    i, j = np.triu_indices(len(left), 1)
                    a, b = left[i], left[j]
                else:
                    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
                    a, b = np.minimum(a, b), np.maximum(a, b)
                held.append(np.stack([a, b]))
                n += len(a)
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    counted = rows.mapInPandas(run, f"item_a {item_type}, item_b {item_type}, n long")
    return counted.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab"))


def _sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each x the sum over y of weights * y / (1 + x y), in blocks of bounded memory."""
    rows = max(1, CELLS // max(1, len(y)))
    return np.concatenate([(weights * y / (1.0 + np.outer(x[i : i + rows], y))).sum(axis=1) for i in range(0, len(x), rows)])


def fit_null(degrees: np.ndarray, items: np.ndarray, sizes: np.ndarray, baskets: np.ndarray, rounds: int = 5000, tol: float = 1e-8, sums=_sums) -> tuple[np.ndarray, np.ndarray]:
    """Fitnesses (x per degree, y per size) of the bipartite configuration model; infinite for items that all baskets
    have and baskets that have all items.

    degrees / items: histogram of item frequencies; sizes / baskets: histogram of basket sizes. Fixed-point iteration
    of the likelihood equations degree = sum_sizes baskets * x y / (1 + x y), and likewise for sizes, until all of them
    hold within tol; a warning tells if they don't after all rounds. sums: as _sums, maybe by many tasks."""
    x, y = np.full(len(degrees), np.inf), np.full(len(sizes), np.inf)
    d, s, rows, cols = degrees.astype(float), sizes.astype(float), np.ones(len(degrees), bool), np.ones(len(sizes), bool)
    while rows.any() and cols.any():  # what is certain, one way or the other, is no matter of fitness
        x[rows & (d <= 0)], y[cols & (s <= 0)] = 0.0, 0.0
        rows, cols = rows & (d > 0), cols & (s > 0)
        full_d, full_s = rows & (d >= baskets[cols].sum()), cols & (s >= items[rows].sum())
        if full_d.any():
            rows, s = rows & ~full_d, s - items[full_d].sum() * cols
        elif full_s.any():
            cols, d = cols & ~full_s, d - baskets[full_s].sum() * rows
        else:
            break
    if not rows.any() or not cols.any():
        return x, y
    d, s, items, baskets = d[rows], s[cols], items[rows], baskets[cols]
    u, v = d / math.sqrt((d * items).sum()), s / math.sqrt((d * items).sum())
    off = math.inf
    for _ in range(rounds):
        nu = d / sums(u, v, baskets)
        got = sums(v, nu, items)
        off = max(np.abs(nu / u - 1).max(), np.abs(v * got / s - 1).max())
        u, v = nu, s / got
        if off < tol:
            break
    else:
        warnings.warn(f"the configuration null holds within {off:.1e} only", RuntimeWarning, stacklevel=2)
    x[rows], y[cols] = u, v
    return x, y


def chance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Probabilities that items of fitness x are in baskets of fitness y."""
    with np.errstate(invalid="ignore", over="ignore"):
        z = np.outer(x, y)
        return np.where(np.isinf(x)[:, None] | np.isinf(y), 1.0, z / (1.0 + z))


def poisson_binomial_tails(n: np.ndarray, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 P(X >= n) for each row, X being a sum of counts[k] Bernoullis of probs[row, k]: exact but for rounding.

    The distribution is tilted so that its mean is n, so what matters of it lies within a few standard deviations, where
    a Fourier inversion gives it without loss; the tilt is then taken back term by term."""
    out = np.full(len(n), np.nan)
    n = n.astype(float)
    sure, may = (counts * (probs >= 1)).sum(axis=1), (counts * (probs > 0)).sum(axis=1)
    out[n <= sure] = 0.0
    out[n > may] = -math.inf
    all_ = np.flatnonzero(np.isnan(out) & (n == may))
    with np.errstate(divide="ignore"):
        out[all_] = (counts * np.where(probs[all_] > 0, np.log(np.where(probs[all_] > 0, probs[all_], 1.0)), 0.0)).sum(axis=1)
    todo = np.flatnonzero(np.isnan(out))
    if not len(todo):
        return out / math.log(10)
    p, m = probs[todo], n[todo]
    odds = np.where(p >= 1, np.inf, p / np.where(p >= 1, 1.0, 1.0 - p))

    def tilted(t: np.ndarray) -> np.ndarray:
        w = odds * np.exp(t)[:, None]
        return np.where(np.isinf(w), 1.0, w / (1.0 + np.where(np.isinf(w), 0.0, w)))

    lo, hi = np.full(len(m), -700.0), np.full(len(m), 700.0)
    t = np.clip(np.log(m / np.maximum((counts * p).sum(axis=1), 1e-300)), -600, 600)
    for _ in range(200):
        q = tilted(t)
        mean, var = (counts * q).sum(axis=1), (counts * q * (1 - q)).sum(axis=1)
        lo, hi = np.where(mean < m, t, lo), np.where(mean < m, hi, t)
        step = t + (m - mean) / np.maximum(var, 1e-300)
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        done = np.abs(new - t).max() < 1e-9
        t = new
        if done:
            break
    q = tilted(t)
    reach = np.ceil(12 * np.sqrt((counts * q * (1 - q)).sum(axis=1))).astype(int) + 4
    scale = np.where(p >= 1, t[:, None], np.log1p(np.where(p >= 1, 0.0, p) * np.expm1(t)[:, None]))
    scale = (counts * scale).sum(axis=1) - t * m
    length = 2 ** np.ceil(np.log2(2 * reach + 2)).astype(int)
    for size in np.unique(length):
        where = np.flatnonzero(length == size)
        turn = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
        rows = max(1, CELLS // 4 // (len(turn) * max(1, len(counts))))
        for i in range(0, len(where), rows):
            k = where[i : i + rows]
            waves = np.exp((counts * np.log(1 - q[k, None, :] + q[k, None, :] * turn[:, None])).sum(axis=2))
            pmf = np.maximum(np.fft.irfft(waves, size), 0.0)
            step = np.arange(size // 2)
            up = t[k] >= 0
            at = np.where(up[:, None], m[k, None] + step, m[k, None] - 1 - step).astype(int) % size
            sums = (pmf[np.arange(len(k))[:, None], at] * np.exp(-np.abs(t[k])[:, None] * (step + ~up[:, None]))).sum(axis=1)
            side = scale[k] + np.log(np.maximum(sums, 1e-300))
            out[todo[k]] = np.where(up, np.minimum(side, 0.0), np.log1p(-np.exp(np.minimum(side, -1e-16))))
    return out / math.log(10)


def _histogram(counts: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(value, how many) of a count column; at most sqrt(2 x rows) values, as they are distinct and add up."""
    rows = counts.groupBy(column).agg(F.count(F.lit(1)).alias("_m")).collect()
    pairs = sorted((int(r[0]), int(r[1])) for r in rows)
    return np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)


def benjamini_hochberg(tests: DataFrame, total: float, ranges: int = RANGES) -> DataFrame:
    """tests (..., log10_p) plus q: Benjamini-Hochberg over `total` tests, those not listed having p = 1.

    Ranks need no global sort: equal p-values are added up first, then ranked within ranges of a quantile sketch, and
    ranges are chained by their totals (one row a range)."""
    tests = tests.withColumn("_p", F.round("log10_p", 12))
    values = cut(tests.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")))
    marks = values.agg(F.percentile_approx("_p", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("m")).first()["m"] or []
    marks = sorted(set(marks))
    placed = values.withColumn("_r", F.size(F.filter(F.lit(marks) if marks else F.array().cast("array<double>"), lambda m: m < F.col("_p"))))
    totals = placed.groupBy("_r").agg(F.sum("_n").alias("_t"))
    chain = totals.withColumn("_before", F.sum("_t").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1))).drop("_t")
    w = W.partitionBy("_r").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.join(chain, "_r").withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.sum("_n").over(w))
    raw = ranked.withColumn("_q", F.col("_p") + F.lit(math.log10(max(total, 1.0))) - F.log10("_rank"))
    up = W.partitionBy("_r").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0)
    least = raw.groupBy("_r").agg(F.min("_q").alias("_m"))
    later = least.withColumn("_later", F.min("_m").over(W.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1))).drop("_m")
    q = raw.withColumn("_q", F.min("_q").over(up)).join(later, "_r").select("_p", F.least(F.lit(1.0), F.pow(F.lit(10.0), F.least("_q", F.coalesce("_later", "_q")))).alias("q"))
    return tests.join(q, "_p").drop("_p")


def _spread_sums(spark: SparkSession):
    """_sums by many tasks where a matrix of all degrees and sizes would be large: the driver only holds histograms."""

    def sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if len(x) * len(y) <= CELLS:
            return _sums(x, y, weights)
        parts = min(len(x), -(-len(x) * len(y) // CELLS))
        edges = np.linspace(0, len(x), parts + 1).astype(int)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k in frame["id"]:
                    yield pd.DataFrame({"at": range(edges[k], edges[k + 1]), "v": _sums(x[edges[k] : edges[k + 1]], y, weights)})

        rows = spark.range(0, parts, 1, parts).mapInPandas(run, "at long, v double").toPandas()  # one number a degree
        return rows.sort_values("at")["v"].to_numpy()

    return sums


def co_occurrence(baskets: DataFrame, n_baskets: int, min_count: int = 1, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, ratio, expected, log10_p, q) of item pairs with n_ab >= min_count.

    baskets: (basket, item BIGINT); repeated rows count once, NULLs are left out. n_baskets: all baskets, those without
    items included. ratio is n_ab n_baskets / (n_a n_b); expected, log10_p and q are the null's mean, the log of its
    upper tail at n_ab, and the false-discovery rate over all possible pairs of items. min_count only selects rows of
    the result: all pairs that occur are counted and tested, so q doesn't depend on it."""
    rows = cut(baskets.where(F.col("basket").isNotNull() & F.col("item").isNotNull()).select("basket", "item").distinct())
    items = cut(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    degree, how_many = _histogram(items, "n")
    size, of_size = _histogram(rows.groupBy("basket").agg(F.count(F.lit(1)).alias("k")), "k")
    spark = baskets.sparkSession
    x, y = fit_null(degree, how_many, size, of_size, sums=_spread_sums(spark)) if len(degree) else (np.zeros(0), np.zeros(0))
    fitness = spark.createDataFrame(pd.DataFrame({"n": degree.astype("int64"), "x": x}), "n long, x double")
    fitted = items.join(fitness, "n")
    pairs = pair_counts(rows, rows.schema["item"].dataType.simpleString(), block)
    for c in ("a", "b"):
        pairs = pairs.join(fitted.select(F.col("item").alias(f"item_{c}"), F.col("n").alias(f"n_{c}"), F.col("x").alias(f"x_{c}")), f"item_{c}")

    @F.pandas_udf("expected double, log10_p double")
    def surprise(n_ab: pd.Series, x_a: pd.Series, x_b: pd.Series) -> pd.DataFrame:
        cases = pd.DataFrame({"n": n_ab, "lo": np.minimum(x_a, x_b), "hi": np.maximum(x_a, x_b)})
        once = cases.drop_duplicates(ignore_index=True)
        lo, lo_at = np.unique(once["lo"], return_inverse=True)
        hi, hi_at = np.unique(once["hi"], return_inverse=True)
        chances, step, told = (chance(lo, y), chance(hi, y)), max(1, CELLS // max(1, 4 * len(y))), []
        for i in range(0, len(once), step):
            p = chances[0][lo_at[i : i + step]] * chances[1][hi_at[i : i + step]]
            told.append(np.stack([(of_size * p).sum(axis=1), poisson_binomial_tails(once["n"].to_numpy()[i : i + step], p, of_size)], axis=1))
        both = np.concatenate(told) if told else np.zeros((0, 2))
        once = once.assign(expected=both[:, 0], log10_p=both[:, 1])
        return cases.merge(once, "left", ["n", "lo", "hi"])[["expected", "log10_p"]]

    ratio = F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a") * F.col("n_b"))
    judged = pairs.withColumn("_s", surprise("n_ab", "x_a", "x_b")).select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n_baskets"), ratio.alias("ratio"), "_s.expected", F.greatest("_s.log10_p", F.lit(-1e6)).alias("log10_p")
    )
    total = float(how_many.sum()) * (float(how_many.sum()) - 1) / 2
    return benjamini_hochberg(cut(judged), total).where(F.col("n_ab") >= min_count)

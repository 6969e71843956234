"""Banded ranking in several views, shortlists and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sift.config import BAND, DETAIL_LIMIT, ONLINE_LIMIT, RESULTS_PER_PAGE, VIEWS
from sift.functions.numbers import clamp
from sift.operators.relevance import relevance_band
from sift.session import cut

#: Ranges of the inner score within which items are ordered.
RANGES = 4096


def rank_views(scored: DataFrame, views: tuple = VIEWS, collation: str | None = None) -> DataFrame:
    """scored (accepted items with relevance and all signals) once per view, plus view, view_index, struct `rank`
    (relevance_band, band_position, inner_score, signal) and position from 1.

    Order: band, inner score, relevance, signal, quality, all descending, then the key (in the given collation). Only
    keys and scores are ordered, within ranges of band and inner score, which are chained by their counts; scored is
    written once and meets its positions by key, so it should be unique by key."""
    base = cut(scored)
    key = F.collate("key", collation) if collation else F.col("key")
    v = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x.name).alias("name"), F.lit(x.relevance).alias("r"), F.lit(x.signal).alias("s"), F.lit(x.quality).alias("q")) for i, x in enumerate(views))))
    slim = base.select("key", F.col("relevance.value").alias("relevance"), *(F.col(f"{s}.value").alias(s) for s in ("quality", "growth", "timeliness")), v.alias("v"))
    signal = F.when(F.col("v.name") == "growth", F.col("growth")).when(F.col("v.name") == "timeliness", F.col("timeliness")).otherwise(F.col("quality"))
    slim = slim.withColumns({"band": relevance_band(F.col("relevance")), "signal": signal})
    slim = slim.withColumn("pos", clamp((F.col("relevance") - F.col("band") * BAND) / BAND))
    slim = slim.withColumn("inner", F.col("v.r") * F.col("pos") + F.col("v.s") * F.col("signal") + F.col("v.q") * F.col("quality"))
    slim = slim.select(
        "key", F.col("v.i").alias("view_index"), F.col("v.name").alias("view"), "band", "pos", "inner", "relevance", "signal", "quality",
        F.floor(F.col("inner") * RANGES).alias("range"),
    )
    group = ["view_index", "band", "range"]
    counts = slim.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))  # at most views x bands x ranges rows
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("view_index").orderBy(F.desc("band"), F.desc("range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    order = W.partitionBy(*group).orderBy(F.desc("inner"), F.desc("relevance"), F.desc("signal"), F.desc("quality"), key)
    placed = slim.join(counts.select(*group, ahead.alias("ahead")), group).withColumn("position", (F.col("ahead") + F.row_number().over(order)).cast("int"))
    rank = F.struct(F.col("band").alias("relevance_band"), F.col("pos").alias("band_position"), F.col("inner").alias("inner_score"), "signal")
    return base.join(placed.select("key", "view", "view_index", rank.alias("rank"), "position"), "key")


def balanced_shortlist(ranked: DataFrame, limit: int = DETAIL_LIMIT) -> DataFrame:
    """(key, turn): keys taken in turns from the views' rankings, each once, the first `limit`."""
    n = len(VIEWS)
    return ranked.where(F.col("position") <= limit).groupBy("key").agg(F.min(n * (F.col("position") - 1) + F.col("view_index")).alias("turn")).orderBy("turn").limit(limit)


def online_shortlist(ranked: DataFrame, limit: int = ONLINE_LIMIT) -> DataFrame:
    return ranked.where((F.col("view") == "timeliness") & (F.col("position") <= limit))


def page_of(ranked: DataFrame, view: str, page: int, size: int = RESULTS_PER_PAGE) -> DataFrame:
    """Items of one page of a view; the page is clamped to those there are, which are counted here."""
    rows = ranked.where(F.col("view") == view)
    last = rows.agg(F.max("position")).first()[0] or 1
    at = max(1, min(page, -(-last // size)))
    return rows.where(F.col("position").between((at - 1) * size + 1, at * size))


def page_numbers(page: int, pages: int) -> list[int | str]:
    """First, last and the pages around the current one, with "…" for gaps."""
    shown = sorted({1, pages, *range(page - 2, page + 3)} & set(range(1, pages + 1)))
    out: list[int | str] = []
    for p in shown:
        if out and p - out[-1] > 1:
            out.append("…")
        out.append(p)
    return out


def ranking_stats(evaluated: DataFrame, threshold: float, min_coverage: float) -> DataFrame:
    """One row: evaluated, accepted, rejected, and the admission rule."""
    n = evaluated.agg(F.count(F.lit(1)).alias("evaluated"), F.count(F.when(F.col("relevance.passes"), 1)).alias("accepted"))
    return n.select(
        "evaluated", "accepted", (F.col("evaluated") - F.col("accepted")).alias("rejected"), F.lit(threshold).alias("threshold"),
        F.lit(min_coverage).alias("min_coverage"), F.lit(BAND).alias("relevance_band"),
    )

"""Display columns of ranked items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.config import GROWTH_LABELS, ONLINE_LABELS
from sift.functions.numbers import clamp, format_count, format_date, format_score


def _label(value: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in labels.items()))


def completeness(explicit: Column, parts: list[Column]) -> Column:
    """The explicit value, else the mean of the known parts, else 0."""
    known = F.array_compact(F.array(*parts))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    return clamp(F.coalesce(explicit, mean, F.lit(0.0)))


def growth_label(status: Column) -> Column:
    return F.coalesce(_label(F.lower(status), GROWTH_LABELS), F.lit("积累中"))


def online_label(count: Column, status: Column) -> Column:
    raw = F.lower(F.coalesce(status, F.lit("")))
    absent = F.when(raw.isin("pending", "skipped"), _label(raw, ONLINE_LABELS)).otherwise(ONLINE_LABELS["missing"])
    return F.when(count.isNull(), absent).otherwise(F.concat(F.coalesce(_label(raw, ONLINE_LABELS), F.lit(ONLINE_LABELS["sampled"])), F.lit(" "), format_count(count)))


def first_reasons(groups: list[Column], limit: int = 4) -> Column:
    return F.slice(F.array_distinct(F.concat(*groups)), 1, limit)


def cards(ranked: DataFrame) -> DataFrame:
    """view, position, key and the texts of a result card."""
    q, g, t = (F.col(f"{c}.completeness") for c in ("quality", "growth", "timeliness"))
    reasons = {c: first_reasons([F.col(f"{c}.positive_reasons"), F.col(f"{c}.negative_reasons")]) for c in ("relevance", "quality", "growth", "timeliness")}
    return ranked.select(
        "view", "position", "key", "title", format_count(F.col("stats.views")).alias("views_text"), format_date(F.col("publishedAt")).alias("date_text"),
        *(format_score(F.col(f"{c}.value")).alias(f"{c}_text") for c in ("relevance", "quality", "growth", "timeliness")), F.concat(F.lit("数据 "), format_score(completeness(F.lit(None).cast("double"), [q, g, t])), F.lit("%")).alias("data_text"),
        growth_label(F.col("growth.status")).alias("growth_label"), online_label(F.col("timeliness.online_count"), F.col("timeliness.online_status")).alias("online_label"),
        F.size(F.array_distinct(F.transform("sources", lambda s: s.orderLabel))).alias("routes"), *(v.alias(f"{k}_reasons") for k, v in reasons.items()),
        F.slice("relevance.matched_terms", 1, 6).alias("chips"),
    )

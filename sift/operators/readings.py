"""Readings of counters: flat form, delivery duplicates, time shards of hot sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sift.functions.time import epoch_ms, timestamp_ms
from sift.session import cut

#: Parts into which a shard is cut at a time.
PARTS = 256
METRICS = ["views", "likes", "favorites", "coins", "replies", "danmaku", "shares"]


def snapshot_readings(snapshots: DataFrame) -> DataFrame:
    """(reading, source, at, received, <METRICS>): one row per snapshot_id, its first delivery.

    at is capturedAt in milliseconds, NULL unless it is known, positive and not after the reception. Rows without a
    snapshot_id or bvid are left out: they name no reading or no source."""
    rows = snapshots.where(F.col("snapshot_id").isNotNull() & F.col("bvid").isNotNull())
    rows = rows.select(
        "snapshot_id", "bvid", timestamp_ms(F.col("capturedAt")).alias("at"), epoch_ms(rows, "received_at").alias("received"),
        *(F.col(f"stats.{m}").alias(m) for m in METRICS),
    )
    first = F.min(F.struct("received", "bvid", "at", *METRICS)).alias("r")
    rows = rows.groupBy(F.col("snapshot_id").alias("reading")).agg(first)
    usable = (F.col("r.at") <= F.col("r.received")) | F.col("r.received").isNull()
    return rows.select(
        "reading", F.col("r.bvid").alias("source"), F.when(usable, F.col("r.at")).alias("at"), F.col("r.received").alias("received"),
        *(F.col(f"r.{m}").alias(m) for m in METRICS),
    )


def largest_source(rows: DataFrame) -> tuple[int, int]:
    """(rows, rows of the largest source)."""
    total, most = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    return total or 0, most or 0


def _split(placed: DataFrame, shard_rows: int) -> DataFrame:
    """Each shard of over shard_rows rows cut into up to PARTS, at quantiles (a mergeable sketch) of its own times."""
    large = placed.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > shard_rows)
    grid = [i / (4 * PARTS) for i in range(1, 4 * PARTS)]
    cuts = placed.join(large, ["source", "shard"]).groupBy("source", "shard").agg(F.first("_n").alias("_n"), F.percentile_approx("at", grid, 10_000).alias("_q"))
    k = F.least(F.lit(PARTS), F.ceil(F.col("_n") / shard_rows)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.element_at("_q", F.greatest(F.lit(1), (i * (4 * PARTS) / k).cast("int"))))
    cuts = cuts.select("source", "shard", F.array_distinct(picked).alias("_cuts"))
    part = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("at"))))
    return placed.join(cuts, ["source", "shard"], "left").withColumn("shard", F.col("shard") * PARTS + part).drop("_cuts")


def shard_by_time(rows: DataFrame, shard_rows: int, halo: int, most: int | None = None) -> DataFrame:
    """rows (source, at, ...) plus shard INT (0, 1, ... in order of time, none empty) and halo BOOLEAN.

    Sources with up to shard_rows rows are one shard. Larger ones are cut at quantiles of their own times, as often as
    their size needs, and each shard also gets the last `halo` rows of the one before and the first of the one after,
    marked as halo. Rows of one time stay together. Ties are ordered by all columns. most: rows of the largest source,
    counted here if not given. rows is read more than once."""
    left = largest_source(rows)[1] if most is None else most
    if left <= shard_rows:
        return rows.withColumns({"shard": F.lit(0), "halo": F.lit(False)})
    placed = rows.withColumn("shard", F.lit(0).cast("long"))
    while left > shard_rows:
        placed, left = cut(_split(placed, shard_rows)), left // (PARTS // 2)
    number = placed.select("source", "shard").distinct().withColumn("_s", F.row_number().over(W.partitionBy("source").orderBy("shard")) - 1)
    placed = placed.join(number, ["source", "shard"]).select(*rows.columns, F.col("_s").alias("shard"))
    if not halo:
        return placed.withColumn("halo", F.lit(False))
    cols = [c for c in rows.columns if c not in ("source", "at")]
    up, down = W.partitionBy("source", "shard").orderBy("at", *cols), W.partitionBy("source", "shard").orderBy(F.desc("at"), *(F.desc(c) for c in cols))
    edge = placed.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    copies = F.array_compact(F.array(
        F.struct(F.col("shard").alias("s"), F.lit(False).alias("h")),
        F.when((F.col("_up") <= halo) & (F.col("shard") > 0), F.struct((F.col("shard") - 1).alias("s"), F.lit(True).alias("h"))),
        F.when(F.col("_down") <= halo, F.struct((F.col("shard") + 1).alias("s"), F.lit(True).alias("h"))),
    ))
    # The last shard of a source has none after it: what it would tell that one is dropped.
    last = number.groupBy("source").agg(F.max("_s").alias("_last"))
    spread = edge.join(last, "source").withColumn("_c", F.explode(copies)).where(F.col("_c.s") <= F.col("_last"))
    return spread.select(*rows.columns, F.col("_c.s").alias("shard"), F.col("_c.h").alias("halo"))

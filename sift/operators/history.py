"""Metric history: sampled snapshots per item with retention."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sift.config import HISTORY, HistoryPolicy
from sift.functions.numbers import valid_stat
from sift.operators.readings import shard_by_time
from sift.session import remove

#: Times of one source in a shard.
SHARD_ROWS = 20_000


def keep_from(times: np.ndarray, last: int | None, interval: int) -> np.ndarray:
    """Of ascending times, those at least the interval after the one kept before, `last` being kept before the first."""
    kept, at = [], 0 if last is None else int(np.searchsorted(times, last + interval))
    while at < len(times):
        kept.append(times[at])
        at = int(np.searchsorted(times, times[at] + interval))
    return np.array(kept, np.int64)


def exits(times: np.ndarray, interval: int) -> tuple[list[int], list[int]]:
    """(entries, last kept time from each): where a walk over the times can enter them, entries that end alike being
    represented by the latest. A walk enters at one of the times within the interval after the first, or at the next."""
    n = len(times)
    step = np.searchsorted(times, times + interval)
    end = np.arange(n)
    for i in range(n - 1, -1, -1):
        if step[i] < n:
            end[i] = end[step[i]]
    stop = min(n, int(step[0]) + 1)
    ends = end[:stop]
    latest = np.flatnonzero(np.r_[ends[1:] != ends[:-1], True])
    return times[latest].tolist(), times[ends[latest]].tolist()


def sample_history(readings: DataFrame, policy: HistoryPolicy = HISTORY, last: bool = True, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(source, at, <other columns>): readings at least the interval after the one kept before in their source; with
    `last` only the newest keep_snapshots of a source.

    readings: (source, at BIGINT, ...); rows without source or time are left out; of equal times the row least by all
    columns counts. The rule is a walk, not a window. A source with very many readings is cut into time shards, which
    are walked in parallel: each tells where a walk leaves it for every way to enter it, the shards' maps are chained
    per source (a few numbers a shard), and each shard then walks from its own entry."""
    interval = policy.min_interval_ms
    rows = readings.where(F.col("source").isNotNull() & F.col("at").isNotNull())
    rest = [c for c in rows.columns if c not in ("source", "at")]
    one = rows.groupBy("source", "at").agg(F.min(F.struct(*rest)).alias("_r")) if rest else rows.select("source", "at").distinct()
    lists = shard_by_time(one.select("source", "at"), shard_rows, 0).groupBy("source", "shard").agg(F.array_sort(F.collect_list("at")).alias("times"))

    @F.pandas_udf("entries array<bigint>, ends array<bigint>")
    def maps(times: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exits(np.asarray(t, np.int64), interval) for t in times], columns=["entries", "ends"])

    @F.pandas_udf("array<struct<shard:int,last:bigint>>")
    def chain(shards: pd.Series) -> pd.Series:
        out = []
        for group in shards:
            before, walk = None, []
            for s in group:
                walk.append({"shard": int(s["shard"]), "last": before})
                entries = np.asarray(s["entries"], np.int64)
                k = 0 if before is None else int(np.searchsorted(entries, before + interval))
                if k < len(entries):
                    before = int(s["ends"][k])
            out.append(walk)
        return pd.Series(out)

    @F.pandas_udf("array<bigint>")
    def walk(times: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([keep_from(np.asarray(t, np.int64), None if pd.isna(b) else int(b), interval) for t, b in zip(times, before)])

    mapped = lists.withColumn("m", maps("times")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "m.entries", "m.ends"))).alias("shards"))
    before = mapped.select("source", F.explode(chain("shards")).alias("c")).select("source", "c.shard", F.col("c.last").alias("before"))
    kept = lists.join(before, ["source", "shard"]).select("source", F.explode(walk("times", "before")).alias("at"))
    if last:
        kept = kept.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy(F.desc("at")))).where(F.col("_n") <= policy.keep_snapshots).drop("_n")
    return one.join(kept, ["source", "at"]).select("source", "at", *(F.col(f"_r.{c}").alias(c) for c in rest))


def retain(history: DataFrame, now_ms: int, policy: HistoryPolicy = HISTORY) -> DataFrame:
    """history without snapshots older than the limit, of the most recently updated sources only (ties by name)."""
    young = history.where(F.col("at") >= now_ms - policy.max_age_ms)
    newest = young.groupBy("source").agg(F.max("at").alias("_u")).orderBy(F.desc("_u"), "source").limit(policy.keep_items)
    return young.join(newest.select("source"), "source", "left_semi")


def snapshots_for(history: DataFrame, keys: DataFrame, now_ms: int, policy: HistoryPolicy = HISTORY) -> DataFrame:
    """(source, snapshots): the kept snapshots of the given keys within the age limit, in order of time; an empty list
    for keys without any."""
    rest = [c for c in history.columns if c != "source"]
    mine = history.where(F.col("at").between(now_ms - policy.max_age_ms, now_ms)).join(keys.select(F.col("key").alias("source")).distinct(), "source", "left_semi")
    lists = mine.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("at", *(c for c in rest if c != "at")))).alias("snapshots"))
    out = keys.select(F.col("key").alias("source")).distinct().join(lists, "source", "left")
    return out.withColumn("snapshots", F.coalesce("snapshots", F.array().cast(lists.schema["snapshots"].dataType)))


def recordable(items: DataFrame) -> DataFrame:
    """Items whose counters are authoritative, so that no placeholder becomes a baseline."""
    return items.where(F.col("enrichment.detail").isin("complete", "partial"))


class HistoryStore:
    """The metric history as a durable table in a folder: each record() writes a new version beside the last one and
    then removes older ones, so a reader or a lost executor never meets a half-written table.

    An absent folder is an empty history; folders without a finished version are ignored."""

    SCHEMA = "source string, at long, stats struct<views:double,likes:double,favorites:double,replies:double,danmaku:double,coins:double,shares:double>"

    def __init__(self, spark: SparkSession, folder: str, policy: HistoryPolicy = HISTORY):
        self.spark, self.folder, self.policy = spark, folder.rstrip("/"), policy

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        done = lambda n: files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and done(n))

    def read(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/v{versions[-1]}") if versions else self.spark.createDataFrame([], self.SCHEMA)

    def record(self, items: DataFrame, now_ms: int) -> None:
        """Add the authoritative items' counters of now, of those with a key and one known counter at least whose last
        kept snapshot is an interval old; drop what is too old or too much."""
        versions = self._versions()
        names = [f.name for f in self.read().schema["stats"].dataType.fields]
        new = recordable(items).where(F.col("key").isNotNull()).select(
            F.col("key").alias("source"), F.lit(now_ms).cast("long").alias("at"),
            F.struct(*(valid_stat(F.col(f"stats.{m}")).alias(m) for m in names)).alias("stats"),
        )
        new = new.where(F.coalesce(*(F.col(f"stats.{m}") for m in names)).isNotNull())
        kept = retain(sample_history(self.read().unionByName(new), self.policy), now_ms, self.policy)
        version = (versions[-1] if versions else 0) + 1
        kept.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        for old in versions:
            remove(self.spark, f"{self.folder}/v{old}")

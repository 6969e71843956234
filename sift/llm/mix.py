"""Mixing sources to target token shares by pivotal (dependent) rounding.

Each document of a source gets the same expected number of copies; its whole part is certain, its fraction is rounded
so that the source's token total is kept: two documents' fractions are paired and token mass moves from one to the
other, in a random direction that keeps both expectations, until one of them is integral.  Buckets of a source are
rounded independently, each leaving at most one document undecided; those leftovers meet in a reduction tree of fixed
fan-in until one per source is left, which is decided by its probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sift.llm.encode import token_counts
from sift.session import cut

#: Documents a rounding task takes, and leftovers a node of the reduction tree takes.
BUCKET_DOCS, FAN_IN = 50_000, 16

_ROUNDED = "source string, doc_id long, n_tokens long, p double, copies int, node long"


def pivotal(sizes: list[int], probs: list[float], draws) -> list[float]:
    """Probabilities after pairing all: each is 0.0 or 1.0 but for at most one; sum(size * p) is kept and so is each
    expectation. draws: iterator of uniform numbers."""
    out = list(probs)
    i = -1
    for j in range(len(out)):
        if not 0.0 < out[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        up = min(sizes[i] * (1.0 - out[i]), sizes[j] * out[j])  # mass that can go from j to i
        down = min(sizes[i] * out[i], sizes[j] * (1.0 - out[j]))
        move = up if next(draws) * (up + down) < down else -down
        full_i = (move == sizes[i] * (1.0 - out[i])) or (-move == sizes[i] * out[i])
        a, b = out[i] + move / sizes[i], out[j] - move / sizes[j]
        if full_i:
            out[i] = 1.0 if move > 0 else 0.0
            out[j] = 0.0 if b < 1e-12 else 1.0 if b > 1 - 1e-12 else b
            i = j if 0.0 < out[j] < 1.0 else -1
        else:
            out[j] = 0.0 if move > 0 else 1.0
            out[i] = 0.0 if a < 1e-12 else 1.0 if a > 1 - 1e-12 else a
            i = i if 0.0 < out[i] < 1.0 else -1
    return out


def _node(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([seed, int(pdf["node"].iloc[0]), int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFFFFFFFFFF])
        p = pivotal(pdf["n_tokens"].tolist(), pdf["p"].tolist(), iter(rng.random(len(pdf))))
        if last:
            p = [x if x in (0.0, 1.0) else float(rng.random() < x) for x in p]
        return pdf.assign(p=p)

    return run


def mix_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: tokens wanted and available, expected copies per document, and whether even
    max_repeats copies of everything fall short.

    counts: (doc_id, source, n_tokens). The total is over all documents, null and unlisted sources included. Targets
    without a source are ignored; several rows of one source add up, with the largest cap. A source without documents
    has no tokens and falls short of any positive share."""
    totals = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"), F.count(F.lit(1)).alias("docs_available"))
    everything = totals.agg(F.sum("tokens_available")).first()[0] or 0
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = wanted.join(totals, "source", "left").withColumn("tokens_total", F.lit(everything).cast("long"))
    tokens, docs = F.coalesce("tokens_available", F.lit(0)), F.coalesce("docs_available", F.lit(0))
    need = F.coalesce("target_share", F.lit(0.0)) * F.col("tokens_total")
    cap = F.coalesce("max_repeats", F.lit(0)).cast("long")
    return plan.select(
        "source", "target_share", cap.alias("max_repeats"), tokens.alias("tokens_available"), docs.alias("docs_available"), "tokens_total", need.alias("target_tokens"),
        (tokens * cap < need).alias("short"), F.when(tokens > 0, F.least(need / tokens, cap.cast("double"))).otherwise(0.0).alias("copies_mean"),
    )


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None, bucket_docs: int = BUCKET_DOCS) -> tuple[DataFrame, DataFrame]:
    """(draws, report). draws: (source, doc_id, n_tokens, copies) of every document drawn at least once, no more than
    max_repeats times; report: mix_plan's columns with drawn tokens, documents, largest repeat and the share reached.

    A repeated doc_id counts once per row; documents without tokens or of unlisted or null sources are never drawn.
    Results depend on seed and documents, not on partitions. Short sources are used to their cap and reported short."""
    counts = cut(token_counts(docs.select("doc_id", "source", "text"), ["doc_id", "source"], path=path))
    plan = cut(mix_plan(counts, targets))
    sized = counts.where(F.col("n_tokens") > 0).join(plan.select("source", "copies_mean", "docs_available"), "source")
    whole, buckets = F.floor("copies_mean").cast("int"), F.ceil(F.col("docs_available") / bucket_docs)
    start = sized.select(
        "source", "doc_id", "n_tokens", (F.col("copies_mean") - whole).alias("p"), whole.alias("copies"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), buckets).alias("node"),
    )
    nodes = plan.agg(F.max(F.ceil(F.col("docs_available") / bucket_docs))).first()[0] or 1
    parts, level = [start.where(F.col("p") == 0.0)], start.where(F.col("p") > 0.0)
    while True:
        last = nodes <= 1
        rounded = level.groupBy("source", "node").applyInPandas(_node(seed, last), _ROUNDED)
        if not last:
            rounded = cut(rounded)
        parts.append(rounded.where(F.col("p").isin(0.0, 1.0)))
        if last:
            break
        level = rounded.where(~F.col("p").isin(0.0, 1.0)).withColumn("node", F.floor(F.col("node") / FAN_IN))
        nodes = -(-nodes // FAN_IN)
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part.select(decided.columns))
    draws = decided.select("source", "doc_id", "n_tokens", (F.col("copies") + F.col("p").cast("int")).alias("copies")).where(F.col("copies") > 0)
    draws = cut(draws)  # the report is of these very draws, and readers of a few of its columns don't drop them
    used = draws.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_drawn"), F.count(F.lit(1)).alias("docs_drawn"), F.max("copies").alias("most_repeats"),
    )
    report = plan.join(used, "source", "left").fillna(0, ["tokens_drawn", "docs_drawn", "most_repeats"])
    drawn = F.sum("tokens_drawn").over(W.partitionBy())  # over one row per target source
    shares = [F.when(whole > 0, F.col("tokens_drawn") / whole) for whole in (F.col("tokens_total"), drawn)]
    return draws, cut(report.withColumns({"share_of_total": shares[0], "share_of_mix": shares[1]}))

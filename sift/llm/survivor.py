"""One surviving record per group of duplicates, by consistent bundles of fields.

Fields that depend on one another form a bundle, which is taken whole from one record.  Dependencies between bundles
(a value of one determines the other's) say which bundles go together; of all choices the one with the fewest broken
dependencies survives, and among those the one of greatest trust, bundles of earlier tiers first.

The search is branch and bound.  Its root, where every bundle has its most trusted value, bounds all choices: a group
whose root breaks no dependency is closed there, in the JVM, by one combinable aggregate per group.  Groups whose root
isn't known to be consistent are branched over their distinct values, most trusted first.  Dominance leaves one record
per distinct value, and a bound proves that values not yet looked at can't win (else more are taken), so no group of
any size has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sift.session import cut

#: Most trusted values per bundle that the first round searches; each further round takes 16 times as many.
FIRST_VALUES = 32
#: Parts into which a group's values are cut before their most trusted ones meet.
PARTS = 64
#: Trust of an unknown level, and of an unknown time.
_UNKNOWN = -(1 << 62)


@dataclass(frozen=True)
class Bundle:
    """fields: output name -> expression; says: whether the record's bundle says something (never NULL); tier: all
    bundles of a lower tier come first in trust."""

    name: str
    fields: dict[str, Column]
    says: Column
    tier: int = 0


@dataclass(frozen=True)
class Dependency:
    """The value of bundle `of` determines the value of bundle `on_`: the one in the most trusted record of the group
    that has that value and says both. Values without such a record determine nothing."""

    of: str
    on_: str


def worth(trusts: Sequence[tuple], tiers: Sequence[int]) -> tuple:
    """What choices are compared by: per tier the sums of levels and of times, then the records bundle by bundle."""
    sums = [sum(t[i] for t, at in zip(trusts, tiers) if at == tier) for tier in sorted(set(tiers)) for i in (0, 1)]
    return (*sums, *(t[2] for t in trusts))


def branch_and_bound(domains: list[list[tuple]], allowed: dict[tuple[int, int], dict], tiers: list[int]) -> tuple[list[int], tuple]:
    """Positions of the chosen values, and (minus the number of broken dependencies, *worth).

    domains: per bundle its (value, (level, time, record)) with the most trusted first. allowed: for (a, b) the value
    of b that goes with a value of a. A choice that leaves no more to win than the best known is cut off: the values
    not yet chosen are taken at their most trusted, unbroken."""
    tops = [d[0][1] for d in domains]
    best: list = [None, None]

    def broken(k: int, value, chosen: list) -> int:
        n = 0
        for j, (_, other) in enumerate(chosen):
            for a, va, b, vb in ((j, other, k, value), (k, value, j, other)):
                image = allowed.get((a, b), {})
                n += va in image and image[va] != vb
        return n

    def go(k: int, chosen: list, trusts: list, breaks: int) -> None:
        if k == len(domains):
            best[0], best[1] = [p for p, _ in chosen], (-breaks, *worth(trusts, tiers))
            return
        for pos, (value, trust) in enumerate(domains[k]):
            rest = [*trusts, trust, *tops[k + 1 :]]
            if best[1] is not None and (-breaks, *worth(rest, tiers)) <= best[1]:
                return  # later values are trusted less
            more = breaks + broken(k, value, chosen)
            if best[1] is None or (-more, *worth(rest, tiers)) > best[1]:
                go(k + 1, [*chosen, (pos, value)], [*trusts, trust], more)

    go(0, [], [], 0)
    return best[0], best[1]


def solve(cands: Sequence, images: Sequence, sizes: dict[int, int], limit: int, tiers: Sequence[int]) -> tuple[list[int], int] | None:
    """(positions in cands of the chosen values, how many dependencies they break), or None if values beyond the limit
    might still win."""
    by: dict[int, list] = {}
    for at, c in enumerate(cands):
        by.setdefault(c["b"], []).append((c["sig"], (c["level"], c["time"], c["record"]), at))
    order = sorted(by)
    domains = [sorted(by[b], key=lambda x: x[1], reverse=True) for b in order]
    allowed: dict[tuple[int, int], dict] = {}
    for i in images:
        if i["a"] in by and i["b"] in by:
            allowed.setdefault((order.index(i["a"]), order.index(i["b"])), {})[i["va"]] = i["vb"]
    own = [tiers[b] for b in order]
    positions, value = branch_and_bound([[(v, t) for v, t, _ in d] for d in domains], allowed, own)
    tops = [d[0][1] for d in domains]
    for k, b in enumerate(order):
        if sizes.get(b, 0) > limit and (0, *worth([*tops[:k], domains[k][-1][1], *tops[k + 1 :]], own)) > value:
            return None
    return [domains[k][p][2] for k, p in enumerate(positions)], -value[0]


def _best(says: Column, *fields: Column) -> Column:
    return F.max(F.when(says, F.struct("level", "time", "record", *fields)))


def _top(values: DataFrame, key: str, limit: int) -> DataFrame:
    """The most trusted values of each bundle of each group, found in parts first."""
    trust = [F.desc("level"), F.desc("time"), F.desc("record")]
    part = F.pmod(F.xxhash64("sig"), F.lit(PARTS))
    some = values.withColumn("_part", part).withColumn("_r", F.row_number().over(W.partitionBy(key, "b", "_part").orderBy(*trust))).where(F.col("_r") <= limit)
    return some.withColumn("_r", F.row_number().over(W.partitionBy(key, "b").orderBy(*trust))).where(F.col("_r") <= limit).drop("_r", "_part")


def _branch(slim: DataFrame, key: str, bundles: list[Bundle], deps: list[Dependency]) -> DataFrame:
    """(key, broken, one struct (level, time, record) per bundle) of the groups in slim, searched by branching."""
    number = {b.name: i for i, b in enumerate(bundles)}
    tiers = [b.tier for b in bundles]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("b"), F.col(b.name).alias("sig")) for i, b in enumerate(bundles)))).alias("c")
    values = slim.select(key, "level", "time", "record", each).where(F.col("c.sig").isNotNull())
    values = values.groupBy(key, F.col("c.b").alias("b"), F.col("c.sig").alias("sig")).agg(F.max(F.struct("level", "time", "record")).alias("t"))
    ties = F.array(*(F.struct(F.lit(number[d.of]).alias("a"), F.lit(number[d.on_]).alias("b"), F.col(d.of).alias("va"), F.col(d.on_).alias("vb")) for d in deps))
    images = slim.select(key, "level", "time", "record", F.explode(ties).alias("d")).where(F.col("d.va").isNotNull() & F.col("d.vb").isNotNull())
    images = images.groupBy(key, F.col("d.a").alias("a"), F.col("d.b").alias("b"), F.col("d.va").alias("va")).agg(_best(F.lit(True), F.col("d.vb").alias("vb")).alias("m"))
    values, images = cut(values.select(key, "b", "sig", "t.*")), cut(images.select(key, "a", "b", "va", "m.vb"))

    @F.pandas_udf("at array<int>, broken int")
    def choose(cands: pd.Series, maps: pd.Series, most: pd.Series, limits: pd.Series) -> pd.DataFrame:
        found = [solve(c, [] if m is None else m, dict(enumerate(k)), q, tiers) for c, m, k, q in zip(cands, maps, most, limits)]
        return pd.DataFrame({"at": [f and f[0] for f in found], "broken": pd.array([f and f[1] for f in found], "Int32")})

    left, limit, chosen = values, FIRST_VALUES, None
    while True:
        sizes = left.groupBy(key).agg(F.array(*(F.count(F.when(F.col("b") == i, 1)).cast("int") for i in range(len(bundles)))).alias("sizes"))
        top = _top(left, key, limit)
        near = top.select(key, F.col("b").alias("a"), F.col("sig").alias("va")).join(images, [key, "a", "va"])
        maps = near.groupBy(key).agg(F.collect_list(F.struct("a", "b", "va", "vb")).alias("maps"))
        groups = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("b", "sig", "level", "time", "record"))).alias("cands")).join(sizes, key).join(maps, key, "left")
        solved = cut(groups.select(key, "cands", choose("cands", "maps", "sizes", F.lit(limit)).alias("s")))
        part = solved.where(F.col("s.at").isNotNull()).select(key, F.col("s.broken").alias("broken"), F.transform("s.at", lambda i: F.element_at("cands", i + 1)).alias("c"))
        chosen = part if chosen is None else chosen.unionByName(part)
        open_ = solved.where(F.col("s.at").isNull()).select(key)
        if open_.isEmpty():
            break
        left, limit = left.join(open_, key, "left_semi"), limit * 16
    pick = lambda i: F.element_at(F.filter("c", lambda c: c.b == i), 1)
    picks = [F.when(F.exists("c", lambda c: c.b == i), F.struct(*(pick(i)[x].alias(x) for x in ("level", "time", "record")))).alias(b.name) for i, b in enumerate(bundles)]
    return chosen.select(key, "broken", *picks)


def _tied(rows: DataFrame, key: str, bundles: list[Bundle], deps: list[Dependency]) -> DataFrame:
    """(key, broken, one struct (level, time, record) per bundle) of the bundles that dependencies tie together."""
    slim = rows.select(key, "level", "time", "record", *(F.col(f"value_{b.name}").alias(b.name) for b in bundles))
    slim = cut(slim.where(F.coalesce(*(F.col(b.name) for b in bundles)).isNotNull()))
    on = {b.name: [d.on_ for d in deps if d.of == b.name] for b in bundles}
    roots = slim.groupBy(key).agg(*(_best(F.col(b.name).isNotNull(), F.col(b.name).alias("mine"), *(F.col(x).alias(f"to_{x}") for x in on[b.name])).alias(b.name) for b in bundles))
    # The most trusted record of a value is the one that tells what goes with it, if it says both.
    sound = F.lit(True)
    for d in deps:
        sound = sound & F.coalesce(F.col(f"{d.of}.to_{d.on_}") == F.col(f"{d.on_}.mine"), F.col(d.of).isNull() | F.col(d.on_).isNull())
    roots = cut(roots.select(key, sound.alias("sound"), *(F.when(F.col(b.name).isNotNull(), F.struct(*(F.col(f"{b.name}.{x}").alias(x) for x in ("level", "time", "record")))).alias(b.name) for b in bundles)))
    closed = roots.where("sound").select(key, F.lit(0).alias("broken"), *(b.name for b in bundles))
    return closed.unionByName(_branch(slim.join(roots.where("not sound").select(key), key, "left_semi"), key, bundles, deps))


def chosen_records(df: DataFrame, key: str, record: str, level: Column, time: Column, bundles: list[Bundle], dependencies: Sequence[Dependency] = ()) -> DataFrame:
    """One row per key: first_record, last_record, broken (dependencies that no choice could keep) and per bundle a
    struct (level, time, record) of the record that supplies it.

    Trust is the level, then the time, then the record id; NULLs are trusted least. A bundle is NULL if no record of
    the group says it. Rows without a key or record id are left out; a row delivered twice changes nothing; groups of
    one record, empty tables and extra columns are no special case. Hot keys are aggregated before the shuffle."""
    tied = {n for d in dependencies for n in (d.of, d.on_)}
    value = lambda b: F.md5(F.to_json(F.struct(*(v.alias(n) for n, v in b.fields.items())), {"ignoreNullFields": "false"}))
    rows = df.where(F.col(key).isNotNull() & F.col(record).isNotNull()).select(
        F.col(key).alias("_key"), F.coalesce(level.cast("long"), F.lit(_UNKNOWN)).alias("level"), F.coalesce(time.cast("long"), F.lit(_UNKNOWN)).alias("time"), F.col(record).alias("record"),
        *(F.when(b.says, value(b)).alias(f"value_{b.name}") if b.name in tied else b.says.alias(f"says_{b.name}") for b in bundles),
    )
    best = rows.groupBy("_key").agg(
        F.min("record").alias("first_record"), F.max("record").alias("last_record"),
        *(_best(F.col(f"says_{b.name}")).alias(b.name) for b in bundles if b.name not in tied),
    )
    if tied:
        best = best.join(_tied(rows, "_key", [b for b in bundles if b.name in tied], list(dependencies)), "_key", "left")
    broken = F.coalesce("broken", F.lit(0)) if tied else F.lit(0)
    return best.select(F.col("_key").alias(key), "first_record", "last_record", broken.alias("broken"), *(b.name for b in bundles))


def surviving_records(df: DataFrame, key: str, record: str, level: Column, time: Column, bundles: list[Bundle], dependencies: Sequence[Dependency] = ()) -> DataFrame:
    """chosen_records with the fields of each bundle in its struct: (level, time, record, <fields>).

    The records are chosen by their ids; only chosen ones meet their fields again."""
    chosen = cut(chosen_records(df, key, record, level, time, bundles, dependencies))
    picks = F.explode(F.array(*(F.struct(F.col(f"{b.name}.record").alias("r"), F.lit(b.name).alias("b")) for b in bundles))).alias("p")
    wanted = chosen.select(key, picks).where(F.col("p.r").isNotNull()).groupBy(key, F.col("p.r").alias("record")).agg(F.collect_set("p.b").alias("_for"))
    full = df.where(F.col(key).isNotNull() & F.col(record).isNotNull()).select(
        key, F.col(record).alias("record"), *(F.when(b.says, F.struct(*(v.alias(n) for n, v in b.fields.items()))).alias(b.name) for b in bundles),
    )
    mine = wanted.join(full, [key, "record"]).groupBy(key).agg(*(F.max(F.when(F.array_contains("_for", b.name), F.col(b.name))).alias(f"_{b.name}") for b in bundles))
    whole = [F.when(F.col(b.name).isNotNull(), F.struct(*(F.col(f"{b.name}.{x}").alias(x) for x in ("level", "time", "record")), *(F.col(f"_{b.name}.{n}").alias(n) for n in b.fields))).alias(b.name) for b in bundles]
    return chosen.join(mine, key, "left").select(key, "first_record", "last_record", "broken", *whole)


def dependency_support(df: DataFrame, key: str, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(dependency, values, broken): for each named pair (of, on_) how many values of `of` occur with a value of `on_`
    in a group, and how many of them with several. Pairs that are hardly ever broken are dependencies to keep."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("dependency"), F.md5(F.to_json(F.struct(a.alias("v")))).alias("a"), F.when(a.isNotNull(), F.md5(F.to_json(F.struct(b.alias("v"))))).alias("b"), b.isNotNull().alias("both")) for n, (a, b) in pairs.items()))).alias("p")
    seen = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), each).where(F.col("p.b").isNotNull() & F.col("p.both"))
    seen = seen.groupBy("p.dependency", "k", "p.a").agg(F.min("p.b").alias("x"), F.max("p.b").alias("y"))
    return seen.groupBy("dependency").agg(F.count(F.lit(1)).alias("values"), F.count(F.when(F.col("x") != F.col("y"), 1)).alias("broken"))

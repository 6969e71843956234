"""The search pipeline: recall pool, details, admission, signals, ranking in all views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.operators.ingest import enrich, latest_online, merge_items, normalize_cards, normalize_details, normalize_online, pool_counters
from sift.operators.ranking import balanced_shortlist, rank_views, ranking_stats
from sift.operators.relevance import evaluate, matchable
from sift.operators.signals import all_signals
from sift.query import ParsedQuery, parse
from sift.session import cut, ship_package


@dataclass
class SearchResult:
    query: ParsedQuery
    ranked: DataFrame
    rejected: DataFrame
    stats: DataFrame
    pool: DataFrame | None = None


def search(items: DataFrame, query: str, now_ms: int, snapshots: DataFrame | None = None, online: DataFrame | None = None) -> SearchResult:
    """Rank canonical items. Relevance is evaluated once for all views; only accepted items are scored. An empty query
    raises ValueError."""
    parsed = parse(query)
    if not parsed.terms:
        raise ValueError("the query has no terms")
    evaluated = evaluate(items, parsed)
    accepted = evaluated.where("relevance.passes")
    rule = parsed.admission
    ranked = rank_views(all_signals(accepted, parsed, now_ms, snapshots, online))
    return SearchResult(parsed, ranked, evaluated.where("not relevance.passes"), ranking_stats(evaluated, rule.threshold, rule.min_coverage))


def search_cards(
    cards: DataFrame, query: str, now_ms: int, details: DataFrame | None = None, snapshots: DataFrame | None = None, samples: DataFrame | None = None,
    detail_limit: int | None = None,
) -> SearchResult:
    """The whole pipeline from raw cards. With detail_limit only the balanced shortlist of a first ranking gets
    details, as an interactive search with costly lookups would; else all items do (one equi-join)."""
    ship_package(cards.sparkSession)
    items = merge_items(normalize_cards(cards))
    if details is not None:
        known = normalize_details(details)
        if detail_limit is not None:
            items = cut(items)
            first = search(items, query, now_ms, snapshots).ranked
            known = known.join(balanced_shortlist(first, detail_limit).select("key"), "key", "left_semi")
        items = enrich(items, known)
    online = None if samples is None else latest_online(normalize_online(samples))
    result = search(matchable(items), query, now_ms, snapshots, online)
    result.pool = pool_counters(cards)
    return result


def search_many(items: DataFrame, queries: dict[str, str], now_ms: int, snapshots: DataFrame | None = None, online: DataFrame | None = None) -> DataFrame:
    """The rankings of several queries in one frame with a column query_id; texts are normalised once."""
    base, out = matchable(items), None
    for name, text in queries.items():
        ranked = search(base, text, now_ms, snapshots, online).ranked.withColumn("query_id", F.lit(name))
        out = ranked if out is None else out.unionByName(ranked)
    return out

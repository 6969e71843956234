"""All literals of matching, scoring and ranking."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values throughout: field strengths, anchors, weights, thresholds, labels.


@dataclass(frozen=True)
class Field:
    name: str
    label: str
    strength: float


@dataclass(frozen=True)
class Metric:
    name: str
    label: str
    weight: float
    anchor: float
    base_rate: float | None = None


@dataclass(frozen=True)
class View:
    name: str
    relevance: float
    signal: float
    quality: float


@dataclass(frozen=True)
class Admission:
    threshold: float
    min_coverage: float


@dataclass(frozen=True)
class HistoryPolicy:
    min_interval_ms: int = 30 * 60_000
    keep_snapshots: int = 16
    keep_items: int = 240
    max_age_ms: int = 30 * 86_400_000


FIELDS = (Field("title", "标题", 1.0), Field("tags", "标签", 0.78), Field("description", "简介", 0.48), Field("author", "UP主", 0.40), Field("category", "分区", 0.28))
CORE = ("title", "tags", "description")
ANCHORS = ("title", "tags")

QUALITY = (
    Metric("favorites", "收藏", 0.25, 2000, 0.012), Metric("coins", "投币", 0.20, 1000, 0.006), Metric("shares", "分享", 0.15, 500, 0.002), Metric("likes", "点赞", 0.15, 5000, 0.035),
    Metric("replies", "评论", 0.10, 300, 0.002), Metric("views", "播放", 0.10, 100_000), Metric("danmaku", "弹幕", 0.05, 1000, 0.006),
)
GROWTH = (
    Metric("views", "播放", 0.25, 100_000), Metric("likes", "点赞", 0.20, 5000), Metric("favorites", "收藏", 0.18, 2000), Metric("coins", "投币", 0.14, 1000),
    Metric("shares", "分享", 0.08, 500), Metric("replies", "评论", 0.07, 300), Metric("danmaku", "弹幕", 0.08, 1000),
)
VIEWS = (View("quality", 0.40, 0.60, 0.0), View("growth", 0.35, 0.55, 0.10), View("timeliness", 0.35, 0.55, 0.10))

SINGLE, SHORT, LONG = Admission(0.45, 1.0), Admission(0.35, 0.5), Admission(0.30, 0.4)
FUZZY, FUZZY_FACTOR, STRONG_FUZZY, RELAXED_COVERAGE = 0.74, 0.82, 0.85, 0.7
BAND, EPSILON = 0.05, 2.0**-52
PRIOR_VIEWS = 2000.0
MIN_SNAPSHOT_AGE_MS = 15 * 60_000
HISTORY = HistoryPolicy()

ROUTES = ("totalrank", "click", "pubdate", "stow", "dm")
ROUTE_LABELS = {"totalrank": "综合", "click": "播放", "pubdate": "最新", "stow": "收藏", "dm": "弹幕"}
PAGES, PAGE_SIZE, DETAIL_LIMIT, ONLINE_LIMIT, RESULTS_PER_PAGE = 3, 50, 60, 24, 24

STOP_WORDS = frozenset({
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with", "的", "了", "和", "与", "及", "或", "是", "在",
})
VERSION_WORDS = frozenset({
    "pro", "max", "ultra", "mini", "plus", "air", "se", "ti", "super", "xt", "edition", "mark", "mk", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "版", "代",
})

RISK_CODES = (-352, -412, -429, 412, 429)
#: Order in which characters of the two joined keys form the mixing key.
MIXIN_ORDER = (
    46, 47, 18, 2, 53, 8, 23, 32, 15, 50, 10, 31, 58, 3, 45, 35, 27, 43, 5, 49, 33, 9, 42, 19, 29, 28, 14, 39, 12, 38, 41, 13,
    37, 48, 7, 16, 24, 55, 40, 61, 26, 17, 0, 1, 60, 51, 30, 4, 22, 25, 54, 21, 56, 59, 6, 63, 57, 62, 11, 36, 20, 34, 44, 52,
)
#: Words of a query that ask for the recent.
RECENCY_WORDS = ("最新", "近期", "最近", "今日", "今天", "当下", "latest", "recent", "current")
#: Half-lives by what a query says about time, the first that applies: (condition, days, reason).
HALF_LIVES = (
    ("recent", 30, "查询包含明确的近期意图"), ("this year", 90, "查询包含当前年份"), ("long ago", 730, "历史主题采用较长时效半衰期"), ("anything", 180, "使用普通时效半衰期"),
)
#: Labels of every status that growth and online counts are known under; the engine itself gives the first of each.
GROWTH_LABELS = {
    "observed": "真实增速", "real": "真实增速", "measured": "真实增速", "actual": "真实增速", "estimated": "平均估算", "estimate": "平均估算", "average": "平均估算",
    "collecting": "积累中", "pending": "积累中", "unavailable": "积累中", "missing": "积累中",
}
ONLINE_LABELS = {"sampled": "在线已采样", "available": "在线已采样", "measured": "在线已采样", "missing": "在线采样缺失", "unavailable": "在线采样缺失", "skipped": "未采样在线人数", "pending": "在线采样中"}

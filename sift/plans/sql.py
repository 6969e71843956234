"""SQL twins of the scalar expressions, for checking queries on another engine."""

from __future__ import annotations

from sift.config import ANCHORS, CORE, FIELDS, FUZZY_FACTOR, GROWTH, QUALITY, RELAXED_COVERAGE, ROUTE_LABELS, ROUTES, STRONG_FUZZY, VERSION_WORDS, VIEWS
from sift.query import ParsedQuery, Term
from sift.query import compact as packed_query

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")


def half(x: str) -> str:
    return f"translate({x}, '{_FULL}', '{_HALF}')"


def strip(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name}' || chr(59), '{char}')"
    return f"trim(regexp_replace({x}, '[\\s　 ]+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({half(strip(x))}), '[^\\p{{L}}\\p{{N}}+#._-]+', ' ', 'g'))"


def compact(n: str) -> str:
    return f"regexp_replace({n}, '[\\s._-]+', '', 'g')"


def url(x: str) -> str:
    return f"CASE WHEN {x} LIKE '//%' THEN 'https:' || {x} WHEN {x} LIKE 'http://%' THEN 'https://' || substr({x}, 8) WHEN {x} LIKE 'https://%' THEN {x} ELSE '' END"


def seconds(x: str) -> str:
    return f"CASE WHEN trim({x}) <> '' THEN list_reduce(list_transform(string_split(trim({x}), ':'), lambda p: p::DOUBLE), lambda a, b: a * 60 + b) END"


def label(s: str) -> str:
    s = f"({s})::BIGINT"
    return (
        f"CASE WHEN {s} IS NULL THEN '' WHEN {s} >= 3600 THEN ({s} // 3600)::VARCHAR || ':' || lpad(({s} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0') "
        f"ELSE ({s} // 60)::VARCHAR || ':' || lpad(({s} % 60)::VARCHAR, 2, '0') END"
    )


def case(x: str, pairs: dict, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" if isinstance(v, str) else f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + f" ELSE {other} END"


ROUTE = case("route", ROUTE_LABELS, "coalesce(route, '未知')")
RANK = case("route", {r: i for i, r in enumerate(ROUTES)}, str(len(ROUTES)))
STATS = ("views", "likes", "favorites", "replies", "danmaku", "coins", "shares")

CARDS = f"""
cards AS (
  SELECT trim(bvid) AS key, {RANK} AS r, page AS p, position AS i, card_id AS c, {strip("title")} AS title, {strip("description")} AS description,
    list_filter(list_transform(regexp_split_to_array(coalesce(tag, ''), '[,，]'), lambda t: {strip("t")}), lambda t: t <> '') AS tags, {strip("typename")} AS category,
    {url("pic")} AS "coverUrl", {seconds("duration")} AS "durationSeconds", CASE WHEN trim(duration) <> '' THEN trim(duration) ELSE '' END AS "durationText",
    pubdate * 1000 AS "publishedAt", {strip("author")} AS author, mid, aid, play::DOUBLE AS views, nullif("like", 0)::DOUBLE AS likes, nullif(favorites, 0)::DOUBLE AS favorites,
    review::DOUBLE AS replies, danmaku::DOUBLE AS danmaku, NULL::DOUBLE AS coins, NULL::DOUBLE AS shares, coalesce(route, 'unknown') AS "order", {ROUTE} AS order_label, coalesce(page, 1) AS page, position
  FROM search_cards WHERE type = 'video' AND coalesce(bvid, '') <> '')
"""
_ORDER = "ORDER BY r, p, i, c"


def _long(x: str) -> str:
    return f"first({x} ORDER BY length({x}) DESC, r, p, i, c)"


def _text(x: str) -> str:
    return f"coalesce(first({x} {_ORDER}) FILTER ({x} <> ''), '')"


MERGED = (
    CARDS
    + f""",
base AS (
  SELECT key, count(*) AS records, {_long("title")} AS title, {_long("description")} AS description, {_text("category")} AS category, {_text('"coverUrl"')} AS "coverUrl", {_text('"durationText"')} AS "durationText",
    {_text("author")} AS author, first("durationSeconds" {_ORDER}) FILTER ("durationSeconds" IS NOT NULL) AS "durationSeconds", first("publishedAt" {_ORDER}) FILTER ("publishedAt" IS NOT NULL) AS "publishedAt",
    first(mid {_ORDER}) FILTER (mid IS NOT NULL) AS mid, first(aid {_ORDER}) AS aid, {", ".join(f"max({m}) AS {m}" for m in STATS)}
  FROM cards GROUP BY key),
tag_rows AS (SELECT key, r, p, i, c, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM cards),
tag_first AS (SELECT key, tag, min((r, p, i, c, k)) AS seen FROM tag_rows GROUP BY key, tag),
tag_lists AS (SELECT key, list(tag ORDER BY seen) AS tags FROM tag_first GROUP BY key),
source_lists AS (SELECT key, count(DISTINCT ("order", page, position)) AS n_sources, count(DISTINCT order_label) AS n_routes FROM cards GROUP BY key),
merged AS (SELECT base.*, coalesce(tags, []) AS tags, n_sources, n_routes FROM base LEFT JOIN tag_lists USING (key) LEFT JOIN source_lists USING (key))
"""
)
_STAT = {"views": "view", "likes": "like", "favorites": "favorite", "replies": "reply", "danmaku": "danmaku", "coins": "coin", "shares": "share"}


def _fill(c: str, d: str) -> str:
    return f"CASE WHEN m.{c} = '' THEN coalesce({d}, m.{c}) ELSE m.{c} END AS {c}"


ENRICHED = (
    MERGED
    + f""",
items AS (
  SELECT m.key, m.tags, m.category, m.n_routes, {_fill("title", strip("d.title"))}, {_fill("description", strip('d."desc"'))}, {_fill("author", strip("d.owner.name"))}, coalesce(m."publishedAt", d.pubdate * 1000) AS "publishedAt",
    {", ".join(f'coalesce(d.stat."{v}"::DOUBLE, m.{k}) AS {k}' for k, v in _STAT.items())}, CASE WHEN d.bvid IS NULL THEN 'unavailable' ELSE 'complete' END AS detail
  FROM merged m LEFT JOIN video_details d ON d.bvid = m.key)
"""
)


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def sigmoid(x: str, anchor: float, k: float = 1.15) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 1.0 / (1.0 + exp(-{k} * ln((({x}) + 1.0) / {anchor + 1.0}))) END)"


def average(parts: list[tuple[str, float]]) -> str:
    top = " + ".join(f"coalesce(({v}) * {w}, 0)" for v, w in parts)
    return f"(({top}) / nullif({weights(parts)}, 0))"


def weights(parts: list[tuple[str, float]]) -> str:
    return "(" + " + ".join(f"CASE WHEN ({v}) IS NOT NULL THEN {w}::DOUBLE ELSE 0::DOUBLE END" for v, w in parts) + ")"


def quality() -> str:
    counts = [(f"cs_{m.name}", m.weight) for m in QUALITY]
    rates = [(f"rs_{m.name}", m.weight) for m in QUALITY if m.base_rate is not None]
    one = ", ".join(f"{sigmoid(m.name, m.anchor)} AS cs_{m.name}" for m in QUALITY)
    smooth = lambda m: f"(({m.name} + 2000.0 * {m.base_rate}) / greatest(1.0, greatest(views, {m.name}, 0.0) + 2000.0))"
    two = ", ".join(f"CASE WHEN views IS NOT NULL AND {m.name} IS NOT NULL THEN {clamp(f'{smooth(m)} / ({smooth(m)} + {m.base_rate})')} END AS rs_{m.name}" for m in QUALITY if m.base_rate is not None)
    return f"""
q1 AS (SELECT *, {one}, {two} FROM items),
q2 AS (SELECT *, coalesce({average(counts)}, 0.5) AS q_abs, coalesce({average(rates)}, 0.5) AS q_rate, {clamp(f"0.65 * {weights(counts)} + 0.35 * ({weights(rates)} / {sum(w for _, w in rates)})")} AS q_full FROM q1),
scored_q AS (SELECT *, {clamp("0.5 + (0.65 * q_abs + 0.35 * q_rate - 0.5) * (0.35 + 0.65 * q_full)")} AS quality FROM q2)"""


def growth(now_ms: int) -> str:
    life = [(f"l_{m.name}", m.weight) for m in GROWTH]
    seen = [(f"o_{m.name}", m.weight) for m in GROWTH]
    both = [(f"CASE WHEN o_{m.name} IS NULL THEN l_{m.name} WHEN l_{m.name} IS NULL THEN o_{m.name} ELSE 0.7 * o_{m.name} + 0.3 * l_{m.name} END", m.weight) for m in GROWTH]
    then = lambda m: f"greatest(0.0, s_stats.{m.name})"
    one = ", ".join(f"{sigmoid(f'{m.name} / age', m.anchor)} AS l_{m.name}, {sigmoid(f'CASE WHEN s_stats.{m.name} IS NOT NULL AND days > 0 AND {m.name} >= {then(m)} THEN ({m.name} - {then(m)}) / days END', m.anchor)} AS o_{m.name}" for m in GROWTH)
    return f"""
snaps AS (SELECT bvid, snapshot_id, stats, CASE WHEN "capturedAt" < 10000000000 THEN "capturedAt" * 1000 ELSE "capturedAt" END AS t_ms FROM snapshots WHERE "capturedAt" > 0),
latest AS (SELECT bvid, max(t_ms) AS s_at, first(stats ORDER BY t_ms DESC, snapshot_id DESC) AS s_stats FROM snaps WHERE t_ms <= {now_ms - 900_000} AND bvid IS NOT NULL GROUP BY bvid),
g0 AS (SELECT q.*, s_at, s_stats, ({now_ms} - s_at) / 86400000.0::DOUBLE AS days, CASE WHEN "publishedAt" > 0 AND "publishedAt" <= {now_ms} THEN greatest(1.0::DOUBLE / 24, ({now_ms} - "publishedAt") / 86400000.0::DOUBLE) END AS age FROM scored_q q LEFT JOIN latest s ON s.bvid = q.key),
g1 AS (SELECT *, {one} FROM g0),
g2 AS (SELECT *, {weights(seen)} AS g_seen, {weights(life)} AS g_life, ({now_ms} - s_at) / 3600000.0::DOUBLE AS g_hours, coalesce({average(both)}, 0.5) AS g_both, coalesce({average(life)}, 0.5) AS g_mean FROM g1),
g3 AS (SELECT *, CASE WHEN g_seen > 0 THEN 'observed' WHEN g_life > 0 THEN 'estimated' ELSE 'unavailable' END AS g_status, CASE WHEN g_seen > 0 THEN {clamp("(0.65 + 0.35 * greatest(0.25, least(1.0, g_hours / 6.0))) * g_seen")} ELSE 0.35 * g_life END AS g_trust FROM g2),
scored_g AS (SELECT *, CASE WHEN g_seen > 0 THEN {clamp("0.5 + (g_both - 0.5) * g_trust")} WHEN g_life > 0 THEN {clamp("0.5 + (g_mean - 0.5) * g_trust")} ELSE 0.5 END AS growth FROM g3)"""


def strict_online(x: str) -> str:
    bare = f"replace(trim({x}), ',', '')"
    form = r"^(\d+(?:\.\d+)?)\s*([万亿]?)\s*(\+)?$"
    unit = f"CASE regexp_extract({bare}, '{form}', 2) WHEN '亿' THEN 100000000.0 WHEN '万' THEN 10000.0 ELSE 1.0 END"
    return f"CASE WHEN regexp_matches({bare}, '{form}') THEN floor(regexp_extract({bare}, '{form}', 1)::DOUBLE * {unit} + 0.5)::DOUBLE END"


def timeliness(now_ms: int, days: int) -> str:
    return f"""
samples AS (SELECT bvid, sample_id, sampled_at, CASE WHEN coalesce(show_switch.total, true) THEN {strict_online("total")} END AS total, CASE WHEN coalesce(show_switch."count", true) THEN {strict_online('"count"')} END AS web FROM online_samples WHERE bvid IS NOT NULL),
online AS (SELECT bvid, first(coalesce(total, web) ORDER BY sampled_at DESC, sample_id DESC) AS online FROM samples GROUP BY bvid),
t1 AS (SELECT g.*, online, CASE WHEN age IS NOT NULL THEN least(1.0, pow(2.0::DOUBLE, -age / {days}.0)) END AS recency, {sigmoid("online", 500.0, 1.0)} AS heat FROM scored_g g LEFT JOIN online o ON o.bvid = g.key),
scored AS (SELECT *, {clamp("0.65 * coalesce(recency, 0.5) + 0.35 * coalesce(heat, 0.5)")} AS timeliness FROM t1)"""


def exact(t: Term, n: str, c: str) -> str:
    """Whether a term occurs as such in a normalised text and its compact form."""
    k = t.compact
    if not all(x.isascii() and (x.isalnum() or x in "+#._-") for x in k):
        return f"contains({c}, '{k}')"
    if k.isdigit():
        return f"regexp_matches({n}, '(^|[^0-9]){k}([^0-9]|$)')"
    if k.isalpha() and t.text.isascii() and t.text.isalpha():
        return f"regexp_matches({n}, '(^|[^a-z]){k}([^a-z]|$)')"
    left, quoted = "[^a-z]" if k[0].isalpha() else "[^a-z0-9]", [f"[{x}]" for x in k]
    loose = "[\\s._-]*".join(quoted)
    return f"(regexp_matches({n}, '(^|{left}){loose}([^a-z0-9]|$)') OR regexp_matches({c}, '(^|{left}){''.join(quoted)}([^a-z0-9]|$)'))"


def similar(t: Term, c: str) -> str:
    """Similarity of a term to the windows of a compact text from 0.74 up, else 0. DuckDB's distance counts bytes, so the
    term's letters are mapped to one byte each and all other wide letters to another."""
    k = t.compact
    if len(k) < 3 or (k.isascii() and (k.isdigit() or (k.isalpha() and len(k) < 5))):
        return "0.0::DOUBLE"
    wide = "".join(sorted({x for x in k if not x.isascii()}))
    signs = "".join(map(chr, range(0x41, 0x41 + len(wide))))  # texts are in lower case
    needle = k.translate(str.maketrans(wide, signs))
    hay = f"regexp_replace(translate({c}, '{wide}', '{signs}'), '[^\\x00-\\x7F]', '~', 'g')"
    windows = ", ".join(f"list_max(list_transform(range(1, length(h) + 1), lambda i: 1 - levenshtein('{needle}', substr(h, i, {w})) / greatest({len(k)}, length(substr(h, i, {w})))::DOUBLE))" for w in (len(k) - 1, len(k), len(k) + 1))
    near = f"(SELECT CASE WHEN contains(h, '{needle}') THEN 1.0 WHEN length(h) BETWEEN 1 AND 2000 THEN greatest({windows}) ELSE 0.0 END FROM (SELECT {hay} AS h))"
    return f"(SELECT CASE WHEN x >= 0.74 THEN x ELSE 0.0 END FROM (SELECT {near}::DOUBLE AS x))"


def relevance_of(q: ParsedQuery, source: str = "scored") -> str:
    """Relevance of any query, as CTEs ending in judged (relevance, coverage, passes, reasons)."""
    texts = {"title": "title", "tags": "array_to_string(tags, ' ')", "description": "description", "author": "author", "category": "category"}
    texts["all"] = "concat_ws(' ', " + ", ".join(f"coalesce({x}, '')" for x in texts.values()) + ")"
    names, every = [f.name for f in FIELDS], range(len(q.terms))
    forms = ", ".join(f"{norm(x)} AS n_{k}" for k, x in texts.items())
    packed = ", ".join(f"{compact(f'n_{k}')} AS c_{k}" for k in texts)
    hit = lambda t, f: exact(t, f"n_{f}", f"c_{f}")
    hits = ", ".join(f"{hit(q.terms[i], f)} AS e{i}_{f}" for i in every for f in names)
    near = ", ".join(f"CASE WHEN e{i}_{f} THEN 0.0 ELSE {similar(q.terms[i], f'c_{f}')} END AS s{i}_{f}" for i in every for f in names)
    conf = lambda i, f: f"(CASE WHEN e{i}_{f} THEN 1.0 ELSE s{i}_{f} * {FUZZY_FACTOR} END)::DOUBLE"
    most = lambda i, fields: "greatest(" + ", ".join(conf(i, f) for f in fields) + ")"
    total = sum(t.weight for t in q.terms)
    mean = lambda of: "(" + " + ".join(f"{q.terms[i].weight}::DOUBLE * {of(i)}" for i in every) + f") / {total}::DOUBLE"
    any_ = lambda xs: "(" + " OR ".join([*xs, "false"]) + ")"
    whole = Term(q.normalized, q.compact)
    cascade = [
        (hit(whole, "title"), "1.0", "title"), (hit(whole, "tags"), "0.75", "tags"), (hit(whole, "description"), "0.65", "description"),
        (f"c_author = '{q.compact}'", "0.55", "author"), (f"c_category = '{q.compact}'", "0.35", "category"),
    ]
    if len(q.terms) > 1:
        cascade.append((f"regexp_matches(c_title, '(?s){'.*'.join(''.join(f'[{x}]' for x in t.compact) for t in q.terms)}')", "0.58", "title"))
    if len(q.compact) >= 4:
        grams = [q.compact[i : i + 2] for i in range(len(q.compact) - 1)]
        share = f"(CASE WHEN contains(c_title, '{q.compact}') THEN 1.0 ELSE (" + " + ".join(f"contains(c_title, '{g}')::INT" for g in grams) + f") / {len(grams)}.0 END)::DOUBLE"
        cascade.append((f"{share} >= 0.65", f"least(0.45, {share} * 0.5)", "title"))
    phrase = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v, _ in cascade) + " ELSE 0.0 END"
    field = "CASE " + " ".join(f"WHEN {c} THEN '{f}'" for c, _, f in cascade) + " ELSE '' END"
    at = [(f"strpos(c_title, '{t.compact}')", len(t.compact)) for t in q.terms]
    found, length = (" + ".join(f"CASE WHEN {p} > 0 THEN {v} ELSE 0 END" for p, v in ((p, 1 if one else n) for p, n in at)) for one in (True, False))
    first = "least(" + ", ".join(f"CASE WHEN {p} > 0 THEN {p} END" for p, _ in at) + ")"
    last = "greatest(" + ", ".join(f"CASE WHEN {p} > 0 THEN {p} + {n} END" for p, n in at) + ")"
    close = "1.0" if len(q.terms) < 2 else f"CASE WHEN ({found}) < 2 THEN 0.0 ELSE {clamp(f'(({length})::DOUBLE / greatest(1, {last} - {first})) * (({found}) / {len(q.terms)}.0::DOUBLE)')} END"
    primary, extra = [i for i in every if not q.terms[i].auxiliary], [i for i in every if q.terms[i].auxiliary]
    anchor = lambda i: any_(f"e{i}_{f}" for f in ANCHORS)
    single = len(primary) == 1
    strong = any_(f"s{primary[0]}_{f} >= {STRONG_FUZZY}" for f in ANCHORS) if single and len(q.terms[primary[0]].compact) >= 5 else "false"
    pairs = f"({' + '.join(f'{anchor(i)}::INT' for i in extra)}) >= 2" if single and extra else "false"
    models = [i for i in every if any(c.isdigit() for c in q.terms[i].text) or q.terms[i].text in VERSION_WORDS]
    model = " AND ".join([*(any_(f"e{i}_{f}" for f in CORE) for i in models), "true"])
    phrases = " AND ".join([*(any_(hit(Term(p, packed_query(p)), f) for f in (*CORE, "author")) for p in q.phrases), "true"])
    negative = "CASE " + " ".join(f"WHEN {hit(t, 'all')} THEN '{t.text}'" for t in q.negatives) + " END" if q.negatives else "NULL::VARCHAR"
    rules = q.admission
    least = f"CASE WHEN NOT exact_anchor AND strong THEN {RELAXED_COVERAGE} ELSE {rules.min_coverage} END" if q.effective_terms == 1 else f"{rules.min_coverage}"
    return f"""
r1 AS (SELECT *, {forms} FROM {source}), r2 AS (SELECT *, {packed} FROM r1), r3 AS MATERIALIZED (SELECT *, {hits} FROM r2), r4 AS MATERIALIZED (SELECT *, {near} FROM r3),
r5 AS (SELECT *, {mean(lambda i: most(i, names))} AS coverage, {mean(lambda i: "greatest(" + ", ".join(f"{conf(i, f.name)} * {f.strength}" for f in FIELDS) + ")")} AS field_score, {mean(lambda i: conf(i, "title"))} AS title_coverage,
  ({phrase})::DOUBLE AS phrase, {field} = 'author' AS by_author, ({close})::DOUBLE AS proximity, {any_(anchor(i) for i in primary)} AS exact_anchor, {strong} AS strong, {pairs} AS pairs, {model} AS model, {phrases} AS phrased, {negative} AS negative FROM r4),
r6 AS (SELECT *, {clamp("0.5 * field_score + 0.25 * coverage + 0.13 * title_coverage + 0.08 * phrase + 0.04 * proximity + CASE WHEN by_author THEN 0.06 ELSE 0.0 END")}::DOUBLE AS relevance, ({least})::DOUBLE AS least_coverage FROM r5),
r7 AS (SELECT *, concat_ws('|', CASE WHEN negative IS NOT NULL THEN '命中排除词“' || negative || '”' END, CASE WHEN relevance < {rules.threshold} THEN '相关性低于 {round(rules.threshold * 100)} 分' END,
  CASE WHEN coverage < least_coverage THEN '关键词覆盖低于 ' || floor(least_coverage * 100 + 0.5)::INT || '%' END, CASE WHEN NOT (exact_anchor OR by_author OR strong OR pairs) THEN '至少一个核心词须精确命中标题或标签' END,
  CASE WHEN NOT phrased THEN '引号中的短语未精确命中允许字段' END, CASE WHEN NOT (by_author OR model) THEN '数字、年份或型号词未在核心字段精确命中' END) AS reasons FROM r6),
judged AS (SELECT *, reasons = '' AS passes FROM r7)"""


def ranked() -> str:
    views = ", ".join(f"({i}, '{v.name}', {v.relevance}, {v.signal}, {v.quality})" for i, v in enumerate(VIEWS))
    return f"""
views AS (SELECT * FROM (VALUES {views}) AS t(view_index, view, w_r, w_s, w_q)),
k1 AS (SELECT j.*, v.*, least(19, floor((relevance + 2.220446049250313e-16) / 0.05))::INT AS band, CASE view WHEN 'growth' THEN growth WHEN 'timeliness' THEN timeliness ELSE quality END AS signal FROM judged j CROSS JOIN views v WHERE passes),
k2 AS (SELECT *, {clamp("(relevance - band * 0.05) / 0.05")} AS band_position FROM k1),
k3 AS (SELECT *, w_r * band_position + w_s * signal + w_q * quality AS inner_score FROM k2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY band DESC, inner_score DESC, relevance DESC, signal DESC, quality DESC, key) AS position FROM k3)"""

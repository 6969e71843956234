"""Relevance of items to a query with explanations, and the hard admission gate.

Texts are normalised once into n_* and c_* columns; terms are literals, so every predicate is a built-in expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.config import ANCHORS, BAND, CORE, EPSILON, FIELDS, FUZZY, FUZZY_FACTOR, RELAXED_COVERAGE, STRONG_FUZZY, VERSION_WORDS
from sift.functions.numbers import clamp
from sift.functions.text import compact_text, java_literal, ngram_containment, normalize_text, ordered_terms, substring_similarity
from sift.query import ParsedQuery, Term, compact, parse
from sift.session import stage


def field_text(name: str) -> Column:
    if name == "tags":
        return F.coalesce(F.array_join("tags", " "), F.lit(""))
    return F.coalesce(F.col("author.name" if name == "author" else name), F.lit(""))


def matchable(items: DataFrame) -> DataFrame:
    """items plus the normalised (n_<field>) and compact (c_<field>) form of each field. Do this once per corpus."""
    normal = stage(items.withColumns({f"n_{f.name}": normalize_text(field_text(f.name)) for f in FIELDS} | {"n_all": normalize_text(F.concat_ws(" ", *(field_text(f.name) for f in FIELDS)))}))
    return stage(normal.withColumns({f"c_{f.name}": compact_text(F.col(f"n_{f.name}")) for f in FIELDS} | {"c_all": compact_text(F.col("n_all"))}))


def _word(text: str) -> bool:
    return bool(text) and all(c.isascii() and (c.isalnum() or c in "+#._-") for c in text)


def exact_term(term: Term, normal: Column, packed: Column) -> Column:
    """Whether a literal term occurs as such: CJK as a substring, digits between non-digits, letters between
    non-letters, mixed models with free separators inside and strict boundaries."""
    t = term.compact
    if not t:
        return F.lit(False)
    if not _word(t):
        return packed.contains(t)
    if t.isdigit():
        return normal.rlike(f"(^|[^0-9]){t}([^0-9]|$)")
    if t.isalpha() and term.text.isascii() and term.text.isalpha():
        return normal.rlike(f"(?i)(^|[^a-z]){t}([^a-z]|$)")
    left = "[^a-z]" if t[0].isalpha() else "[^a-z0-9]"
    loose = "[\\s._-]*".join(java_literal(c) for c in t)
    return normal.rlike(f"(?i)(^|{left}){loose}([^a-z0-9]|$)") | packed.rlike(f"(?i)(^|{left}){java_literal(t)}([^a-z0-9]|$)")


def _may_be_fuzzy(t: str) -> bool:
    return not (t.isascii() and t.isdigit()) and len(t) >= 3 and not (t.isascii() and t.isalpha() and len(t) < 5)


def term_match(term: Term, field: str, prefilter: bool = True) -> tuple[Column, Column]:
    """(exact, similarity) of a literal term in a field; similarity is 0 where the fuzzy path doesn't run or misses."""
    normal, packed = F.col(f"n_{field}"), F.col(f"c_{field}")
    exact = exact_term(term, normal, packed)
    if not _may_be_fuzzy(term.compact):
        return exact, F.lit(0.0)
    near = substring_similarity(term.compact, packed, FUZZY, prefilter)
    return exact, F.when(exact, 0.0).otherwise(F.when(near >= FUZZY, near).otherwise(0.0))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def _phrase(query: ParsedQuery) -> Column:
    """struct(score, reason, field) of the first rule that fits the whole query."""
    whole = Term(query.normalized, query.compact)
    rule = lambda s, r, f: F.struct(F.lit(s).cast("double").alias("score"), F.lit(r).alias("reason"), F.lit(f).alias("field"))
    hit = lambda f: exact_term(whole, F.col(f"n_{f}"), F.col(f"c_{f}"))
    out = F.when(hit("title"), rule(1.0, "完整查询命中标题", "title")).when(hit("tags"), rule(0.75, "完整查询命中标签", "tags")).when(hit("description"), rule(0.65, "完整查询命中简介", "description"))
    if query.compact:
        out = out.when(F.col("c_author") == query.compact, rule(0.55, "查询精确命中 UP 主", "author")).when(F.col("c_category") == query.compact, rule(0.35, "查询精确命中分区", "category"))
    out = out.when(ordered_terms([t.compact for t in query.terms], F.col("c_title")), rule(0.58, "查询词按顺序出现在标题", "title"))
    if len(query.compact) >= 4:
        near = ngram_containment(query.compact, F.col("c_title"))
        out = out.when(near >= 0.65, F.struct(F.least(F.lit(0.45), near * 0.5).alias("score"), F.lit("标题与查询具有较高字面邻近度").alias("reason"), F.lit("title").alias("field")))
    return out.otherwise(rule(0.0, "", ""))


def _proximity(query: ParsedQuery) -> Column:
    if len(query.terms) < 2:
        return F.lit(1.0)
    at = [(F.instr(F.col("c_title"), t.compact), len(t.compact)) for t in query.terms]
    found = sum((F.when(p > 0, 1).otherwise(0) for p, _ in at), F.lit(0))
    length = sum((F.when(p > 0, n).otherwise(0) for p, n in at), F.lit(0))
    first = F.least(*(F.when(p > 0, p) for p, _ in at))
    last = F.greatest(*(F.when(p > 0, p + n) for p, n in at))
    return F.when(found < 2, 0.0).otherwise(clamp(length / F.greatest(F.lit(1), last - first) * (found / float(len(query.terms)))))


def evaluate(items: DataFrame, query: str | ParsedQuery, prefilter: bool = True) -> DataFrame:
    """items (with matchable's columns, added if missing) plus struct `relevance`:

    value, coverage, core_coverage, title_coverage, phrase, threshold, min_coverage, effective_terms, passes,
    matched_terms (term, confidence, fields, fuzzy), missing_terms, positive_reasons, negative_reasons,
    rejection_reasons. A query without terms gives value 0 and rejects every item. Map-only."""
    q = parse(query) if isinstance(query, str) else query
    rows = items if "c_all" in items.columns else matchable(items)
    texts = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    if not q.terms:
        none, why = F.array().cast("array<string>"), F.array(F.lit("查询中没有可评分的关键词"))
        empty = F.array().cast("array<struct<term:string,confidence:double,fields:array<string>,fuzzy:boolean>>")
        return rows.withColumn("relevance", F.struct(
            F.lit(0.0).alias("value"), F.lit(0.0).alias("coverage"), F.lit(None).cast("double").alias("core_coverage"), F.lit(0.0).alias("title_coverage"),
            F.lit(None).cast("struct<score:double,reason:string,field:string>").alias("phrase"), F.lit(1.0).alias("threshold"), F.lit(1.0).alias("min_coverage"), F.lit(0).alias("effective_terms"),
            F.lit(False).alias("passes"), empty.alias("matched_terms"), none.alias("missing_terms"), none.alias("positive_reasons"), why.alias("negative_reasons"), why.alias("rejection_reasons"),
        ))
    # Stage 1: one struct per term and field, so that no similarity is computed twice.
    matched = {}
    for i, term in enumerate(q.terms):
        for f in FIELDS:
            exact, near = term_match(term, f.name, prefilter)
            matched[f"m{i}_{f.name}"] = F.struct(exact.alias("e"), near.alias("s"))
    rows = stage(rows.withColumns(matched | {"_phrase": _phrase(q), "_near": _proximity(q)}))
    e = lambda i, f: F.col(f"m{i}_{f}.e")
    s = lambda i, f: F.col(f"m{i}_{f}.s")
    conf = lambda i, f: F.when(e(i, f), 1.0).otherwise(s(i, f) * FUZZY_FACTOR)
    names = [f.name for f in FIELDS]
    every = range(len(q.terms))
    best = {i: F.greatest(*(conf(i, f) for f in names)) for i in every}
    total = sum(t.weight for t in q.terms) or 1.0
    mean = lambda of: sum((F.lit(q.terms[i].weight) * of(i) for i in every), F.lit(0.0)) / total
    rows = stage(rows.withColumns({
        "_coverage": mean(lambda i: best[i]), "_field": mean(lambda i: F.greatest(*(conf(i, f.name) * f.strength for f in FIELDS))),
        "_title": mean(lambda i: conf(i, "title")), "_core": mean(lambda i: F.greatest(*(conf(i, f) for f in CORE))),
    }))
    author = (F.col("_phrase.field") == "author") & (F.col("_phrase.score") > 0)
    value = clamp(0.5 * F.col("_field") + 0.25 * F.col("_coverage") + 0.13 * F.col("_title") + 0.08 * F.col("_phrase.score") + 0.04 * F.col("_near") + F.when(author, 0.06).otherwise(0.0))
    primary = [i for i in every if not q.terms[i].auxiliary]
    extra = [i for i in every if q.terms[i].auxiliary]
    anchor = lambda i: _any([e(i, f) for f in ANCHORS])
    exact_anchor = _any([anchor(i) for i in primary])
    strong = F.lit(False)
    if len(primary) == 1 and len(q.terms[primary[0]].compact) >= 5:
        strong = _any([s(primary[0], f) >= STRONG_FUZZY for f in ANCHORS])
    pairs = F.lit(False)
    if len(primary) == 1 and extra:
        pairs = sum((F.when(anchor(i), 1).otherwise(0) for i in extra), F.lit(0)) >= 2
    core = exact_anchor | author | strong | pairs
    models = [i for i in every if any(c.isdigit() for c in q.terms[i].text) or q.terms[i].text in VERSION_WORDS]
    model = author | _all([_any([e(i, f) for f in CORE]) for i in models])
    phrases = _all([_any([exact_term(Term(p, compact(p)), F.col(f"n_{f}"), F.col(f"c_{f}")) for f in (*CORE, "author")]) for p in q.phrases])
    negative = F.lit(None).cast("string")
    for t in q.negatives:
        negative = F.coalesce(negative, F.when(exact_term(t, F.col("n_all"), F.col("c_all")), F.lit(t.text)))
    rules = q.admission
    least = F.lit(rules.min_coverage)
    if q.effective_terms == 1:
        least = F.when(~exact_anchor & strong, RELAXED_COVERAGE).otherwise(least)
    rows = stage(rows.withColumns({"_value": value, "_least": least, "_negative": negative}))
    rejected = texts([
        F.when(
            F.col("_negative").isNotNull(), F.concat(F.lit("命中排除词“"), F.col("_negative"), F.lit("”")),
        ), F.when(F.col("_value") < rules.threshold, F.lit(f"相关性低于 {round(rules.threshold * 100)} 分")),
        F.when(F.col("_coverage") < F.col("_least"), F.format_string("关键词覆盖低于 %d%%", F.floor(F.col("_least") * 100 + 0.5).cast("int"))), F.when(~core, F.lit("至少一个核心词须精确命中标题或标签")),
        F.when(~phrases, F.lit("引号中的短语未精确命中允许字段")), F.when(~model, F.lit("数字、年份或型号词未在核心字段精确命中")),
    ])
    in_title = [conf(i, "title") > 0 for i in every]
    titles, n = sum((F.when(x, 1).otherwise(0) for x in in_title), F.lit(0)), len(q.terms)
    positive = texts([
        F.when(F.col("_phrase.reason") != "", F.col("_phrase.reason")),
        F.when(titles == n, F.lit(f"标题命中全部 {n} 个词项")).when(
            titles > 0, F.concat(F.lit("标题命中 "), titles.cast("string"), F.lit(f"/{n} 个词项")),
        ), F.when(F.col("_coverage") >= 0.99, F.lit("关键词覆盖完整")),
    ])
    missing = texts([F.when(best[i] <= 0, F.lit(q.terms[i].text)) for i in primary])
    aside = texts([F.when((best[i] > 0) & ~in_title[i], F.lit(q.terms[i].text)) for i in every])
    fuzzy = {i: _any([s(i, f) > 0 for f in names]) for i in every}
    notes = texts([
        F.when(F.size(missing) > 0, F.concat(F.lit("未命中："), F.array_join(missing, "、"))), F.when(F.size(aside) > 0, F.concat(F.lit("仅在非标题字段命中："), F.array_join(aside, "、"))),
        F.when(_any(list(fuzzy.values())), F.lit("包含有限近似匹配")),
    ])
    hits = F.array_compact(F.array(*(F.when(best[i] > 0, F.struct(F.lit(q.terms[i].text).alias("term"), best[i].alias("confidence"), F.array_compact(F.array(*(F.when(conf(i, f.name) > 0, F.lit(f.label)) for f in FIELDS))).alias("fields"), fuzzy[i].alias("fuzzy"))) for i in primary)))
    relevance = F.struct(
        F.col("_value").alias("value"), F.col("_coverage").alias("coverage"), F.col("_core").alias("core_coverage"), F.col("_title").alias("title_coverage"), F.col("_phrase").alias("phrase"),
        F.lit(rules.threshold).alias("threshold"), F.col("_least").alias("min_coverage"), F.lit(q.effective_terms).alias("effective_terms"), (F.size("_rejected") == 0).alias("passes"), hits.alias("matched_terms"),
        missing.alias("missing_terms"), positive.alias("positive_reasons"), notes.alias("negative_reasons"), F.col("_rejected").alias("rejection_reasons"),
    )
    return stage(stage(rows.withColumn("_rejected", rejected)).withColumn("relevance", relevance).drop(*matched, "_phrase", "_near", "_coverage", "_field", "_title", "_core", "_value", "_least", "_negative", "_rejected"))


def relevance_band(value: Column) -> Column:
    top = round(1 / BAND) - 1
    return F.least(F.lit(top), F.floor((value + EPSILON) / BAND).cast("int"))

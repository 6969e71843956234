import itertools
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sift.llm import bpe as B
from sift.llm import looks as L
from sift.llm.cooccur import benjamini_hochberg, chance, co_occurrence, fit_null, pair_counts, poisson_binomial_tails
from sift.llm.encode import edited, encode_corpus, prefix_tables, token_counts
from sift.llm.looks import PLAIN, known_tags, look_alikes, look_classes, one_form, same_looks
from sift.llm.mix import mix_plan, mix_sources, pivotal
from sift.llm.split import split_documents
from sift.llm.survivor import Bundle, Dependency, branch_and_bound, dependency_support, surviving_records, worth

PATH = B.tokenizer_path()
TEXTS = [
    None, "", " ", "\n\n", "Hello world, it's  fine.\n\n New 123 don't", "中文分词测试，真的。テスト 한국어", "<|endoftext|>", "a" * 3000, "é́​﻿", "x　y\t\r\nz", "😀😀 emoji", "'s 'll '", "���", "цена 100₽ — ok…",
    "".join(random.Random(1).choice("abc中é \n1'.,") for _ in range(2000)),
]


@pytest.fixture(scope="module")
def bpe():
    return B.load(PATH)


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


# ---- encoding ---------------------------------------------------------------------------------------------------


def test_encode_equals_public_library(bpe, public):
    for t in TEXTS:
        assert bpe.encode(t) == public(t)
        assert bpe.decode(bpe.encode(t)) == (t or "")


def test_edits_and_appends(bpe, public):
    rng = random.Random(2)
    for _ in range(60):
        doc = B.EncodedText(bpe, rng.choice(TEXTS[4:])[: rng.randint(0, 200)] if rng.random() < 0.9 else "")
        for _ in range(6):
            a = rng.randint(0, len(doc.text))
            new = rng.choice([" ", "a", "  \n", "中", "ing", "'s", "1", ""])
            work = doc.replace(a, min(len(doc.text), a + rng.randint(0, 4)), new) if rng.random() < 0.7 else doc.append(new)
            assert doc.ids() == public(doc.text)
    long = B.EncodedText(bpe, "word " * 5000)
    assert long.replace(12_000, 12_004, "other") < 100  # bytes solved again, of 25,000


def test_prefix_table_is_kept_on_append(bpe):
    whole = bpe.last_tokens(b"internationalization")
    assert bpe.last_tokens(b"internationalization", bpe.last_tokens(b"intern")) == whole


def test_corpus(spark, public):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, None, "again")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode_corpus(df).collect()]
    assert sorted(got) == sorted([(i, public(t)) for i, t in enumerate(TEXTS)] + [(0, [])])
    assert encode_corpus(df.where("false")).collect() == []
    n = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"]).collect()}
    assert n == {i: len(public(t)) for i, t in enumerate(TEXTS)}
    broken = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert encode_corpus(broken).first().ids == public("a�b")


def test_stored_texts_are_edited(spark, public):
    rng = random.Random(4)
    edits = [(t, None, None, s) for t in TEXTS for s in (None, "", "s", " more text", "\n\n", "中文")]
    edits += [(t, rng.randint(-1, 30), rng.choice([None, 10, 40, 9999]), rng.choice(["", "x", " new ", "\n"])) for t in TEXTS for _ in range(4)]
    df = spark.createDataFrame([(i, *e, "x") for i, e in enumerate(edits)], "doc_id long, text string, start int, end int, new string, ids string")
    stored = prefix_tables(df)
    twice = edited(edited(stored.join(df.drop("text"), "doc_id")).drop("ids").withColumns({"start": F.lit(1), "end": F.lit(2), "new": F.lit("é ")}))
    once = {r.doc_id: r for r in edited(stored.join(df.drop("text", "ids"), "doc_id")).collect()}
    again = {r.doc_id: r for r in twice.collect()}
    for i, (t, a, b, new) in enumerate(edits):
        t = t or ""
        a = len(t) if a is None else min(max(a, 0), len(t))
        want = t[:a] + (new or "") + t[max(a, a if b is None else min(b, len(t))) :]
        assert once[i].text == want and once[i].ids == public(want)
        a = min(1, len(want))
        assert again[i].ids == public(want[:a] + "é " + want[max(a, min(2, len(want))) :])
    assert prefix_tables(df.where("false")).count() == 0


# ---- splitting --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit, overlap", [(40, 8), (64, 0), (200, 50)])
def test_split(spark, bpe, limit, overlap):
    texts = [*TEXTS, "First sentence. Second one!\n\n" * 60, "没有空格的长文本" * 100, "q" * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    by = defaultdict(list)
    for r in split_documents(df, limit, overlap).collect():
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids, mine = bpe.encode(t), sorted(by[i], key=lambda r: r.piece_no)
        if not t:
            assert not mine
            continue
        assert [r.piece_no for r in mine] == list(range(1, len(mine) + 1)) and all(r.n_pieces == len(mine) for r in mine)
        assert (len(mine) > 1) == (len(ids) > limit) and mine[0].start_token == 0 and mine[-1].end_token == len(ids)
        for a, b in zip(mine, mine[1:]):
            assert overlap <= a.end_token - b.start_token <= overlap + 3 or b.start_token == 0
            assert b.end_token > a.end_token
        for r in mine:
            assert r.n_tokens == r.end_token - r.start_token <= limit
            assert r.piece == bpe.decode(ids[r.start_token : r.end_token]) and len(bpe.encode(r.piece)) <= r.n_tokens <= len(bpe.encode(r.piece)) + 3
    kinds = {r.break_kind for r in by[len(TEXTS)]}
    assert kinds <= {"paragraph", "line", "sentence", "end"}
    with pytest.raises(ValueError):
        split_documents(df, 10, 5)


def test_split_doubling_equals_greedy():
    from sift.llm.split import cuts, successors

    rng = np.random.default_rng(0)
    classes = rng.integers(0, 6, 500).astype(np.int8)
    classes[0] = 0
    succ, _ = successors(classes, 30, 5)
    at, walk = 0, [0]
    while at < 499:
        at = int(succ[at])
        walk.append(at)
    assert np.flatnonzero(cuts(succ, np.array([0]))).tolist() == walk


def test_split_prefers_an_early_natural_break():
    from sift.llm.split import successors

    classes = np.full(3001, 5, np.int8)
    classes[0], classes[900], classes[2100] = 0, 2, 2
    succ, start = successors(classes, 2000, 100)  # a run of 1,200 tokens after a sentence's end at 900
    assert (succ[0], start[900], succ[900]) == (900, 800, 2100)
    classes[900], classes[50] = 5, 2  # a break within the overlap is no progress
    assert successors(classes, 2000, 100)[0][0] == 2000


# ---- mixing -----------------------------------------------------------------------------------------------------


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(3)
    sizes, probs = rng.integers(1, 500, 40).tolist(), rng.random(40).tolist()
    total, runs = np.zeros(40), 4000
    for _ in range(runs):
        out = pivotal(sizes, probs, iter(rng.random(40)))
        assert sum(0 < p < 1 for p in out) <= 1
        assert sum(s * p for s, p in zip(sizes, out)) == pytest.approx(sum(s * p for s, p in zip(sizes, probs)))
        total += out
    assert np.abs(total / runs - probs).max() < 0.05


def test_mix(spark):
    rng = random.Random(4)
    words = ["one", "two", " three", " four", "five six"]
    docs = [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["big", "big", "big", "mid", None, "other"])) for i in range(1500)] + [(5000 + i, "tiny text", "tiny") for i in range(5)] + [(6000, None, "big")]
    targets = spark.createDataFrame([("big", 0.3, 2), ("mid", 0.4, 3), ("tiny", 0.2, 4), ("absent", 0.1, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    draws, report = mix_sources(df, targets, bucket_docs=40)
    n = {r.doc_id: (r.source, r.n_tokens) for r in token_counts(df, ["doc_id", "source"]).collect()}
    drawn = draws.collect()
    assert len({r.doc_id for r in drawn}) == len(drawn) and all(n[r.doc_id] == (r.source, r.n_tokens) for r in drawn)
    caps = {"big": 2, "mid": 3, "tiny": 4}
    assert all(1 <= r.copies <= caps[r.source] for r in drawn)
    rep = {r.source: r for r in report.collect()}
    total, largest = sum(t for _, t in n.values()), max(t for _, t in n.values())
    assert {s for s, r in rep.items() if r.short} == {"tiny", "absent"} and rep["tiny"].tokens_drawn == 4 * rep["tiny"].tokens_available
    for s, share in (("big", 0.3), ("mid", 0.4)):
        assert abs(rep[s].tokens_drawn - share * total) <= largest and rep[s].tokens_drawn == sum(r.n_tokens * r.copies for r in drawn if r.source == s)
    again = mix_sources(df.repartition(7), targets, bucket_docs=40)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    none = mix_sources(df.where("false"), targets)
    assert none[0].count() == 0 and none[1].where("short").count() == 0


def test_p7_found_draws(spark, tmp_path, monkeypatch):
    from sift.llm import mix
    from sift.llm.queries import p7_found

    spark.createDataFrame([(i, "some words here", "a" if i else "b") for i in range(9)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    assert [r.source for r in p7_found(spark, str(tmp_path)).collect()] == ["b"]

    def refuse(seed, last):
        def run(pdf):
            raise ValueError("rounding is run")

        return run

    monkeypatch.setattr(mix, "_node", refuse)
    with pytest.raises(Exception, match="rounding is run"):
        p7_found(spark, str(tmp_path)).collect()


# ---- looks ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def canonical(spark):
    alike = look_alikes()
    return lambda text, fold_case=False: L.canonical(text, alike, fold_case)


def test_canonical_forms(canonical):
    same = [("ｇａｍｅ　１２", "game 12"), ("Кitсhеn", "Kitchen"), ("café", "café"), ("zero​width­", "zerowidth"), ("芯⽚", "芯片"), ("a b ", "a b"), ("ﬁne", "fine"), ("ё", "ё"), ("ｶﾞ", "ガ"), ("non‑breaking", "non-breaking"), ("Ϲase", "Case"), ("gоοօd", "goood"), ("Ꭵꓳꓐ", "iOB"), ("ⲟᴏᴄ", "ooc"), ("ロカニ", "口力二"), ("⺠", "民"), ("\U0001bca0a", "a"), ("Ս\u0555", "UO"), ("ⅠI", "II"), ("Ӏ", "I"), ("𐐬", "o")]
    for a, b in same:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in (("Case", "case"), ("resume", "résumé"), ("学", "學"), ("n", "ñ"), ("a!!", "a"), ("1", "l"), ("0", "O"), ("I", "l"), ("m", "rn"), ("ø", "o")):
        assert canonical(a) != canonical(b)
    assert canonical("Straße ΣΑΣ", True) == canonical("STRASSE σασ", True)
    for x in [*TEXTS[1:], *map(chr, look_alikes())]:
        assert canonical(canonical(x or "")) == canonical(x or "") and canonical(canonical(x or "", True), True) == canonical(x or "", True)


def test_plain_texts_are_their_own_form(spark, canonical):
    import re

    rng = random.Random(6)
    usual = [c for c in map(chr, range(0x20, 0xA000)) if re.match(PLAIN, c)]
    assert all(len(canonical(c)) == 1 for c in usual)
    texts = ["".join(rng.choice(usual) for _ in range(rng.randint(0, 9))).replace("  ", " ").strip() for _ in range(5000)] + ["ベへヘ一ーピア緒に"]
    assert all(canonical(t) == "".join(c if c == " " else canonical(c) for c in t) for t in texts if re.match(PLAIN, t))
    assert not any(c < 128 or c == ord(to) for c, to in look_alikes().items())
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, *texts]], "t string").select("t", one_form(F.col("t")).alias("f"), one_form(F.col("t"), True).alias("g")).collect()
    assert all(r.f == (None if r.t is None else canonical(r.t)) and r.g == (None if r.t is None else canonical(r.t, True)) for r in rows)


def test_same_looks_equals_brute_force(spark, canonical):
    rng = random.Random(7)
    spell = ["word", "wоrd", "ｗord", "w​ord", "Word", "other", "оther"]
    rows = [(rng.choice(["title", "description"]), i, rng.choice([*spell, None, "word", "word"])) for i in range(200)]
    rows += rows[:20]
    got = sorted(tuple(r) for r in same_looks(spark.createDataFrame(rows, "field string, record_id long, text string")).collect())
    seen = sorted({r for r in rows if r[2] is not None})
    want = sorted({(f, i, j) for (f, i, a), (g, j, b) in itertools.product(seen, seen) if f == g and i < j and a != b and canonical(a) == canonical(b)})
    assert got == want
    links = Counter(x for f, i, j in want for x in ((f, i), (f, j)))
    classes = look_classes(spark.createDataFrame(rows, "field string, record_id long, text string")).collect()
    assert {(r.field, r.record_id): r.links for r in classes} == dict(links) and all(r.class_id <= r.record_id and r.links < r.records for r in classes)
    assert look_classes(spark.createDataFrame([], "field string, record_id long, text string")).count() == 0
    catalog = spark.createDataFrame([(1, "word", "c"), (2, None, "c")], "tag_id long, tag string, category string")
    tags = spark.createDataFrame([(1, "ｗord"), (1, "word"), (2, "Word"), (3, None)], "record_id long, tag string")
    assert sorted((r.record_id, r.tag_id, r.tag) for r in known_tags(tags, catalog).collect()) == [(1, 1, "word"), (1, 1, "ｗord")]


# ---- pairs ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 256])
def test_pair_counts(spark, block):
    rng = random.Random(8)
    rows = {(f"b{rng.randrange(30)}", rng.randrange(25)) for _ in range(260)} | {("hot", i) for i in range(40)}
    got = {(r.item_a, r.item_b): r.n_ab for r in pair_counts(spark.createDataFrame(list(rows), "basket string, item long"), block=block).collect()}
    by = defaultdict(set)
    for b, i in rows:
        by[b].add(i)
    assert got == dict(Counter(p for s in by.values() for p in itertools.combinations(sorted(s), 2)))


def test_null_and_tail():
    rng = np.random.default_rng(9)
    degrees, sizes = np.array([1.0, 3, 7, 20]), np.array([1.0, 2, 4])
    items, baskets = np.array([30.0, 10, 4, 1]), np.array([20.0, 25, 27])
    baskets[-1] += ((degrees * items).sum() - (sizes * baskets).sum()) / 4
    x, y = fit_null(degrees, items, sizes, baskets)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert (p * baskets).sum(axis=1) == pytest.approx(degrees, rel=1e-6) and (p * items[:, None]).sum(axis=0) == pytest.approx(sizes, rel=1e-6)
    for scale in (0.02, 0.2, 1.0):
        probs, counts = np.append(rng.random(5) * scale, 1.0 if scale == 1.0 else 0.0), rng.integers(5, 40, 6)
        pmf = np.array([1.0])
        for q, m in zip(probs, counts):
            for _ in range(m):
                pmf = np.convolve(pmf, [1 - q, q])
        n = np.arange(counts.sum() + 2)
        tails = np.array([pmf[k:].sum() for k in n])
        got = poisson_binomial_tails(n, np.repeat(probs[None], len(n), axis=0), counts.astype(float))
        large = tails > 1e-250
        assert 10.0 ** got[large] == pytest.approx(tails[large], rel=1e-7) and got[-1] == -math.inf and got[0] == 0


def test_null_of_certain_items():
    # baskets A, Ab, Abc, Abcd: every link is certain; then two more items that two more baskets could have
    one = np.ones(4)
    x, y = fit_null(np.array([4.0, 3, 2, 1]), one, np.array([1.0, 2, 3, 4]), one)
    assert set(np.concatenate([x, y])) <= {0.0, np.inf}
    graph = np.zeros((6, 6), bool)
    graph[0], graph[1, :3], graph[2, 2:4], graph[3, 4] = True, True, True, True
    degrees, items = np.unique(graph.sum(axis=1), return_counts=True)
    sizes, baskets = np.unique(graph.sum(axis=0), return_counts=True)
    x, y = fit_null(degrees.astype(float), items.astype(float), sizes.astype(float), baskets.astype(float))
    p = chance(x, y)
    assert np.isinf(x[-1]) and p[-1] == pytest.approx(1) and (p * baskets).sum(axis=1) == pytest.approx(degrees) and (p * items[:, None]).sum(axis=0) == pytest.approx(sizes)
    with pytest.warns(RuntimeWarning):
        fit_null(np.array([1.0, 5, 9]), np.array([5.0, 3, 2]), np.array([1.0, 3, 5]), np.array([4.0, 6, 3]), rounds=1)


def test_spread_sums_equal_local_ones(spark, monkeypatch):
    from sift.llm import cooccur

    rng = np.random.default_rng(3)
    x, y, w = rng.random(300), rng.random(70), rng.random(70)
    whole = cooccur._sums(x, y, w)
    monkeypatch.setattr(cooccur, "CELLS", 1000)
    assert cooccur._spread_sums(spark)(x, y, w) == pytest.approx(whole)


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(10)
    p = np.round(np.concatenate([rng.random(300), rng.random(60) ** 6, [0.5] * 40]), 3) + 1e-6
    df = spark.createDataFrame([(i, float(np.log10(v))) for i, v in enumerate(p)], "i int, log10_p double")
    got = {r.i: r.q for r in benjamini_hochberg(df, 1000, ranges=7).collect()}
    rank = np.array([(p <= v).sum() for v in p])
    raw = p * 1000 / rank
    want = [min(1.0, min(raw[p >= v])) for v in p]
    assert [got[i] for i in range(len(p))] == pytest.approx(want, rel=1e-6)


def test_co_occurrence(spark):
    rng = random.Random(11)
    rows = [(f"b{b}", i) for b in range(120) for i in {rng.randrange(20) for _ in range(rng.randint(0, 5))}] + [(f"b{b}", i) for b in range(15) for i in (100, 101)]
    rows += rows[:30] + [(None, 1), ("b1", None)]
    got = {(r.item_a, r.item_b): r for r in co_occurrence(spark.createDataFrame(rows, "basket string, item long"), 150, min_count=1).collect()}
    r = got[(100, 101)]
    assert (r.n_ab, r.n_a, r.n_b, r.ratio) == (15, 15, 15, 10.0) and r.q < 1e-4 and r.expected < 4
    assert all(0 <= x.q <= 1 for x in got.values()) and r.q == min(x.q for x in got.values())
    few = {(r.item_a, r.item_b): r for r in co_occurrence(spark.createDataFrame(rows, "basket string, item long"), 150, min_count=4).collect()}
    assert few == {k: v for k, v in got.items() if v.n_ab >= 4}  # the false-discovery rate is the same
    assert co_occurrence(spark.createDataFrame([], "basket string, item long"), 0).count() == 0


# ---- survivors --------------------------------------------------------------------------------------------------


def test_branch_and_bound_equals_search():
    rng = random.Random(12)
    for _ in range(300):
        tiers = rng.choice([[0, 0, 0], [0, 1, 1], [1, 0, 0]])
        domains = [sorted(((v, (rng.randrange(3), rng.randrange(3), rng.randrange(9))) for v in range(rng.randint(1, 4))), key=lambda x: x[1], reverse=True) for _ in range(3)]
        allowed = {(a, b): {v: rng.randrange(4) for v in range(4) if rng.random() < 0.6} for a, b in ((0, 1), (2, 1)) if rng.random() < 0.8}

        def value(c):
            breaks = sum(c[a][0] in m and m[c[a][0]] != c[b][0] for (a, b), m in allowed.items())
            return (-breaks, *worth([t for _, t in c], tiers))

        positions, best = branch_and_bound(domains, allowed, tiers)
        assert best == max(value(c) for c in itertools.product(*domains)) == value([d[p] for d, p in zip(domains, positions)])


def test_tiers_come_first():
    # of two dependent bundles the one of the earlier tier keeps its most trusted value
    domains = [[("a", (3, 5, 1)), ("b", (3, 4, 2))], [("y", (3, 9, 3)), ("x", (0, 0, 4))]]
    assert branch_and_bound(domains, {(0, 1): {"a": "x", "b": "y"}}, [0, 1])[0] == [0, 1]
    assert branch_and_bound(domains, {(0, 1): {"a": "x", "b": "y"}}, [0, 0])[0] == [1, 0]


def test_survivors(spark):
    rows = [
        ("k", 1, 3, 10, "old best", 5.0, "A", "x"), ("k", 2, 1, 99, "new", 6.0, "B", "y"), ("k", 3, 3, 20, None, None, "B", "z"), ("k", 3, 3, 20, None, None, "B", "z"),
        ("solo", 4, None, None, None, None, None, None), (None, 5, 1, 1, "t", 1.0, "A", "x"), ("tie", 6, 1, 1, "a", 1.0, None, None), ("tie", 7, 1, 1, "b", 2.0, None, "q"),
    ]
    df = spark.createDataFrame(rows, "k string, id long, lv int, tm long, text string, n double, city string, zip string")
    b = lambda n: Bundle(n, {n: F.col(n)}, F.col(n).isNotNull())
    free = {r.k: r for r in surviving_records(df, "k", "id", F.col("lv"), F.col("tm"), [b("text"), b("n"), b("zip")]).collect()}
    assert set(free) == {"k", "solo", "tie"} and (free["k"].text.text, free["k"].text.record, free["k"].zip.zip) == ("old best", 1, "z")
    assert free["solo"].text is None and free["tie"].text.record == 7 and (free["k"].first_record, free["k"].last_record) == (1, 3)
    # a city's zip is the one in the most trusted record with that city
    tied = {r.k: r for r in surviving_records(df, "k", "id", F.col("lv"), F.col("tm"), [b("text"), b("city"), b("zip")], [Dependency("city", "zip")]).collect()}
    assert (tied["k"].city.city, tied["k"].zip.zip) == ("B", "z") and tied["k"].text.record == 1
    assert tied["solo"].city is None and tied["tie"].zip.zip == "q" and tied["k"].broken == 0


def test_dependencies_decide(spark):
    # the most trusted views and counters are of two readings; with the dependency the counters follow the views
    rows = [("g", 1, 3, 10, 7.0, 1.0), ("g", 2, 3, 20, None, 2.0), ("h", 3, 1, 1, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "level string, record long, lv int, tm long, views double, coins double")  # names clash with the operator's own
    b = lambda n, tier: Bundle(n, {n: F.col(n)}, F.col(n).isNotNull(), tier)
    run = lambda deps: {r.level: r for r in surviving_records(df, "level", "record", F.col("lv"), F.col("tm"), [b("views", 0), b("coins", 1)], deps).collect()}
    assert run([])["g"].coins.coins == 2.0 and run([Dependency("views", "coins")])["g"].coins.coins == 1.0
    assert run([Dependency("views", "coins")])["h"].coins.record == 3


def test_unsatisfiable_groups_are_marked(spark):
    # a says x, c says y, and each is the only value
    rows = [("g", 1, 1, 1, "a", "x", None), ("g", 2, 1, 2, None, "y", "c"), ("g", 3, 2, 3, None, "z", None)]
    df = spark.createDataFrame(rows, "k string, id long, lv int, tm long, a string, b string, c string")
    b = lambda n: Bundle(n, {n: F.col(n)}, F.col(n).isNotNull())
    r = surviving_records(df, "k", "id", F.col("lv"), F.col("tm"), [b("a"), b("b"), b("c")], [Dependency("a", "b"), Dependency("c", "b")]).first()
    assert (r.broken, r.a.a, r.b.b, r.c.c) == (1, "a", "y", "c")
    empty = surviving_records(df.where("false"), "k", "id", F.col("lv"), F.col("tm"), [b("a"), b("b")], [Dependency("a", "b")])
    assert empty.count() == 0


def test_dependency_support(spark):
    df = spark.createDataFrame([("g", "m", "n"), ("g", "m", "n"), ("g", "p", "n"), ("h", "m", "q"), ("h", "m", "r"), (None, "m", "x"), ("h", None, "x")], "k string, a string, b string")
    assert [tuple(r) for r in dependency_support(df, "k", {"a -> b": (F.col("a"), F.col("b"))}).collect()] == [("a -> b", 3, 1)]


def test_survivors_beyond_the_first_values(spark):
    # The most trusted zips all contradict the only city but the last: the first round can't prove the optimum.
    rows = [("k", i, 3, i, None if i else "C", f"z{i}") for i in range(80)] + [("k", 900, 9, 900, "D", None), ("k", 901, 1, 1, "D", "z5")]
    df = spark.createDataFrame(rows, "k string, id long, lv int, tm long, city string, zip string")
    b = lambda n: Bundle(n, {n: F.col(n)}, F.col(n).isNotNull())
    r = surviving_records(df, "k", "id", F.col("lv"), F.col("tm"), [b("city"), b("zip")], [Dependency("city", "zip")]).first()
    assert (r.city.city, r.zip.zip) == ("D", "z5")


def test_queries_are_known():
    from sift.llm.queries import ORACLES, QUERIES

    assert {f"p{n}_found" for n in (3, 4, 5, 7, 8)} | {"p6_ids"} <= set(QUERIES) and set(ORACLES) <= set(QUERIES)
    json.dumps(sorted(QUERIES))

"""Operators 3, 9 and 10 against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import CLASHING, SMALL, document, labels, none, odd, odd_rows, words
from zonecast.llm import line_spread, mixing, quality_llr, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 10


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def brute_model(rows, good):
    """The same ratios one n-gram at a time."""
    def grams(text):
        b = (text or "").encode()
        return [(int.from_bytes(b[i:i + 4], "little") * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 3)]

    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in good:
            target.update(grams(t))
    nr, nt = sum(raw.values()) + 65536, sum(target.values()) + 65536
    ratio = {g: round((math.log((target[g] + 1) / nt) - math.log((raw[g] + 1) / nr)) * quality_llr.UNIT) for g in raw}
    return {(d, t): sum(ratio[g] for g in grams(t)) / max(len(grams(t)), 1) / quality_llr.UNIT for d, t in rows}


def test_quality_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    lab = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    want = brute_model(rows, {r.doc_id for r in lab if r.quality})
    got = {r.doc_id: r for r in queries.op10_quality_llr(spark, SMALL).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t)
        assert r.score == pytest.approx(want[d, t], abs=1e-6) and not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in lab}
    judged = Counter((quality[d], r.kept) for d, r in got.items() if d in quality and not r.base_failed)
    assert judged[1, False] == 0 and judged[0, True] == 0  # the fixture's junk is told from its clean texts
    cut = sorted({r.score for r in got.values() if r.kept})[0]
    assert all(r.kept for r in got.values() if not r.base_failed and r.score >= cut)


def test_quality_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    model = quality_llr.fit(docs, labels(spark))
    got = quality_llr.score(docs, model).collect()
    assert len(got) == len(odd_rows())
    by = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert by == Counter((r[0], *brute_rules(r[1])) for r in odd_rows())
    kept = quality_llr.keep(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in got)
    assert len({r.score for r in got if r.doc_id == 12}) == 1


def test_quality_without_labels_keeps_what_the_rules_keep(spark):
    nothing = labels(spark).where("false")
    model = quality_llr.fit(odd(spark), nothing)
    assert model.threshold == float("-inf")
    assert all(r.kept != r.base_failed for r in quality_llr.score(odd(spark), model).collect())
    assert quality_llr.score(none(spark), quality_llr.fit(none(spark), nothing)).collect() == []
    only_good = quality_llr.fit(odd(spark), labels(spark, [(8, 1, 0)]))
    assert only_good.threshold == float("-inf")


def test_quality_verdict_ignores_partitioning(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality_llr.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    again = quality_llr.fit(docs.repartition(7), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert (model.table == again.table).all() and model.threshold == again.threshold
    assert sorted(quality_llr.score(docs, model).collect()) == sorted(quality_llr.score(docs.repartition(5), model).collect())


def test_labelled_sample_is_bounded_and_repeatable(spark):
    many = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    a = quality_llr.labelled_sample(many, 100).collect()
    assert len(a) == 100 and sorted(a) == sorted(quality_llr.labelled_sample(many.repartition(3), 100).collect())
    twice = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, quality_llr.labelled_sample(twice).collect())) == [(1, False), (2, True)]


# ---- 9


def brute_lines(rows, min_sites):
    """rows: (doc_id, text, site)."""
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            k = line.strip(" \t\r")
            if k:
                sites[k] |= {s} - {None}
                if d is not None:
                    first[k] = min(first.get(k, d), d)
    out = []
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        gone = [len(sites[x.strip(" \t\r")]) >= min_sites and first.get(x.strip(" \t\r")) != d if x.strip(" \t\r") else False for x in lines]
        out.append((d, t if not any(gone) else "\n".join(x for x, g in zip(lines, gone) if not g), sum(gone)))
    return sorted(out, key=str)


def test_line_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, source, text, n_removed_lines FROM ({queries.oracle_sql()['op9_line_spread']})").fetchall()
    assert sorted(map(tuple, queries.op9_line_spread(spark, SMALL).collect())) == sorted(want)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_boilerplate_near_and_far_from_the_threshold(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_spread, "BROADCAST_ROWS", broadcast)
    rows = []
    for d in range(120):
        shared = [f"shared by {n}" for n in (1, 6, 7, 8, 9, 10, 60, 119) if d < n]
        rows.append((d, "\n".join([f"own line {d}", *shared, "", "  shared by 119 \t" if d == 5 else "tail"]), f"site{d}"))
    rows += [(500, "shared by 60\nshared by 60", None), (None, "shared by 119\nmine", "site1"), (501, None, "site2"), (502, "", "site3")]
    docs = spark.createDataFrame([document(d, t, s) for d, t, s in rows], CLASHING)
    got = line_spread.remove_boilerplate(docs, min_sites=8)
    assert got.columns == [*docs.columns, "n_removed_lines"]
    assert sorted(((r.doc_id, r.text, r.n_removed_lines) for r in got.collect()), key=str) == brute_lines(rows, 8)


def test_lines_of_odd_rows(spark):
    docs = odd(spark)
    got = line_spread.remove_boilerplate(docs, min_sites=2).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed_lines) for r in got), key=str) == brute_lines([(r[0], r[1], r[3]) for r in odd_rows()], 2)
    assert line_spread.remove_boilerplate(none(spark)).collect() == []


def test_line_plan_is_native(spark):
    df = queries.op9_line_spread(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 3


def brute_mix(rows, total, weights, max_epochs, seed):
    """rows: (doc_id, text, lang, source); documents one at a time."""
    domain = lambda s: mixing.DOMAINS[int(s[3:]) // 5] if s and re.fullmatch(r"src\d+", s) and int(s[3:]) // 5 < 4 else "other"
    leaves, size = defaultdict(list), Counter()
    for d, t, lang, s in rows:
        n = len(WORD.findall(t or ""))
        if n:
            leaves[domain(s), lang, s].append((d, n))
            size[domain(s), lang, s] += n
    given = mixing.budgets(size.items(), total, weights, max_epochs)
    out = []
    for leaf, budget in given.items():
        epoch = 0
        while budget > 0:
            key = lambda x: hashlib.md5(f"{seed}:{epoch}:{'null' if x[0] is None else x[0]}".encode()).hexdigest()
            for d, n in sorted(leaves[leaf], key=key):
                if budget > 0:
                    out.append((d, leaf, epoch, n, min(n, budget)))
                    budget -= n
            epoch += 1
    return sorted(out, key=str), given, size


def mixed(df):
    return sorted(((r.doc_id, (r.domain, r.lang, r.source), r.epoch, r.tokens, r.taken) for r in df.collect()), key=str)


@pytest.mark.parametrize("share,epochs,seed", [(0.9, 2, 7), (0.2, 1, 1), (1.7, 2, 3)])
def test_mix_equals_brute_force(spark, share, epochs, seed):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    total = int(share * sum(len(WORD.findall(r[1] or "")) for r in rows))
    want, given, size = brute_mix(rows, total, mixing.WEIGHTS, epochs, seed)
    got = mixed(mixing.mix(docs, weights=mixing.WEIGHTS, max_epochs=epochs, seed=seed, share=share))
    assert got == want
    taken = Counter()
    for _, leaf, _, _, n in got:
        taken[leaf] += n
    assert dict(taken) == {k: v for k, v in given.items() if v} and sum(taken.values()) == min(total, epochs * sum(size.values()))


def test_shortages_go_to_siblings_before_ancestors():
    leaves = [(("a", "x", "1"), 10), (("a", "x", "2"), 1000), (("a", "y", "3"), 1000), (("b", "x", "4"), 1000)]
    got = mixing.budgets(leaves, 800, {}, 1)
    # a and b 400 each, x and y 200 each; leaf 1 has 10 of its 100, the rest goes to leaf 2 alone
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "3"): 200, ("b", "x", "4"): 400}
    dry = [(("a", "x", "1"), 10), (("a", "x", "2"), 20), (("a", "y", "3"), 1000), (("b", "x", "4"), 1000)]
    assert mixing.budgets(dry, 800, {}, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "3"): 370, ("b", "x", "4"): 400}
    assert sum(mixing.budgets(dry, 10 ** 9, {}, 3).values()) == 3 * 2030  # everything, max_epochs times
    shut = mixing.budgets(dry, 500, {("b",): 0.0}, 1)
    assert shut[("b", "x", "4")] == 0 and sum(shut.values()) == 500
    assert mixing.budgets([], 100, {}, 1) == {}


def test_shares_are_exact_and_within_caps():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randrange(1, 7)
        caps, weights = [rnd.randrange(0, 50) for _ in range(n)], [rnd.choice([0.1, 1.0, 3.0]) for _ in range(n)]
        budget = rnd.randrange(0, sum(caps) + 1)
        got = mixing.shares(budget, weights, caps)
        assert sum(got) == budget and all(0 <= g <= c for g, c in zip(got, caps))


def test_mix_odd_rows(spark):
    docs = odd(spark)
    for total in (100, 20_000, 10 ** 9):
        got = mixed(mixing.mix(docs, total=total))
        rows = [r for r in [(r[0], r[1], r[2], r[3]) for r in odd_rows()]]
        # rows of one id come in together; the brute force takes them one by one
        want, given, size = brute_mix([r for r in rows if r[0] != 12], min(total, 10 ** 9), mixing.WEIGHTS, 2, 7)
        assert {g[1] for g in got} <= set(size) | {("web", "en", "src1")}
        assert all(0 < g[4] <= g[3] for g in got)
    whole = mixing.mixed_documents(docs, total=10 ** 9)
    assert whole.columns == docs.columns
    count = Counter(r.doc_id for r in whole.collect())
    assert count[6] == 2 and count[12] == 4 and count[1] == 0
    assert mixing.mix(none(spark)).collect() == [] and mixing.mixed_documents(none(spark)).collect() == []


def test_more_leaves_than_the_bound_share_some(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 7 + 1)), f"l{i % 5}" if i % 4 else None, f"host{i}.example") for i in range(600)],
                                 "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(mixing, "MAX_LEAVES", 50)
    monkeypatch.setattr(mixing, "SHARED_SOURCES", 8)
    monkeypatch.setattr(mixing, "SHARED_LANGS", 2)
    everything = mixed(mixing.mix(docs, weights={}, max_epochs=1, share=1.0))
    assert [(d, n, k) for d, _, _, n, k in everything] == sorted(((i, i % 7 + 1, i % 7 + 1) for i in range(600)), key=str)
    total = 700
    for weights in ({}, {("other", "l1"): 3.0}, {("other", None, "host4.example"): 50.0}):
        part = mixed(mixing.mix(docs, total=total, weights=weights, max_epochs=1))
        assert sum(r[4] for r in part) == total and all(r[1][2] == f"host{r[0]}.example" for r in part)
    got = Counter()
    for _, leaf, _, _, taken in mixed(mixing.mix(docs, total=total, weights={("other", "l1"): 3.0}, max_epochs=1)):
        got[leaf[1]] += taken
    # six branches in all: l1 weighs 3, the four other languages and NULL 1 each
    assert got["l1"] == 700 * 3 // 8 and got[None] in (87, 88)
    shut = mixed(mixing.mix(docs, total=10 ** 6, weights={("other", "l2"): 0.0}, max_epochs=1))
    assert shut and not any(r[1][1] == "l2" for r in shut)


@pytest.mark.parametrize("bound", [20, 100_000])
def test_budgets_in_tables_equal_the_tree_whatever_the_number_of_leaves(spark, monkeypatch, bound):
    """Steep leaf sizes take several rounds of filling; the bound only says how budgets are joined."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + 3 * (i % 11 == 0) * i)), f"l{i % 5}" if i % 4 else None, f"host{i // 2}.example" if i % 9 else None)
                                  for i in range(240)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(mixing, "MAX_LEAVES", bound)
    weights = {("other", "l1"): 3.0, ("other", "l2"): 0.0, ("other", None, "host4.example"): 50.0, ("other", "l3", None): 0.5}
    size = Counter()
    for r in docs.collect():
        size["other", r.lang, r.source] += len(r.text.split())
    for total in (37, 1500, 10 ** 9):
        want = {k: v for k, v in mixing.budgets(sorted(size.items(), key=str), total, weights, 2).items() if v}
        got = Counter()
        for _, leaf, _, _, taken in mixed(mixing.mix(docs, total=total, weights=weights)):
            got[leaf] += taken
        assert got == want


def test_mixed_documents_tell_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "src1"), (1, "x y", "en", "src9"), (2, None, "en", "src1"), (2, "d e", "en", "src1")],
                                 "doc_id long, text string, lang string, source string")
    got = mixing.mixed_documents(docs, total=100, weights={("books",): 0.0}, max_epochs=1).collect()
    assert sorted(r.text for r in got) == ["a b c", "d e"]


def test_lines_of_long_texts_in_linear_time(spark):
    def seconds(n):
        text = "\n".join(f"shared line {i}" for i in range(n))
        docs = spark.createDataFrame([(d, text + f"\nown {d}", f"site{d}") for d in range(9)], "doc_id long, text string, source string")
        began = time.monotonic()
        rows = line_spread.remove_boilerplate(docs, min_sites=8).collect()
        assert sorted((r.doc_id, r.text, r.n_removed_lines) for r in rows) == [(d, f"{text}\nown 0" if d == 0 else f"own {d}", n if d else 0) for d in range(9)]
        return time.monotonic() - began

    seconds(100)
    assert seconds(64_000) < 60  # with work by the square of the lines it took minutes


def test_quality_arrays_stay_small(monkeypatch):
    """A worker's arrays of some 30 bytes a byte of text are made for a megabyte at a time; the counts are those of the whole."""
    import pyarrow as pa

    texts = [words(4000, i) if i % 9 else None for i in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 == 0 for i in range(150)])], ["text", "good"])
    whole, plain = [], quality_llr.gram_buckets
    monkeypatch.setattr(quality_llr, "gram_buckets", lambda data, offsets: whole.append(len(data)) or plain(data, offsets))
    counts = [b.to_pydict() for b in quality_llr._count(iter([batch]))]
    assert sum(whole) == sum(len(t.encode()) for t in texts if t) > 2 << 20 and max(whole) <= 1 << 20
    monkeypatch.setattr(quality_llr, "PORTION", 1 << 30)
    assert counts == [b.to_pydict() for b in quality_llr._count(iter([batch]))]

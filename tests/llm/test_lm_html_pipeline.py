"""Operators 7 and 8 and the pipeline."""

import math
import os
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

import corpus_pipeline
from llm_cases import SMALL, none, odd, odd_rows, words
from zonecast.llm import bloom_lm, html_layout, packing, queries

# ---- 8


def brute_base(rows):
    """rows: (doc_id, text); the exact columns of each row."""
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter()
    for d, t in rows:
        if not held(d):
            count.update(split(t))
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        w = split(t)
        out.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return sorted(out, key=str)


def exact(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)


def check_base(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_scores_of_the_corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op8_bloom_lm(spark, SMALL).collect()
    check_base(exact(got), brute_base(rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) >= sum(r.base_score for r in held)  # held-out text is likelier than by single words


def test_join_path_equals_broadcast_path(spark):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd(spark)):
        split = bloom_lm.split_rows(docs)
        model, vocabulary = bloom_lm.fit(split)
        a = bloom_lm.score(split, model, vocabulary).collect()
        b = bloom_lm.score(split, model, vocabulary, max_words=0).collect()
        check_base(exact(b), exact(a))
        assert sorted(round(r.score, 6) for r in a) == sorted(round(r.score, 6) for r in b)


def test_lm_odd_rows_and_empty_tables(spark):
    split = bloom_lm.split_rows(odd(spark))
    model, vocabulary = bloom_lm.fit(split)
    check_base(exact(bloom_lm.score(split, model, vocabulary).collect()), brute_base([(r[0], r[1]) for r in odd_rows()]))
    split = bloom_lm.split_rows(none(spark))
    model, vocabulary = bloom_lm.fit(split)
    assert model.tokens == 0 and bloom_lm.score(split, model, vocabulary).collect() == []
    one = bloom_lm.split_rows(odd(spark).where("doc_id = 5"))
    assert len(bloom_lm.score(one, model, vocabulary).collect()) == 1


def test_filter_levels_never_fall_short(spark):
    rnd = np.random.default_rng(1)
    key = rnd.integers(0, 1 << 62, 3000)
    c = np.maximum(1, (rnd.pareto(0.7, 3000) * 3).astype(np.int64))
    entries = spark.createDataFrame([("pair", int(k), int(n)) for k, n in zip(key, c)], "kind string, key long, c long")
    f = bloom_lm.build_filter(entries, 3)
    want = np.searchsorted(bloom_lm.BOOKS["pair"], c, "right")
    got = f.levels("pair", key.astype(np.uint64))
    assert (got >= want).all() and (got > want).mean() < 0.02
    other = rnd.integers(0, 1 << 62, 20_000).astype(np.uint64)
    assert (f.levels("pair", other) > 0).mean() < 0.02
    assert (f.levels("word", key.astype(np.uint64)) > 0).mean() < 0.02
    # beyond the bound more answers are wrong, but none falls short
    small = bloom_lm.build_filter(entries, 3, max_bytes=1200)
    assert len(small.words) * 8 <= 1200 and (small.levels("pair", key.astype(np.uint64)) >= want).all()


def test_scores_beyond_the_broadcast_bound(spark, monkeypatch):
    """A filter above the bound keeps its size: probed in bands of slices it gives the broadcast filter's scores."""
    monkeypatch.setattr(bloom_lm, "SLICE_TOKENS", 2000)
    monkeypatch.setattr(bloom_lm, "SCORE_BYTES", 20_000)
    monkeypatch.setattr(bloom_lm, "BAND_BYTES", 30_000)
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd(spark)):
        split = bloom_lm.split_rows(docs)
        model, vocabulary = bloom_lm.fit(split)
        far, _ = bloom_lm.fit(split, vocabulary, max_filter_bytes=100)
        assert far.filter is None and (far.sizes.sum() * 8 > 3 * 30_000 or docs.count() < 100)
        row = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score)
        want = sorted(map(row, bloom_lm.score(split, model, vocabulary).collect()))
        got = sorted(map(row, bloom_lm.score(split, far, vocabulary).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [x for g in got for x in g[3:]] == pytest.approx([x for w in want for x in w[3:]], rel=1e-9)
        both = bloom_lm.assembled(far.sizes, far.stored.toLocalIterator())
        unseen = np.random.default_rng(3).integers(0, 1 << 62, 50_000).astype(np.uint64)
        assert all((both.levels(k, unseen) > 0).mean() < 0.02 for k in bloom_lm.KINDS)


def test_shares_are_scored_one_after_the_other_beyond_the_bounds(spark, monkeypatch):
    """Only one share's runs of texts and keys lie in the shared folder at once, and none after the last."""
    split = bloom_lm.split_rows(spark.read.parquet(f"{SMALL}/documents.parquet"))
    model, vocabulary = bloom_lm.fit(split)
    far, _ = bloom_lm.fit(split, vocabulary, max_filter_bytes=100)
    monkeypatch.setattr(bloom_lm, "SHARES", 3)
    made, write = [], bloom_lm.written

    def writing(df, name):
        out = write(df, name)
        at = out.inputFiles()[0].rsplit("/", 1)[0].replace("file:", "").replace("//", "/")
        made.append((name, at, out.count()))
        assert sum(n == "lm-runs" and os.path.exists(f) for n, f, _ in made) <= 1
        return out

    monkeypatch.setattr(bloom_lm, "written", writing)
    row = lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    want = sorted(map(row, bloom_lm.score(split, model, vocabulary).collect()))
    assert len(made) == 1  # within the bounds all at once
    assert sorted(map(row, bloom_lm.score(split, far, vocabulary, max_words=0).collect())) == want
    runs = [f for n, f, _ in made if n == "lm-runs"]
    scores = [c for n, _, c in made[1:] if n == "lm-scores"]
    assert len(runs) == len(scores) == 3 and not any(map(os.path.exists, runs))
    assert sum(scores) == len(want) and max(scores) < len(want) / 2


def test_bigrams_seen_once_are_held(spark, monkeypatch):
    """The filter holds each counted bigram and each history's followers, those seen once too."""
    monkeypatch.setattr(bloom_lm, "SLICE_TOKENS", 5000)
    split = bloom_lm.split_rows(spark.read.parquet(f"{SMALL}/documents.parquet"))
    raw = [r.text.encode() for r in split.where("not held_out").collect()]
    h, offsets = bloom_lm.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    pair, c = np.unique(bloom_lm.pairs_of(h, offsets)[1], return_counts=True)
    first, kinds = np.unique(pair >> np.uint64(28), return_counts=True)
    f = bloom_lm.fit(split)[0].filter
    for kind, key, n in (("pair", pair, c), ("kinds", first[kinds > 1], kinds[kinds > 1] - 1)):
        want, got = np.searchsorted(bloom_lm.BOOKS[kind], n, "right"), f.levels(kind, key)
        assert (want == 1).sum() > 100 and (got >= want).all() and (got > want).mean() < 0.02


def test_a_held_out_bigram_seen_once_scores_as_seen(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(ids[0], "m a b n"), (ids[1], "m a c n"), (ids[2], "o b c p"), (held[0], "x a b"), (held[1], "x b a")] + [(i, "m a o b n p") for i in ids[3:5]]
    docs = bloom_lm.split_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in bloom_lm.score(docs, *bloom_lm.fit(docs)).collect()}
    assert got[held[0]] > got[held[1]] + 0.1


def test_codebook_decodes_within_its_step():
    for kind, step in (("pair", bloom_lm.PAIR_STEP), ("word", bloom_lm.WORD_STEP)):
        c = np.unique(np.concatenate([np.arange(1, 50), np.geomspace(50, 10 ** 9, 400).astype(np.int64)]))
        back = bloom_lm.decoded(kind, np.searchsorted(bloom_lm.BOOKS[kind], c, "right"))
        assert (np.abs(back - c) <= np.maximum(c * (step - 1), 0.5)).all()
        assert (back[:4] == c[:4]).all()


def test_mixing_function_is_invertible():
    x = np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (bloom_lm.unmix64(bloom_lm.mix64(x)) == x).all()
    keys = np.sort(x)
    assert (bloom_lm._unpacked(bloom_lm._packed(keys)) == keys).all()


def test_pair_counts_equal_brute_force(spark):
    split = bloom_lm.split_rows(spark.read.parquet(f"{SMALL}/documents.parquet"))
    count = Counter()
    for r in split.where("not held_out").collect():
        w = [None, *r.text.encode().lower().split(), None]
        count.update(zip(w, w[1:]))
    merged = list(bloom_lm._merged(iter(bloom_lm._dealt_pairs(split, 3).toArrow().to_batches())))
    assert sorted(np.concatenate([n for _, _, n in merged]).tolist()) == sorted(count.values())


def test_word_hashes_tell_words_apart():
    rnd = random.Random(4)
    texts = ["", " \n", "One oNE\tone\x0btwo", "é É x\x00y", " ".join("".join(rnd.choices("abé0", k=rnd.randrange(1, 9))) for _ in range(3000)), "x" * 70_000 + " y"]
    raw = [t.encode() for t in texts]
    h, offsets = bloom_lm.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [[*t.lower().split(), None] for t in raw]
    assert np.diff(offsets).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))
    assert [int(x) for x in h[offsets[1:] - 1]] == [int(bloom_lm.END)] * len(texts)


def plain_scores(rows, level):
    """The model one token at a time; ``level(kind, count)`` is the count that the model sees."""
    texts = {d: [*(t or "").encode().lower().split(), None] for d, t in rows}
    train = [w for d, w in texts.items() if zlib.crc32(str(d).encode()) % 10]
    word, pair = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([None, *w], w))
    kinds, n, v = Counter(a for a, _ in pair), sum(word.values()), len(word)
    counts = Counter(pair.values())
    discount = counts[1] / max(counts[1] + 2 * counts[2], 1)
    out = {}
    for d, w in texts.items():
        total = 0.0
        for a, b in zip([None, *w], w):
            ca, cb = level("word", word[a]), level("word", word[b])
            k = min(ca, 1.0) if ca < 2 else min(1 + level("kinds", kinds[a] - 1), ca)
            left = min(max(discount * k / max(ca, 1), 1e-4), 1.0) if ca else 1.0
            c = min(level("pair", pair[a, b]), ca, cb)
            total += math.log10(max(c - discount, 0) / max(ca, 1) + left * (cb + 0.1) / (n + 0.1 * (v + 1)))
        out[d] = total, len(w)
    return out


def test_score_equals_a_plain_model(spark):
    """With the counts' quantisation the scores agree but for wrong answers of the filter; with exact counts within the step."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.score for r in queries.op8_bloom_lm(spark, SMALL).collect()}
    decoded = lambda kind, c: float(bloom_lm.decoded(kind, np.searchsorted(bloom_lm.BOOKS[kind], c, "right")))
    quantised, exact = plain_scores(rows, decoded), plain_scores(rows, lambda _, c: float(c))
    off = [abs(got[d] - s) / n for d, (s, n) in quantised.items()]
    assert np.median(off) < 0.005 and max(off) < math.log10(bloom_lm.PAIR_STEP)
    assert all(abs(got[d] - s) / n < math.log10(bloom_lm.PAIR_STEP) for d, (s, n) in exact.items())


def test_probabilities_of_a_history_add_up(spark):
    """Where counts are exact and the discount is not 0, P(.|h) over the vocabulary sums to 1 less the unknown word's share."""
    rows = [(11, "a b a c a d e"), (12, "a b b e f"), (13, "c a e g h"), (15, "b a d f")]
    docs = bloom_lm.split_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    model, vocabulary = bloom_lm.fit(docs)
    assert 0.3 < model.discount < 1
    hashes = np.array([r.h for r in vocabulary.collect()], np.int64).view(np.uint64)
    unknown = bloom_lm.ALPHA / (model.tokens + bloom_lm.ALPHA * (model.words + 1))
    for first in hashes[hashes != bloom_lm.END]:
        total = 0.0
        for w in hashes:
            h = np.array([first, w, bloom_lm.END], np.uint64)
            known, back = np.unique(h, return_inverse=True)
            total += 10 ** model.log10(h, np.array([0, 3]), known, back)[1]
        assert total == pytest.approx(1 - unknown, abs=0.02)


# ---- 7


class _Plain(HTMLParser):
    """Words in document order, without layout: an independent reading of visible text."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_all_visible_words_of_the_pages_in_order(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op7_html_layout(spark, SMALL).collect()}
    assert set(got) == set(pages)
    for k, html in pages.items():
        p = _Plain()
        p.feed(html)
        p.close()
        flat = lambda s: re.sub(r"\s+", "", re.sub(r"(?m)^\s*- ", "", s))
        assert flat(got[k]) == flat(" ".join(p.out))


CASES = {
    "<p>One<p>Two": "One\n\nTwo",
    "<h1>Head</h1>text<div>block</div>more": "Head\n\ntext\nblock\nmore",
    "a <b>bold</b>  and\n<i>it</i>&amp;&nbsp;&#33;": "a bold and it&\xa0!",
    "<ul><li>x<li>y<ul><li>z</ul><li>w</ul>end": "- x\n- y\n  - z\n- w\n\nend",
    "<ol start=3><li>x<li value=7>y<li>z</ol>": "3. x\n7. y\n8. z",
    "<table><tr><th>Name<th>Age<tr><td>Al<td>5<tr><td>Barbara<td>41</table>": "Name     Age\nAl       5\nBarbara  41",
    "<table><caption>Cap</caption><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>": "Cap\nwide     z\na     b  c",
    "x<script>var t='</p>'</script>y<style>p{}</style><!-- no --><template>t</template>z": "xyz",
    "<p hidden>no</p><div style='color:red; display : none'>no<p>no</div><p style='display:block'>yes": "yes",
    "<input type=hidden value=no><input value=yes><textarea>a &lt; b</textarea>": "yes a < b",
    "<pre>\n a\n   b\n\nc</pre>d": " a\n   b\n\nc\n\nd".strip("\n"),
    "line<br>break<br/>again</br>end": "line\nbreak\nagain\nend",
    "1 < 2 and 3 > 2 <": "1 < 2 and 3 > 2 <",
    "<details><summary>Sum</summary>hidden</details><dialog>no</dialog><dialog open>yes</dialog>": "Sum\nyes",
    "<dl><dt>T<dd>D<dt>U<dd>E</dl>": "T\n    D\nU\n    E",
    "</p></div>text</table>": "text",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<html><head><title>no</title><meta x><body>yes<body class=y>again": "yesagain",
    "<div><p>in <span>span</div>out": "in span\n\nout",
    "<a href='x>y'>quoted</a> <a href=\"unclosed>text</a>": "quoted text",
    "<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>": "a in ner  b",
    "<script>never closed <p>x": "", "<!-- never closed <p>x": "", "<title>t</title>": "", "   ": "",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert html_layout.page_text(html) == CASES[html]


def test_pages_of_any_depth_and_size():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert html_layout.page_text(deep) == "x"
    assert html_layout.page_text("<ul><li>" * 500 + "x").strip().endswith("x")
    assert html_layout.page_text("<table><tr><td>" * 60 + "x").strip() == "x"
    assert len(html_layout.page_text("<p>" + words(100_000))) == len(words(100_000))
    assert html_layout.page_text("<" * 20_000) == "<" * 20_000
    assert html_layout.page_text("<a " + "b='" * 5000).startswith("<a ")


def test_extract_nulls_and_empty(spark):
    rows = [(1, "u", "<p>x", "t"), (2, None, None, None), (None, "u", "", "t"), (1, "u", "<p>x", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_layout.extract(pages).collect()), key=str)
    assert got == sorted([(1, "x"), (2, ""), (None, ""), (1, "x")], key=str)
    assert html_layout.extract(pages.where("false")).collect() == []


# ---- pipeline


def test_stages_are_the_dealt_ones(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns, name
        assert [f.dataType for f in now.schema] == [f.dataType for f in docs.schema], name
        now = spark.createDataFrame(now.toPandas(), docs.schema)
        seen.append(now.count())
    assert seen[1] < seen[0] and seen[2] == seen[1] and seen[3] < seen[2]
    assert now.where("n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SMALL).collect()
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert all(n == packing.WINDOW for k, n in used.items() if k < max(used))
    whole = corpus_pipeline.run(spark, SMALL).collect()
    tokens = lambda rows: Counter((r.doc_id, r.doc_tokens, r.start + k) for r in rows for k in range(r.length))
    assert tokens(whole) == tokens(pieces)


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    odd(spark).selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd(spark), none(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert rows or docs.isEmpty() or name == "quality rules"

"""Operators 2, 4 and 5 against brute force."""

import os
import random
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from llm_cases import CLASHING, SMALL, document, none, odd, odd_rows, words
from zonecast.llm import block_search, components, jaccard_join, queries, substring_dedup


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op4_block_search", "op5_jaccard_join"])
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(want)


# ---- 4


def brute_top(rows, queries_, k=10):
    ok = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, w in ok:
        if q in queries_:
            best = sorted(((-int(v @ w), i) for i, v in ok if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(block_search, "BLOCK", 4)
    monkeypatch.setattr(block_search, "SHARD", 30)
    monkeypatch.setattr(block_search, "QUERIES", 3)
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.5]) for _ in range(3)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(200, 260)]  # one very common vector
    rows += [(300, None), (301, [0.1, None, 0.2]), (302, [float("nan"), 0.0, 1.0]), (303, [float("inf"), 0.0, 1.0]), (None, [0.5, 0.5, 0.5]), (304, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, v string")
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    got = block_search.top_k(table, table.where("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, asked)
    empty = table.where("false")
    assert block_search.top_k(empty, empty).collect() == []
    one = table.where("vec_id = 0")
    assert block_search.top_k(one, one).collect() == []


def test_blocks_are_skipped_by_their_bounds():
    near, far = np.array([[9, 9], [8, 9]]), [np.array([[-9, -9], [-8, -9]])] * 5
    seen = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            seen.append(1)
            return np.asarray(self) @ other

    rows = [near.view(Watched), *[f.view(Watched) for f in far]]
    ids = [np.array([1, 2]), *[np.array([10 * k, 10 * k + 1]) for k in range(1, 6)]]
    got = list(block_search.search_shard(ids, rows, np.array([99]), np.array([[1, 1]]), 2))
    assert got == [(0, 1, 18), (0, 2, 17)] and len(seen) == 1


def test_repeated_queries_are_asked_once_and_vectors_of_one_id_apart(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(40)] + [(0, [0.0, 0.0]), (20, [1.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in block_search.top_k(table, asked.union(asked)).collect())
    ok = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for q, w in {(q, tuple(w)) for q, w in ok if q % 20 == 0}:
        best = sorted(((-int(v @ np.array(w)), i) for i, v in ok if i != q))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert len(got) == 30 and got == sorted(want)
    con_ = duckdb.connect()
    con_.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con_.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    sql = block_search.oracle_sql(every=20)
    assert sorted(con_.execute(f"SELECT query_id, rank, vec_id, score FROM ({sql})").fetchall()) == got


def test_index_prunes_clustered_vectors():
    """On vectors in clusters, as embeddings of topics are, most blocks are never scored."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 300, (40, 16))
    rows = [np.floor(c + rnd.normal(0, 20, (64, 16))).astype(np.int64) for c in centres]
    ids = [np.arange(64) + 64 * k for k in range(40)]
    scored = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            scored.append(1)
            return np.asarray(self) @ other

    q = np.stack([r[0] for r in rows])
    got = list(block_search.search_shard(ids, [r.view(Watched) for r in rows], np.arange(40) * 64, q, 10))
    all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
    for j in range(40):
        s = all_rows @ q[j]
        best = [i for i in np.lexsort((all_ids, -s)) if all_ids[i] != j * 64][:10]
        assert [(i, s_) for n, i, s_ in got if n == j] == [(int(all_ids[i]), int(s[i])) for i in best]
    assert len(scored) < 40 * 40 / 4


# ---- 5


def brute_components(rows, w, percent):
    sets = []
    for doc_id, text in rows:
        v = (text or "").encode().lower().split()
        sets.append((doc_id, frozenset([tuple(v)] if 0 < len(v) < w else [tuple(v[i:i + w]) for i in range(len(v) - w + 1)]) if v else frozenset()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(s), min(least[root(i)], default=None) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def near_copies(rnd):
    """Chains of edits, so that links pass through intermediates, and templates below the threshold."""
    rows, doc_id = [], 0
    for group in range(12):
        text = words(rnd.choice([6, 12, 40, 200, 400]), group, 300).split()
        for _ in range(rnd.choice([1, 3, 25])):
            if text:
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(9)}"
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
    shared = words(120, 99)
    for k in range(40):
        rows.append((doc_id, f"{shared} {words(30 + k, 1000 + k)}"))
        doc_id += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("w,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, w, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    rows = near_copies(random.Random(w * percent)) + [(r[0] if r[0] is None else 10_000 + r[0], r[1]) for r in odd_rows()]
    docs = spark.createDataFrame([document(*r) for r in rows], CLASHING).repartition(5)
    got = jaccard_join.jaccard_components(docs, w, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, w, percent)


def test_jaccard_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    rows = near_copies(random.Random(3))
    docs = spark.createDataFrame([document(*r) for r in rows], CLASHING)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, 4, 85).collect()), key=str) == brute_components(rows, 4, 85)


def test_jaccard_by_bands_leaves_no_shuffle_and_no_large_table_behind(spark, monkeypatch):
    """A band of tokens and sets at a time, and each step's shuffle files and tables go with it; the components are the same."""
    monkeypatch.setattr(jaccard_join, "BAND_SHINGLES", 0)
    monkeypatch.setattr(jaccard_join, "BANDS", 3)
    made, write = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: made.append((name, write(df, name))) or made[-1][1])
    rows = near_copies(random.Random(5))
    docs = spark.createDataFrame([document(*r) for r in rows], CLASHING).repartition(5)
    folders = lambda name: {f.rsplit("/", 1)[0] for n, df in made if n == name for f in df.inputFiles()}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = {f.getName() for f in common_files(disk)}
    write(docs.groupBy("text").count(), "shuffled")
    for _ in range(50):  # files go in the background
        left = [f.getName() for f in common_files(disk) if f.getName().startswith("shuffle") and f.getName() not in before]
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, 4, 85).collect()), key=str) == brute_components(rows, 4, 85)
    assert sum(n == "jaccard-cells" for n, _ in made) == 3
    gone = [f.removeprefix("file:") for n in ("jaccard-sets", "jaccard-cells", "jaccard-shared", "jaccard-leads", "jaccard-open-cells") for f in folders(n)]
    assert gone and not any(os.path.exists(f.replace("//", "/")) for f in gone)


def common_files(disk):
    files = disk.getAllFiles()
    return [files.apply(i) for i in range(files.size())]


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(none(spark)).collect() == []
    assert jaccard_join.keep_one(none(spark)).collect() == []


@pytest.mark.parametrize("percent", [50, 80, 85, 90])
def test_linked_sets_share_a_matrix_token(percent):
    rnd = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rnd.integers(1, 250))
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        keep = a[rnd.random(len(a)) < rnd.choice([1.0, 0.95, 0.9, 0.8])]
        b = np.unique(np.concatenate([keep, rnd.integers(0, 1 << 63, int(rnd.integers(0, max(1, n // 6) + 1))).astype(np.uint64)]))
        if len(b) and jaccard_join.linked(a, b, percent):
            assert set(jaccard_join.matrix_tokens(a, percent)) & set(jaccard_join.matrix_tokens(b, percent))


def test_keep_one_keeps_one_of_each_group(spark):
    rows = odd_rows()
    got = jaccard_join.keep_one(odd(spark), w=4, percent=85)
    assert got.columns == [c.split()[0] for c in CLASHING.split(", ")]
    left = sorted((r.doc_id for r in got.collect()), key=str)
    want = {d for d, _, c in brute_components([(r[0], r[1]) for r in rows], 4, 85) if d is not None and d == c}
    assert [x for x in left if x is not None] == sorted(want, key=str) and left.count(None) == 2


def test_components_of_long_chains(spark):
    rnd = random.Random(8)
    order = list(range(200))
    rnd.shuffle(order)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(500, 501), (501, 502), (7, 7)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: 0 for v in range(1, 200)} | {501: 500, 502: 500}


# ---- 2


def brute_chunks(text):
    """Chunk ends by the rolling definition."""
    data, table = (text or "").encode(), substring_dedup.gear().tolist()
    hashes, h = [], 0
    for b in data:
        h = ((h << 1) + table[b]) & 0xFFFFFFFF
        hashes.append(h)
    ends, last = [], 0
    while len(data) - last > substring_dedup.MIN:
        # an end that is no character's start cannot be chosen
        able = [e for e in range(last + substring_dedup.MIN, len(data) + 1) if e == len(data) or data[e] & 0xC0 != 0x80]
        cut = next((e for e in able if hashes[e - 1] >> 32 - substring_dedup.MASK_BITS == 0), len(data))
        if cut - last > substring_dedup.MAX:
            cut = max((e for e in able if e <= last + substring_dedup.MAX), key=lambda e: (hashes[e - 1], -e))
        ends.append(cut)
        last = cut
    if last < len(data):
        ends.append(len(data))
    return ends


def test_chunk_ends_follow_the_rolling_hash():
    import pyarrow as pa

    from zonecast.llm.common import text_buffer

    texts = ["", None, "short", words(400, 1), "é" * 3000, "a" * 5000, words(50, 2) + " ñandú " * 40, "x" * 33, "Heat " * 300, words(9) + " Heat" * 300]
    data, offsets = text_buffer(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    for t, ends in zip(texts, substring_dedup.cut_points(data, offsets)):
        assert ends == brute_chunks(t), (t or "")[:20]


def test_repeated_passages_are_found_despite_insertions(spark):
    passage = words(60, 7, 10 ** 6)
    rows = [document(i, f"{words(80 + i, 100 + i, 10 ** 6)} {passage if i % 3 == 0 else ''} {words(50, 200 + i, 10 ** 6)}") for i in range(30)]
    docs = spark.createDataFrame(rows, CLASHING)
    got = substring_dedup.duplicate_spans(docs).collect()
    assert {r.doc_id for r in got} == {i for i in range(30) if i % 3 == 0} - {0}
    texts = {r[0]: r[1].encode() for r in rows}
    for r in got:
        assert texts[r.doc_id][r.start:r.start + r.length] in texts[0] and r.first_doc_ids[0] == 0 and r.length >= substring_dedup.MIN_RUN
    left = {r.doc_id: r.text for r in substring_dedup.remove_spans(docs, substring_dedup.duplicate_spans(docs)).collect()}
    assert left[0] == rows[0][1]
    for r in got:
        assert len(left[r.doc_id].encode()) == len(texts[r.doc_id]) - r.length


def test_passages_of_51_words_at_any_offset_are_marked_whole(spark):
    n, rows, spans = 300, [], {}
    for i in range(n):
        passage = words(51, 5000 + i, 10 ** 6)
        for d in (i, n + i):
            before = words(5 + (d * 7) % 60, 10 ** 5 + d, 10 ** 6) + " "
            rows.append(document(d, before + passage + " " + words(10 + d % 40, 2 * 10 ** 5 + d, 10 ** 6)))
        spans[n + i] = (len(before.encode()), len(passage.encode()))
    got = {r.doc_id: r for r in substring_dedup.duplicate_spans(spark.createDataFrame(rows, CLASHING)).collect()}
    assert set(got) == set(spans)
    for d, (start, length) in spans.items():
        r = got[d]
        assert r.start <= start and r.start + r.length >= start + length and r.length < length + 12 and r.first_doc_ids == [d - n]


def test_spans_extend_over_several_reaches(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "REACH", 7)
    passage = "é" * 3 + "ñandú " + words(51, 3, 10 ** 6) + " ü€" * 3
    docs = spark.createDataFrame([document(i, f"{words(20 + i, i, 10 ** 6)} {passage}{'àâ'[i]} {words(9, 50 + i, 10 ** 6)}") for i in range(2)], CLASHING)
    (r,) = substring_dedup.duplicate_spans(docs).collect()
    text = docs.where("doc_id = 1").first().text.encode()
    assert passage in text[r.start:r.start + r.length].decode()


def test_repeated_words_are_found_at_any_phase(spark):
    docs = spark.createDataFrame([document(i, f"{words(20 + i, i, 10 ** 6)} " + "Heat " * 400) for i in range(4)], CLASHING)
    got = substring_dedup.duplicate_spans(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and all(r.length > 1500 for r in got)


def test_spans_of_odd_rows(spark):
    docs = odd(spark)
    spans = substring_dedup.duplicate_spans(docs)
    got = {r.doc_id: r for r in spans.collect()}
    assert got[7].length == len(odd_rows()[5][1]) and got[7].first_doc_ids == [6]  # a whole copy
    assert set(got) == {7, 9, 10}
    out = substring_dedup.remove_spans(docs, spans)
    assert out.columns == docs.columns and out.count() == len(odd_rows())
    assert [r.text for r in out.where("doc_id = 7").collect()] == [""]
    assert substring_dedup.duplicate_spans(none(spark)).collect() == []


def test_span_plan_broadcasts_nothing(spark):
    plan = substring_dedup.duplicate_spans(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_repeats_of_260_bytes_are_covered(spark):
    """Spans against brute force: bytes of passages that lie in texts of smaller id for 260 bytes on are marked, and nothing
    that lies in none for 100.  Of shorter passages most are."""
    rnd = random.Random(8)
    texts, passages = [], [words(rnd.randrange(20, 90), 900 + k) for k in range(12)]
    for k in range(40):
        parts = [words(rnd.randrange(3, 60), k, 100_000)]
        for _ in range(rnd.randrange(4)):
            parts += [rnd.choice(passages), words(rnd.randrange(0, 20), 50 + k, 100_000)]
        texts.append(" ".join(parts))
    texts[30] = texts[3]
    rows = [document(i, t, f"s{i}") for i, t in enumerate(texts)]
    spans = {}
    for r in substring_dedup.duplicate_spans(spark.createDataFrame(rows, CLASHING)).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))

    def covered(i, n):
        out = set()
        for at in range(len(texts[i]) - n + 1):
            if any(texts[i][at:at + n] in texts[j] for j in range(i)):
                out.update(range(at, at + n))
        return out

    repeated = missed = all_short = missed_short = 0
    for i in range(len(texts)):
        marked, want = spans.get(i, set()), covered(i, 260)
        repeated, missed = repeated + len(want), missed + len(want - marked)
        short = covered(i, 100)
        assert len(marked - short) == 0
        all_short, missed_short = all_short + len(short), missed_short + len(short - marked)
    assert repeated > 5000 and missed < 0.01 * repeated, (repeated, missed)
    assert missed_short < 0.2 * all_short, (all_short, missed_short)
    assert len(spans) > 20 and spans[30] == set(range(len(texts[30])))

"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import numpy as np

from llm_cases import CLASHING, document, labels, none, odd, odd_rows, words
from zonecast.llm import decontamination, filter_audit, prefix_trie
from zonecast.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- 11


def brute_audit(rows, label_rows):
    good = {d for d, q, _ in label_rows if q == 1 and d is not None}
    toxic = {d for d, _, t in label_rows if t == 1 and d is not None}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    docs = defaultdict(list)
    for d, t, _, source, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        docs[source or ""].append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out, share = {}, Counter()
    for part, all_docs in docs.items():
        for order in map("".join, permutations("ABCDE")):
            left = all_docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in all_docs)
                share[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in all_docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


AUDIT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in AUDIT) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_brute_force_on_odd_rows(spark):
    same = words(250, 9)
    rows = [*odd_rows(), *[document(100 + i, same, f"src{i % 3}") for i in range(30)], *[document(200, same, "src1")] * 2,
            document(50, "LOUD " * 300), document(51, "a b " * 200 + "#"), document(52, words(400, 1) + " 100%", "src2")]
    lab = [(100, 1, 0), (101, 1, 1), (101, 0, None), (50, 0, 1), (51, None, 1), (200, 1, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, CLASHING)
    assert audited(filter_audit.filter_audit(docs, labels(spark, lab))) == brute_audit(rows, lab)
    assert filter_audit.filter_audit(none(spark), labels(spark, lab)).count() == 0


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = (words(5000, 2, 300) + "\n\t" + "x" * 500 + " ").encode()
    whole = filter_audit.word_counts(text)
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    assert filter_audit.word_counts(text) == whole == (len(text.split()), len(set(text.split())))


def test_potential_gives_the_mean_of_all_orders():
    rnd = np.random.default_rng(1)
    counts = rnd.integers(0, 50, (3, 7, 8))
    got = filter_audit.steps(counts, 3)
    own = np.array(list(permutations(range(3)))).ravel()
    for f in range(3):
        assert (got["shapley"][:, own == f] == got["removed"][:, own == f].sum(axis=1, keepdims=True)).all()


# ---- 12


def brute_trie(paths):
    """All nodes of conversations ``{id: [(role, text), ...]}``."""
    members = defaultdict(list)
    for c, turns in sorted(paths.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, below = Counter(p[:-1] for p in members if p), defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    return {(m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), children[p], sum(not children[q] for q in below[p]),
                             sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q),
                             sha(",".join(str(c) for c in m if len(paths[c]) == len(p)))) for p, m in members.items()}


def brute_turns(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, hashlib.md5(f"{role or ''}\1{text or ''}".encode()).digest(), role or "", text or ""))
    return {c: [x[3:] for x in sorted(t)] for c, t in by.items()}


def rebuilt(by):
    out = {}
    for c, own in by.items():
        h = crc32(str(c).encode()) % 9
        out[c] = by.get(c - c % 5, [])[:h] + own[h:]
    return out


def nodes(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


TURNS = "conv_id long, turn long, role string, text string, n int, k1 string, pos int, bytes string"


def conversations(n=400):
    rnd, rows = random.Random(5), []
    for c in rnd.sample(range(3 * n), n):
        hot = rnd.random() < 0.4
        for t in range(rnd.randrange(1, 9)):
            text = "héllo" if hot and t < 4 else rnd.choice(["", None, "a", "bb", "ccc"]) if rnd.random() < 0.8 else f"own {c} {t}"
            rows.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "user", "assistant", None]) if not hot else "user", text, 1, "x", 2, "y"))
    rows += [(None, 1, "user", "nobody's", 1, None, None, None), (5000, None, None, None, None, None, None, None)]
    rows += [(6000, t, "user", f"long {t % 7}", 1, "", 0, "") for t in range(700)] + [(6001, t, "user", f"long {t % 7}", 1, "", 0, "") for t in range(690)]
    return rows + rows[:5]


def test_trie_of_shared_heads_equals_brute_force(spark):
    rows = conversations()
    turns = written(prefix_trie.turn_keys(spark.createDataFrame(rows, TURNS)), "t")
    assert nodes(prefix_trie.trie(prefix_trie.shared_heads(turns))) == brute_trie(rebuilt(brute_turns(rows)))


def test_trie_does_not_depend_on_slabs(spark, monkeypatch):
    rows = conversations(150)
    df = spark.createDataFrame(rows, TURNS)
    want = brute_trie(brute_turns(rows))
    assert nodes(prefix_trie.prefix_trie(df.coalesce(1))) == want
    monkeypatch.setattr(prefix_trie, "SLAB_CONVERSATIONS", 7)
    assert nodes(prefix_trie.prefix_trie(df)) == want
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_ends_are_packed_without_loss():
    for ids in ([3], [-5, 0, 7], list(range(-100, 5000, 3)), [-(1 << 62), 1 << 62]):
        assert prefix_trie._unpacked(prefix_trie._packed(np.array(ids))).tolist() == ids


# ---- 13


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return ITEM_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(docs, benchmark):
    windows = defaultdict(set)
    for item, text in benchmark:
        w = normal(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i:i + 10])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, items = normal(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[x]
        ids = sorted(str(x) for x in items if x is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


ITEMS = "item_id long, text string, spans string, n_words int, row int"


def leak_case():
    rnd = random.Random(3)
    shared = words(15, 77)
    bench = [(i, words(rnd.randrange(5, 60), i, 400), "s", 1, 2) for i in range(40)]
    bench += [(100 + i, f"{words(12, 200 + i)} {shared}", None, None, None) for i in range(30)]
    bench += [(10, "Two Words", "s", 1, 2), (11, "naïve", "s", 1, 2), (12, "", "s", 1, 2), (13, None, "s", 1, 2), (None, words(20, 500), "s", 1, 2),
              (14, "a b a b a b a b a b a b a", "s", 1, 2), bench[0], (0, words(30, 600), "s", 1, 2), (15, words(3000, 700), "s", 1, 2)]
    docs = [(r[0], r[1]) for r in odd_rows()]
    docs += [(500, "xx TWO, words! yy"), (501, "twowords two word"), (502, "NaÏve naïve"), (503, "a b " * 30), (504, words(2998, 700).upper() + " end"),
             (505, f"{shared} and {shared.upper().replace(' ', ' -- ')}"), (506, shared.replace(" ", "x ", 1)), (507, words(20, 500))]
    for k in range(60):
        parts = [words(rnd.randrange(0, 50), 1000 + k)]
        for _ in range(rnd.randrange(3)):
            text = rnd.choice(bench)[1] or ""
            cut = rnd.randrange(0, max(len(text) // 2, 1))
            parts += [text[cut:cut + 200], words(rnd.randrange(0, 8), k)]
        docs.append((600 + k, " ".join(parts)))
    return docs + docs[-3:], bench


def test_leaks_equal_brute_force_in_one_band_and_several(spark):
    docs, bench = leak_case()
    d = spark.createDataFrame([(i, t, "r", 1, "s") for i, t in docs], "doc_id long, text string, row string, n_words int, spans string")
    b = spark.createDataFrame(bench, ITEMS)
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    want = key(brute_leaks(docs, [x[:2] for x in bench]))
    assert key(decontamination.report(decontamination.find(d, b)).collect()) == want
    assert key(decontamination.report(decontamination.find(d, b, band_bytes=9000, piece_words=50)).collect()) == want
    empty = spark.createDataFrame([], ITEMS)
    assert not decontamination.report(decontamination.find(d, empty)).where("contaminated or n_items > 0 or n_hit > 0").count()
    assert decontamination.find(none(spark), b).count() == 0


def test_hits_are_verified_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(decontamination.Words, "hashes", lambda self: np.zeros(len(self.cut) - 1, np.uint64))
    texts = [words(12, 1, 3).encode(), words(12, 2, 3).encode(), b"w1 w2"]
    held = decontamination.windows_of(["a", "b", "c"], texts)
    doc = words(400, 3, 3)
    w = decontamination.words_of(np.frombuffer(doc.encode(), np.uint8), np.array([0, len(doc)]), decontamination.INSIDE)
    got = {(int(i), held.ids[x]) for i, k in zip(*held.find(w)) for x in held.item[held.of[k]:held.of[k + 1]]}
    want = set()
    for name, t in zip("abc", texts):
        t = t.decode().split()
        for n in {min(len(t), 10)}:
            for s in range(len(t) - n + 1):
                want |= {(i, name) for i in range(400 - n + 1) if doc.split()[i:i + n] == t[s:s + n]}
    assert got == want and want


def test_hit_runs_or_documents_are_removed(spark):
    passage = words(12, 4)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [document(1, f"Vor – {passage.upper()}; nach"), document(2, "clean text"), document(3, None), document(None, passage)]
    docs = spark.createDataFrame(rows, CLASHING)
    cut = {r.doc_id: r.text for r in decontamination.decontaminated(docs, bench).collect()}
    assert cut == {1: "Vor – ; nach", 2: "clean text", 3: None, None: ""}
    left = decontamination.decontaminated(docs, bench, whole=True)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert sorted(map(repr, left.collect())) == sorted(map(repr, docs.where("doc_id in (2, 3)").collect()))
    assert decontamination.decontaminated(odd(spark), bench).count() == len(odd_rows())

"""Operators 1 and 6 and the cached encoder, against the tokenizers library and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_cases import SMALL, document, none, odd, odd_rows
from zonecast.llm import packing, queries, record_files
from zonecast.llm.tokens import Encoder

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda text: np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_library(plain):
    rnd, enc = random.Random(1), Encoder(PATH)
    texts = ["", " ", "a  b\n\n c", "İstanbul ΣΑΣ x́ <|endoftext|>b a\tb\rc", "don't I'LL 1234 ½ ×÷ ß \x1c q\x85b ﬁ Å",
             *("".join(rnd.choice("aéß'sS ½\n\t×!7́ ΣİÅ<|>") for _ in range(50)) for _ in range(300))]
    assert [enc.ids(t) for t in texts] == [plain(t) for t in texts]
    assert enc.ids(None) == b""


def test_encoder_caches_are_bounded(plain):
    enc = Encoder(PATH, cache=8)
    texts = ["alpha beta gamma delta", "epsilon zeta eta theta iota", "alpha zeta kappa lambda mu nu", "alpha beta", "Über café naïve", "alpha, beta. gamma!"]
    for t in texts * 3:
        assert enc.ids(t) == plain(t)
    assert len(enc.words) <= 8 + 6 and len(enc.pieces) <= 4


def test_crc32c_known_values_and_any_length():
    def slow(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert record_files.crc32c([b"123456789"])[0] == 0xE3069283
    assert record_files.crc32c([bytes(32)])[0] == 0x8A9136AA
    rnd = random.Random(2)
    parts = [rnd.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 8, 63, 64, 65, 127, 128, 129, 1000, 4097)]
    assert record_files.crc32c(parts).tolist() == [slow(p) for p in parts]
    assert len(record_files.crc32c([])) == 0


def test_damaged_records_are_found():
    frame = bytearray(record_files.frames([b"hello world"])[0])
    assert record_files.unframe([bytes(frame)]) == [b"hello world"]
    for at in (0, 9, 14, len(frame) - 1):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            record_files.unframe([bytes(bad)])


def records(spark, docs, seed=None, **how):
    folder, manifest = record_files.write_records(docs, PATH, **how)
    return folder, manifest, record_files.read_records(manifest, folder, seed).collect()


def test_record_files_round_trip(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder, manifest, got = records(spark, docs, file_bytes=100_000, rows_at_once=10)
    assert manifest.count() > 2
    start = 0
    want = []
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = plain(r.text) + (1).to_bytes(4, "little")
        want.append((r.doc_id, start, len(ids) // 4, ids))
        start += len(ids) // 4
    key = lambda r: r[:2]
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=key) == want
    again = record_files.read_records(manifest, folder, seed=5)
    rows = again.collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in rows), key=key) == want
    by_file = defaultdict(list)
    for r in rows:
        by_file[r.part, r.seq].append(r.pos)
    assert any(p != sorted(p) for p in by_file.values())


def test_record_files_odd_rows(spark, plain):
    _, _, got = records(spark, odd(spark))
    want = Counter((r[0], plain(r[1]) + (1).to_bytes(4, "little")) for r in odd_rows())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert records(spark, none(spark))[2] == []


def checked_pieces(rows, texts, plain, end=2):
    """Every id in exactly one piece, sequences gapless from 0 and full but for the last."""
    want = Counter()
    for doc_id, text in texts:
        want[doc_id, plain(text) + end.to_bytes(4, "little")] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or k == len(sequences) - 1
    assert sum(r.length for r in rows) == sum(len(i) // 4 * n for (_, i), n in want.items())
    for (doc_id, ids), n in want.items():
        own = [p for s in range(len(ids) // 4) for p in [x for x in pieces[doc_id, len(ids) // 4] if x[0] == s]]
        covered = Counter()
        for s, part in own:
            covered.update(range(s, s + len(part) // 4))
        same = sum(m for (d, i), m in want.items() if d == doc_id and len(i) == len(ids))
        assert set(covered) == set(range(len(ids) // 4)) and set(covered.values()) == {same}
        if n == same == 1:
            assert all(ids[4 * s:4 * s + len(part)] == part for s, part in own)
    return sequences


def test_packing_whole_corpus(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    checked_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], plain)
    total, windows = Counter(), defaultdict(Counter)
    for r in rows:
        total[r.queue] += r.length
        windows[r.sequence_id][r.queue] += r.length
    all_tokens = sum(total.values())
    for k in range(max(windows) // 2):
        for q, n in total.items():  # within what the rounds and the integer weights carry over
            assert abs(windows[k][q] - packing.WINDOW * n / all_tokens) <= len(total)


def test_packing_targets_and_drained_queues(spark, plain):
    docs = spark.createDataFrame([document(i, " ".join(["word"] * 700), "src1" if i % 10 else "src2") for i in range(60)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"c{i} string" for i in range(17)))
    rows = packing.pack(docs, PATH, targets={"src1": 0.5, "src2": 0.5}).collect()
    checked_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], plain)
    first = Counter()
    for r in rows:
        if r.sequence_id == 0:
            first[r.queue] += r.length
    assert abs(first["ssrc1"] - first["ssrc2"]) <= 2
    unnamed = packing.pack(docs, PATH, targets={"src1": 1.0}).collect()
    checked_pieces(unnamed, [(r.doc_id, r.text) for r in docs.collect()], plain)


def test_packing_odd_rows(spark, plain):
    rows = packing.pack(odd(spark), PATH).collect()
    checked_pieces(rows, [(r[0], r[1]) for r in odd_rows()], plain)
    assert packing.pack(none(spark), PATH).collect() == []


def test_rounds_closed_form_equals_replay():
    rnd = random.Random(4)
    for _ in range(20):
        tokens = [rnd.randrange(1, 20_000) for _ in range(rnd.randrange(1, 6))]
        raw = [rnd.random() for _ in tokens]
        weights = [max(1, round(w / sum(raw) * packing.UNIT)) for w in raw]
        stream, credit, served = [], [0] * len(tokens), [0] * len(tokens)
        while any(s < t for s, t in zip(served, tokens)):
            for q, w in enumerate(weights):  # grant, serve whole tokens, carry the fraction
                credit[q] += w * packing.WINDOW
                n = min(credit[q] // packing.UNIT, tokens[q] - served[q])
                credit[q] -= credit[q] // packing.UNIT * packing.UNIT
                stream += [(q, u) for u in range(served[q], served[q] + n)]
                served[q] += n
        r = packing.Rounds(tokens, weights)
        queue = np.array([q for q, _ in stream])
        token = np.array([u for _, u in stream])
        rounds = r.round_of(token, queue)
        assert (r.place(rounds, queue) + token - r.served(rounds, queue) == np.arange(len(stream))).all()


def test_sequences_are_padded_unless_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "word " * 5000, "a")], "doc_id long, text string, source string")
    got = {r.sequence_id: r for r in packing.sequences(packing.pack(docs, PATH), pad_id=7).collect()}
    assert {len(r.ids) // 4 for r in got.values()} == {packing.WINDOW}
    assert bytes(got[1].ids)[4 * got[1].used:] == (7).to_bytes(4, "little") * (packing.WINDOW - got[1].used)
    two = spark.createDataFrame([(1, "word word word", "a")], "doc_id long, text string, source string")
    assert len(packing.sequences(packing.pack(two, PATH)).first().ids) == 16


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        packing.pack(odd(spark), PATH)


def test_queries_equal_the_operators(spark, plain):
    rows = queries.op1_packing(spark, SMALL).collect()
    ids = {r.doc_id: plain(r.text) + (2).to_bytes(4, "little") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start:4 * (r.start + r.length)]) for r in rows)
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in ids.values())
    assert queries.op6_record_files(spark, SMALL).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("keep", [True, False])
def test_workers_keep_words_only_if_asked(spark, keep):
    """Other stages share the workers' memory; the pieces are the same either way."""
    import pyarrow as pa

    from zonecast.llm import tokens

    cache = 12_345 + keep
    docs = spark.createDataFrame([(i, f"alpha beta {i} gamma", f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string").repartition(8)

    def held(it):
        for _ in it:
            yield pa.RecordBatch.from_arrays([pa.array([(PATH, cache) in tokens._ENCODERS])], ["held"])

    got = packing.pack(docs, PATH, cache=cache, keep=keep)
    assert got.agg({"length": "sum"}).first()[0] == got.dropDuplicates(["doc_id"]).agg({"doc_tokens": "sum"}).first()[0]
    found = {r["held"] for r in spark.range(0, 64, 1, 64).mapInArrow(held, "held boolean").collect()}
    assert (True in found) == keep

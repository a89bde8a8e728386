"""Operator 13: benchmark decontamination with a broadcast set of normalised test n-grams.

Both sides are lower-cased (A-Z) and cut into words of digits, a-z and anything beyond ASCII.  Every ``WINDOW``
consecutive words of a benchmark item are a window; an item of fewer words is one window.  The set of windows' hashes is
broadcast; a task rolls the hash of every window length over its texts' words, looks the hashes up, and compares the
words of each hit with the window's, so equal hashes alone decide nothing.  A document's words inside any occurrence are hit.

The set's size is checked: items are cut into pieces that overlap by ``WINDOW`` - 1 words, and where all pieces have more
than ``BAND_BYTES`` bytes they are dealt into bands of about half that; the texts are scanned once a band and the hits of
a text are merged.  One band and several give the same result.  Equal windows of many items are held once, with the list
of their items, and equal sets of windows are resolved to items once a task.

Defined cases: a NULL or empty text has no words; NULL ids are carried through, and repeated rows each have their row; a
NULL item id's windows are hit but name no item; repeated items count once, and two texts of one item id are one item;
a text longer than a run of ``RUN_BYTES`` is scanned by itself; an empty benchmark hits nothing; other columns, whatever
their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonecast.llm.common import portions, ship, text_buffer, written
from zonecast.llm.words import Words, words_of

WINDOW = 10
#: Bytes of benchmark words that one broadcast set holds, words of a piece of an item, bytes of text scanned at once.
BAND_BYTES, PIECE_WORDS, RUN_BYTES = 16 << 20, 1000, 2 << 20
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _inside() -> np.ndarray:
    """Whether a byte belongs to a word: digits, letters and anything beyond ASCII."""
    out = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        out[lo:hi] = True
    return out


INSIDE = _inside()


def window_hashes(word: np.ndarray, longest: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hash of every run of that many words."""
    h = word
    for n in range(1, longest + 1):
        yield n, (h ^ h >> np.uint64(31)) * _ODD + np.uint64(n)
        if len(h) <= 1:
            return
        h = h[:-1] * _MIX + word[n:]


def same(a: Words, i: np.ndarray, b: Words, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words of ``a`` from i on are those of ``b`` from k on, for each (i, k, n)."""
    ok = a.cut[i + n] - a.cut[i] == b.cut[k + n] - b.cut[k]
    for j in range(int(n.max(initial=0))):
        more = np.flatnonzero(ok & (n > j))
        ok[more] = a.cut[i[more] + j + 1] - a.cut[i[more]] == b.cut[k[more] + j + 1] - b.cut[k[more]]
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), 1 << 15):  # some pairs at a time
        some = at[lo:lo + (1 << 15)]
        size = a.cut[i[some] + n[some]] - a.cut[i[some]]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = a.data[np.repeat(a.cut[i[some]], size) + inner] != b.data[np.repeat(b.cut[k[some]], size) + inner]
        ok[some[np.repeat(np.arange(len(some)), size)[differ]]] = False
    return ok


@dataclass(frozen=True)
class Windows:
    """The distinct windows of some items, ascending by hash: where each begins in ``words``, its length, and its items
    ``item[of[w]:of[w + 1]]``, numbers into the ascending ``ids``."""
    words: Words
    hash: np.ndarray
    at: np.ndarray
    n: np.ndarray
    of: np.ndarray
    item: np.ndarray
    ids: np.ndarray
    seen: np.ndarray
    shift: np.uint64

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """``i, w``: window w occurs at word i, inside one text."""
        stop = np.repeat(words.first[1:], np.diff(words.first))
        found = [], []
        lengths = set(self.n.tolist())
        for n, h in window_hashes(words.hashes(), max(lengths, default=0)):
            if n not in lengths:
                continue
            i = np.flatnonzero(self.seen[h >> self.shift])
            i = i[i + n <= stop[i]]
            w = np.searchsorted(self.hash, h[i])
            while len(i):  # windows of one hash lie side by side
                here = (w < len(self.hash)) & (self.hash[np.minimum(w, len(self.hash) - 1)] == h[i])
                i, w = i[here], w[here]
                ok = (self.n[w] == n) & same(words, i, self.words, self.at[w], np.full(len(i), n))
                found[0].append(i[ok])
                found[1].append(w[ok])
                i, w = i[~ok], w[~ok] + 1
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def windows_of(ids: list[str | None], texts: list[bytes]) -> Windows:
    """The windows of pieces of items."""
    offsets = np.cumsum([0, *map(len, texts)])
    words = words_of(np.frombuffer(b"".join(texts), np.uint8), offsets, INSIDE)
    size = np.diff(words.first)
    names = np.array(sorted({x for x in ids if x is not None}), object)
    number = {x: k for k, x in enumerate(names)}
    owner = np.array([number.get(x, -1) for x in ids], np.int64)
    at, n, h, item = [], [], [], []
    for length, hashes in window_hashes(words.hashes()):
        ours = np.flatnonzero(size >= length if length == WINDOW else size == length)
        count = size[ours] - length + 1
        i = np.repeat(words.first[:-1][ours], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at.append(i)
        n.append(np.full(len(i), length))
        h.append(hashes[i])
        item.append(np.repeat(owner[ours], count))
    at, n, item = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, n, item))
    h = np.concatenate([np.zeros(0, np.uint64), *h])
    order = np.argsort(h, kind="stable")
    window = np.full(len(h), -1)  # the window of its kind that stands for it
    left = order
    while len(left):
        new = np.concatenate([[True], h[left[1:]] != h[left[:-1]]])
        head = left[np.flatnonzero(new)[np.cumsum(new) - 1]]
        ok = (n[left] == n[head]) & same(words, at[left], words, at[head], np.minimum(n[left], n[head]))
        window[left[ok]] = head[ok]
        left = left[~ok]
    heads = order[window[order] == order]
    place = np.empty(len(h), np.int64)
    place[heads] = np.arange(len(heads))
    pairs = np.unique(np.stack([place[window], item], axis=1)[item >= 0], axis=0) if len(h) else np.zeros((0, 2), np.int64)
    bits = max(10, int(16 * len(heads)).bit_length())
    seen, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
    seen[h >> shift] = True
    return Windows(words, h[heads], at[heads], n[heads], np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1)), pairs[:, 1], names, seen, shift)


def pieces(benchmark: DataFrame, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``item_id (string), text``: the distinct pieces of the normalised items, each of at most ``piece_words + WINDOW - 1`` words."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it):
            w = words_of(*text_buffer(b), INSIDE)
            raw, ids, out = w.data.tobytes(), b.column(0).to_pylist(), ([], [])
            for item, lo, hi in zip(ids, w.first.tolist(), w.first[1:].tolist()):
                for at in range(lo, max(hi - WINDOW, lo) + 1 if hi > lo else lo, piece_words):
                    ends = w.cut[at:min(hi, at + piece_words + WINDOW - 1) + 1].tolist()
                    out[0].append(item)
                    out[1].append(b" ".join([raw[a:z] for a, z in zip(ends, ends[1:])]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["item_id", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return written(items.mapInArrow(rows, "item_id string, text binary").distinct(), "benchmark-pieces")


FOUND = "n_words long, spans array<struct<word:long,n_words:long,start:long,length:long>>, items array<string>"


def _scan(rows: DataFrame, windows: Windows) -> DataFrame:
    """``text, row`` with the columns of ``FOUND``."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)  # of at most about BAND_BYTES of words

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, resolved = shared.value, {}
        for b in portions(it, RUN_BYTES):
            data, offsets = text_buffer(b)
            words = words_of(data, offsets, INSIDE)
            n_words = np.diff(words.first)
            i, w = held.find(words)
            step = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(step, i, 1)
            np.add.at(step, i + held.n[w], -1)
            hit = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
            new_text = np.zeros(len(words.start) + 1, bool)
            new_text[words.first] = True
            up = np.flatnonzero(hit[1:-1] & (~hit[:-2] | new_text[:-1]))  # a span ends with its text
            down = np.flatnonzero(hit[1:-1] & (~hit[2:] | new_text[1:])) + 1
            doc = np.searchsorted(words.first, up, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (
                up - words.first[doc], down - up, words.start[up] - offsets[doc], words.stop[down - 1] - words.start[up])], names=["word", "n_words", "start", "length"])
            of_text = np.searchsorted(words.first, i, "right") - 1
            pairs = np.unique(np.stack([of_text, w], axis=1), axis=0)
            cuts = np.searchsorted(pairs[:, 0], np.arange(b.num_rows + 1)).tolist()
            items = []
            for lo, hi in zip(cuts, cuts[1:]):
                key = pairs[lo:hi, 1].tobytes()
                if key not in resolved:
                    if len(resolved) >= 1000:
                        resolved.clear()
                    ours = [held.item[held.of[x]:held.of[x + 1]] for x in pairs[lo:hi, 1].tolist()]
                    resolved[key] = held.ids[np.unique(np.concatenate(ours))].tolist() if ours else []
                items.append(resolved[key])
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words), pa.ListArray.from_arrays(pa.array(ends), spans), pa.array(items, pa.list_(pa.string()))],
                                             names=[*b.schema.names, "n_words", "spans", "items"])

    return rows.mapInArrow(scan, StructType(rows.schema.fields + StructType.fromDDL(FOUND).fields))


def _merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits ``key, spans, items`` of several bands (lists of lists) as one list each."""
    for b in it:
        spans, items = [], []
        for per_band in b.column(1).to_pylist():
            joined: list[dict] = []
            for s in sorted((s for band in per_band for s in band), key=lambda s: s["word"]):
                if joined and s["word"] <= joined[-1]["word"] + joined[-1]["n_words"]:
                    old = joined[-1]
                    words = max(old["word"] + old["n_words"], s["word"] + s["n_words"]) - old["word"]
                    old |= {"n_words": words, "length": max(old["start"] + old["length"], s["start"] + s["length"]) - old["start"]}
                else:
                    joined.append(dict(s))
            spans.append(joined)
        for per_band in b.column(2).to_pylist():
            items.append(sorted({x for band in per_band for x in band}))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, b.schema.field(1).type.value_type), pa.array(items, b.schema.field(2).type.value_type)],
                                         names=["key", "spans", "items"])


def find(docs: DataFrame, benchmark: DataFrame, band_bytes: int = BAND_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``text``, ``row`` (a struct of the other columns), ``n_words``, ``spans`` (the hit words as runs: first word, number of
    words, first byte, bytes) and ``items`` (ids of items with occurring windows, ascending as text) of every row."""
    ship(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*others, F.lit(None).cast("int").alias("__no")).alias("row"))
    parts = pieces(benchmark, piece_words)
    total = parts.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    if total <= band_bytes:
        return _scan(rows, _collected(parts))
    bands = -(-2 * total // band_bytes)
    parts = parts.withColumn("band", F.expr(f"pmod(xxhash64(item_id, text), {bands})"))
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "decontamination-rows")  # written once, so that keys stay
    found = None
    for band in range(bands):  # each within the bound
        got = written(_scan(rows.select("key", "text"), _collected(parts.where(F.col("band") == band))).where("size(spans) > 0").select("key", "spans", "items"), "band-hits")
        found = got if found is None else found.union(got)
    hits = found.groupBy("key").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).mapInArrow(
        _merged, "key long, " + FOUND.split(", ", 1)[1])
    counted = _scan(rows, windows_of([], [])).drop("spans", "items").join(hits, "key", "left").drop("key")
    return counted.withColumn("spans", F.coalesce("spans", F.array())).withColumn("items", F.coalesce("items", F.array()))


def _collected(parts: DataFrame) -> Windows:
    got = parts.select("item_id", "text").toArrow()  # within the bound of a band
    return windows_of(got["item_id"].to_pylist(), got["text"].to_pylist())


def decontaminated(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a window (``whole``), or with the hit runs of words cut out of their texts."""
    found = find(docs, benchmark)
    if whole:
        found = found.where("size(spans) = 0")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(0).to_pylist()
            for k, spans in enumerate(b.column(2).to_pylist()):
                if spans:
                    raw, kept, at = texts[k].encode(), [], 0
                    for s in spans:
                        kept.append(raw[at:s["start"]])
                        at = s["start"] + s["length"]
                    texts[k] = b"".join([*kept, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(1)], names=["text", "row"])

    rows = found.select("text", "row", "spans")
    out = rows.mapInArrow(cut, rows.select("text", "row").schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of the rows of ``find``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def oracle_sql(longest: int = WINDOW) -> str:
    """The same report in DuckDB SQL."""
    lower = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({lower}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, coalesce({lower}, []) AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), {longest}) AS n, array_to_string(w[p:p + least(len(w), {longest}) - 1], ' ') AS t
      FROM b, unnest(range(1, greatest(len(w) - {longest}, 0) + 2)) x(p) WHERE len(w) > 0),
s AS (SELECT k, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM i) l, unnest(range(1, len(w) - n + 2)) x(p)),
h AS (SELECT DISTINCT k, p, n, t FROM s WHERE (n, t) IN (SELECT (n, t) FROM i)),
c AS (SELECT k, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + n)) x(q) GROUP BY k),
m AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT k, item FROM h JOIN i USING (n, t) WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN m USING (k)"""

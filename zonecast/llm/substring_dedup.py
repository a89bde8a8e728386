"""Operator 2: substring deduplication by content-defined chunking.

A gear hash rolls over a text's bytes: ``h = (h << 1) + gear[byte]`` modulo 2^32, so it depends on the
last 32 bytes alone.  A chunk ends where the top bits of the hash are zero, at ``MIN`` bytes or
more; if that is nowhere up to ``MAX`` bytes, where the hash is greatest.  An insertion moves only the chunks around it; after the next shared end the chunks of two
texts agree again.  A chunk's anchor is the chunk with as many whole chunks before it as make ``ANCHOR`` bytes; it is
known by a 64-bit digest.  Of every ``WINDOW`` consecutive anchors the one of least digest is stored, so two texts that share
``WINDOW`` consecutive anchors (as pieces of some 260 bytes do) store one of them both, and two that share fewer often do; a stored
anchor that a document of smaller id has too is a repeat.  Repeats of one first document are one run where they overlap or touch, or
where the digest of all bytes from one to the next is that of the first document at the same distance.  A run is
extended to the left and right for as long as its bytes equal those around its
first occurrence; runs that then have ``MIN_RUN`` bytes or more are duplicate spans, joined where they overlap or touch.  Touching runs of several first documents count by their sum where no span is.  An anchor has
fewer bytes than ``MIN_RUN``, so two digests that are equal by chance make no span.  Not marked: the end of a piece that the
run's first document lacks, unless an anchor stored for that end too says who has it; shared pieces of less than some 260 bytes that have no stored anchor in common.

* Digests, offsets, ids, the bytes around a run's ends and, a round of extension, the compressed texts are shuffled: the same plan at every size, nothing is broadcast.  Each digest's first place is an aggregate with
  map-side combine, so a passage that a third of all documents hold is one row a task.
* Ends lie between characters, so removed spans leave valid text.

Defined cases: NULL or short texts are one chunk at most; a chunk repeated within one document only, or
among rows of one id, is no repeat; NULL ids count as the greatest id; an empty table has no spans.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import _batch, batches, discard, documents, text_buffer, text_bytes, written

MIN, MAX, MASK_BITS, WINDOW = 8, 64, 4, 4
#: Least bytes of an anchor; bytes compared at a run's end at first, 64 times as many each further round.
ANCHOR, REACH = 32, 64
MIN_RUN = 100
NO_ID = (1 << 63) - 1


def gear(seed: int = 1) -> np.ndarray:
    """A 32-bit value for each byte from a seeded splitmix64 stream."""
    out, x = [], seed
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
        z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
        out.append((z ^ z >> 31) >> 32)
    return np.array(out, np.uint32)


_GEAR = gear()


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash of each text after each byte: windows of 1, 2, 4 ... 32 bytes by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            head = offsets[:-1, None] + np.arange(k)  # a text's first k bytes have no window before theirs
            head = head[head < offsets[1:, None]]
            more[head] = h[head]
            h = more
    return h


def cut_points(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """For each text the ends of its chunks, in bytes of the text."""
    starts_char = np.ones(len(data) + 1, bool)
    starts_char[:-1] = data & 0xC0 != 0x80
    h = gear_hashes(data, offsets)
    found = np.flatnonzero((h >> np.uint32(32 - MASK_BITS) == 0) & starts_char[1:]) + 1
    for a, z in zip(offsets.tolist(), offsets[1:].tolist()):
        lo, hi = np.searchsorted(found, (a, z + 1)).tolist()
        ends, last, here = [], a, found[lo:hi].tolist()
        while z - last > MIN:
            k = bisect_left(here, last + MIN)
            end = here[k] if k < len(here) else z
            if end - last > MAX:  # as in text that repeats a word: the greatest hash so far, so that its phase decides
                reach = np.where(starts_char[last + MIN:last + MAX + 1], h[last + MIN - 1:last + MAX], 0)
                end = last + MIN + int(reach.argmax())
            ends.append(end - a)
            last = end
        if last < z:
            ends.append(z - a)
        yield ends


def least(digests: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places of the least digest of every ``window`` consecutive ones (of all, if fewer), ascending."""
    if len(digests) <= window:
        return np.array([digests.argmin()]) if len(digests) else np.zeros(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(digests, window).argmin(axis=1) + np.arange(len(digests) - window + 1))


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, t (text hash), start, length, d, link`` of every stored anchor; ``link`` is the digest of the bytes from the stored
    anchor before on, NULL for a text's first."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for big in it:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                data, offsets = text_buffer(b)
                raw = data.tobytes()
                count, start, length, d, link = [], [], [], [], []
                for a, ends in zip(offsets.tolist(), cut_points(data, offsets)):
                    back, cuts, spans = 0, [0, *ends], []
                    for end in ends:
                        if end < ANCHOR:
                            continue
                        while cuts[back + 1] <= end - ANCHOR:
                            back += 1
                        spans.append((a + cuts[back], a + end))
                    own = np.array([digest(raw[x:z]) for x, z in spans], np.uint64)
                    kept, before = least(own).tolist(), None
                    for i in kept:
                        x, z = spans[i]
                        start.append(x - a)
                        length.append(z - x)
                        link.append(None if before is None else digest(raw[before:z]) - (1 << 63))
                        before = x
                    d.append(own[kept].view(np.int64))
                    count.append(len(kept))
                doc = pa.array(np.repeat(np.arange(b.num_rows), count))
                yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(2).take(doc), pa.array(start, pa.int32()), pa.array(length, pa.int32()),
                                                  pa.array(np.concatenate(d) if d else np.zeros(0, np.int64)), pa.array(link, pa.int64())],
                                                 names=["doc_id", "t", "start", "length", "d", "link"])

    return written(_keyed(docs).mapInArrow(rows, "doc_id long, t long, start int, length int, d long, link long"), "chunks")


RUNS = pa.schema([("run", pa.string()), ("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_chunks", pa.int64()),
                  ("first", pa.int64()), ("f_t", pa.int64()), ("f_from", pa.int32()), ("f_to", pa.int32())])


def runs_of(hits: DataFrame) -> DataFrame:
    """``RUNS``: the repeated anchors ``hits (doc_id, t, start, length, link, f)`` of each text in runs."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple]:
            open_, last, n = None, None, 0
            for b in it:
                for doc, t, start, length, link, f_id, f_t, f_start, f_link in zip(*(c.to_pylist() for c in b.columns)):
                    if (doc, t, start) == last:
                        continue  # a row that is repeated brings each of its anchors again
                    same = last is not None and (doc, t) == last[:2]
                    last = doc, t, start
                    linked = same and open_[5:7] == [f_id, f_t] and (start <= open_[3] or link == f_link is not None and start - f_start == open_[3] - open_[8])
                    if linked:
                        open_[3], open_[4], open_[8] = start + length, open_[4] + 1, f_start + length
                        continue
                    if open_:
                        yield closed(open_, n)
                    n = n + 1 if same else 0
                    open_ = [doc, t, start, start + length, 1, f_id, f_t, f_start, f_start + length]
            if open_:
                yield closed(open_, n)

        def closed(r: list, n: int) -> tuple:
            return f"{r[0]}:{r[1]}:{n}", *r

        yield from batches(runs(), RUNS)

    flat = hits.select("doc_id", "t", "start", "length", "link", "f.doc_id", "f.t", "f.start", "f.link").toDF(
        "doc_id", "t", "start", "length", "link", "f_id", "f_t", "f_start", "f_link")
    return flat.repartition("doc_id", "t").sortWithinPartitions("doc_id", "t", "start").mapInArrow(
        rows, "run string, doc_id long, t long, start int, end int, n_chunks long, first long, f_t long, f_from int, f_to int")


def _keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("t"))


def packed_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle to their run ends: it moves whole texts, so their bytes decide what it costs."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for b in it:
        packed = [pack.compress(x) for x in text_bytes(b)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], names=["doc_id", "t", "packed"])


def bytes_around(it: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """For rows ``doc_id, t, packed, at, side`` a row a place: the ``wide`` bytes before it (side 0) or from it on."""
    import zstandard

    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("at", pa.int32()), ("side", pa.int32()), ("raw", pa.binary())])

    def rows() -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()
        for b in it:
            for i in range(b.num_rows):
                doc, t, raw = b.column(0)[i].as_py(), b.column(1)[i].as_py(), unpack.decompress(b.column(2)[i].as_py())
                for at, side in zip(b.column(3)[i].as_py(), b.column(4)[i].as_py()):
                    yield doc, t, at, side, raw[max(at - wide, 0):at] if side == 0 else raw[at:at + wide]

    yield from batches(rows(), schema, max(64, (4 << 20) // wide))


def matched(it: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """For rows ``run, side, own, other``: how many of the bytes next to the end agree, cut between characters, and whether
    there may be more."""
    for b in it:
        own, other = b.column(2).to_pylist(), b.column(3).to_pylist()
        out, more = [], []
        for side, x, y in zip(b.column(1).to_pylist(), own, other):
            if side == 0:  # to the left: from the last byte
                n = _common(x[::-1], y[::-1])
            else:
                n = _common(x, y)
            go_on = n >= reach
            n = min(n, reach)
            if side == 0:
                while n and x[len(x) - n] & 0xC0 == 0x80:
                    n -= 1
            else:
                while n and n < len(x) and x[n] & 0xC0 == 0x80:
                    n -= 1
            out.append(n)
            more.append(go_on and n > 0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32()), pa.array(more, pa.bool_())], names=["run", "side", "n", "more"])


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


def extensions(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """``run, side, n``: by how many bytes each of ``ends (run, side, doc_id, t, at, f_id, f_t, f_at)`` can move outwards
    (side 0: to the left) while the text has the bytes that (f_id, f_t) has at f_at."""
    keyed = _keyed(docs).mapInArrow(packed_texts, "doc_id long, t long, packed binary")
    rounds, reach = [], REACH
    while True:
        own = ends.select("doc_id", "t", "at", "side")
        places = own.union(ends.select("f_id", "f_t", "f_at", "side")).distinct()
        places = places.groupBy("doc_id", "t").agg(F.collect_list("at").alias("at"), F.collect_list("side").alias("side"))  # bounded by a text's length
        wide = reach + 4  # the bytes beyond the reach show whether a character ends there
        found = keyed.join(places.hint("merge"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
        bytes_at = written(found.select("doc_id", "t", "packed", "at", "side").mapInArrow(
            partial(bytes_around, wide=wide), "doc_id long, t long, at int, side int, raw binary"), "span-bytes")
        other = bytes_at.select(F.col("doc_id").alias("f_id"), F.col("t").alias("f_t"), F.col("at").alias("f_at"), "side", F.col("raw").alias("other"))
        pairs = ends.join(bytes_at.withColumnRenamed("raw", "own").hint("merge"), ["doc_id", "t", "at", "side"]).join(other.hint("merge"), ["f_id", "f_t", "f_at", "side"])
        got = written(pairs.select("run", "side", "own", "other").mapInArrow(partial(matched, reach=reach), "run string, side int, n int, more boolean"), "span-ends")
        discard(bytes_at)
        rounds.append(got.select("run", "side", "n"))
        if got.where("more").limit(1).count() == 0:
            break
        reach *= 64  # few rounds, however long the texts
        step = F.when(F.col("side") == 0, -F.col("n")).otherwise(F.col("n"))
        ends = written(ends.join(got.where("more").select("run", "side", "n").hint("merge"), ["run", "side"]).select(
            "run", "side", "doc_id", "t", (F.col("at") + step).alias("at"), "f_id", "f_t", (F.col("f_at") + step).alias("f_at")), "span-ends")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out.groupBy("run", "side").agg(F.sum("n").cast("int").alias("n"))


def duplicate_spans(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, t, start, length, n_chunks, first_doc_ids``: runs of anchors that documents of smaller id have, extended
    by the bytes that agree around them."""
    all_chunks = chunks(docs)
    first = all_chunks.groupBy("d").agg(F.min(F.struct("doc_id", "t", "start", "link")).alias("f"), F.max("doc_id").alias("last"))
    first = written(first.where("f.doc_id < last").select("d", "f"), "chunk-firsts")
    # digests grow with the texts: sorted and merged at every size, hot ones split by AQE
    hits = all_chunks.join(first.hint("merge"), "d").where("doc_id > f.doc_id")
    runs = written(runs_of(hits), "span-runs")
    discard(all_chunks)
    edge = lambda side, at, f_at: runs.select("run", F.lit(side).alias("side"), "doc_id", "t", F.col(at).alias("at"), F.col("first").alias("f_id"), "f_t",
                                              F.col(f_at).alias("f_at"))
    ends = edge(0, "start", "f_from").union(edge(1, "end", "f_to"))
    moved = extensions(docs, ends).groupBy("run").agg(*[F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)).cast("int").alias(c) for i, c in ((0, "by_l"), (1, "by_r"))])
    by_doc = runs.join(moved.hint("merge"), "run").groupBy("doc_id", "t").agg(F.collect_list(F.struct(
        "first", "start", "end", (F.col("start") - F.col("by_l")).alias("from"), (F.col("end") + F.col("by_r")).alias("to"), "n_chunks")).alias("runs"))

    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [(d, t, *span) for d, t, r in zip(*(c.to_pylist() for c in b.columns)) for span in chosen([tuple(x.values()) for x in r], min_run)]
            yield _batch(out, schema) if out else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("n_chunks", pa.int64()), ("first_doc_ids", pa.list_(pa.int64()))])
    spans = by_doc.mapInArrow(choose, "doc_id long, t long, start long, length int, n_chunks long, first_doc_ids array<long>")
    return spans.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def chosen(runs: list[tuple], min_run: int) -> list[tuple[int, int, int, list[int]]]:
    """``start, length, n_chunks, first_doc_ids`` of one document's spans from its ``runs (first, start, end, from, to, n_chunks)``."""
    held: list[list] = []  # disjoint spans [from, to, n_chunks, firsts], ascending
    left: list[tuple] = []

    def touched(a: int, z: int) -> tuple[int, int]:
        """Which held spans [a, z) meets or touches."""
        lo = bisect_left(held, a, key=lambda h: h[1])
        hi = lo
        while hi < len(held) and held[hi][0] <= z:
            hi += 1
        return lo, hi

    def hold(a: int, z: int, n: int, firsts: set) -> None:
        lo, hi = touched(a, z)
        old = held[lo:hi]
        held[lo:hi] = [[min([a, *(h[0] for h in old)]), max([z, *(h[1] for h in old)]), n + sum(h[2] for h in old), firsts.union(*(h[3] for h in old))]]

    for first, ours in groupby(sorted(runs), key=lambda r: r[0]):
        for r in ours:
            if r[4] - r[3] >= min_run:
                hold(r[3], r[4], r[5], {first})
            else:
                left.append(r)
    joined: list[list] = []
    for first, a, z, lo, hi, n in sorted(left, key=lambda r: r[3]):
        at, upto = touched(a, z)
        if any(h[0] < z and a < h[1] for h in held[at:upto]):
            continue
        if joined and lo <= joined[-1][1]:
            joined[-1] = [joined[-1][0], max(hi, joined[-1][1]), joined[-1][2] + n, joined[-1][3] | {first}]
        else:
            joined.append([lo, hi, n, {first}])
    for a, z, n, firsts in joined:
        if z - a >= min_run:
            hold(a, z, n, firsts)
    return [(a, z - a, n, sorted(firsts)) for a, z, n, firsts in held]


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the bytes of ``spans``; a document left empty keeps its row."""
    by_doc = spans.groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    text = F.col("text").cast("string")
    joined = docs.join(by_doc, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__t")), "left")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for t, spans_ in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if spans_:
                    raw, kept, at = t.encode(), [], 0
                    for s in spans_:
                        kept.append(raw[at:s["start"]])
                        at = s["start"] + s["length"]
                    t = b"".join([*kept, raw[at:]]).decode()
                out.append(t)
            i = b.schema.get_field_index("text")
            cols = [pa.array(out, pa.string()) if k == i else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "__spans").mapInArrow(cut, joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]).schema)

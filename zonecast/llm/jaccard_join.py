"""Operator 5: n-gram Jaccard join with a token-group matrix, exact at its threshold.

Each text's set is its distinct w-word shingles (64-bit hashes).  Two sets link when
``100 * intersection >= percent * union``.

1. Tokens of the matrix: a size class cuts the universe of shingles into K hash buckets, K above the largest
   symmetric difference that two linked sets of the class can have.  So linked sets agree on a
   whole bucket (pigeonhole); the hash of a bucket's shingles is a matrix token.  A
   set has tokens in its own class and, if a smaller partner may lie there, in the class below.
2. Equal sets collapse to one class.  Sets that share a token with the least set of that token are
   compared with it; the components of these links are the groups of similar documents.
3. Each group stores the union of its members' matrix tokens (one row per token and group) and of their
   shingles (a bit map, and one of what all members share).  A query group and a group that share a
   token qualify if the bit maps leave room for the overlap that a link needs; only qualifying
   groups are opened and their members compared.
4. Components of all links, least document id each.

No pair of a group is listed: copies meet as one class, near copies through the least set, and
blocks of a crowded token are compared in tasks of at most 2 * ``BLOCK`` groups.  Shingles are
kept only for sets that share a token.

Defined cases: NULL or wordless texts have no shingles and link with nothing; fewer words than w
make one shingle; NULL ids get the component of their set's non-NULL ids (NULL if it has none) and
repeated rows are members like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import discard, documents, text_bytes, written
from zonecast.llm.components import components

#: Bits of a group's shingle map, groups in a block of a crowded token, members compared at once.
MAP_BITS, BLOCK, MEMBERS = 2048, 256, 512
BROADCAST_ROWS = 2_000_000
#: Shingles of a table from which on its tokens and its sets are matched a band at a time, and the number of bands: one band's shuffle lies on the disks at once.
BAND_SHINGLES, BANDS = 30_000_000, 4

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambling (the finalizer of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * _M2
    x = (x ^ x >> np.uint64(27)) * _M3
    return x ^ x >> np.uint64(31)


# ---- shingles and matrix tokens


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


_WORDS = _Words()


def shingles(text: bytes, w: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - w + 1, 1)
    out = np.full(n, min(len(h), w), np.uint64)
    for k in range(min(w, len(h))):
        out = mix64(out * _M1 + h[k:k + n])
    return np.unique(out)


@lru_cache(maxsize=None)
def class_bounds(percent: int) -> tuple[int, ...]:
    """Upper sizes of the size classes: linked sets lie in one class or in neighbours."""
    out, low = [], 1
    while low < 1 << 40:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return tuple(out)


@lru_cache(maxsize=None)
def class_buckets(c: int, percent: int) -> tuple[int, int]:
    """Buckets of a class, and the largest symmetric difference of two sets that link and of which
    the smaller has a size of the class.  An eighth more buckets than needed leaves some free to be empty."""
    top = class_bounds(percent)[c]
    both = top + top * 100 // percent
    apart = (100 - percent) * both // (100 + percent)
    return apart + 1 + (1 + apart // 8 if apart else 0), apart


def matrix_tokens(s: np.ndarray, percent: int) -> np.ndarray:
    """The matrix tokens of a shingle set."""
    bounds = class_bounds(percent)
    c = int(np.searchsorted(bounds, len(s)))
    classes = [c] if c == 0 or len(s) * percent > 100 * bounds[c - 1] else [c, c - 1]
    out = []
    mixed = mix64(s + _M1)
    for k in classes:
        buckets, apart = class_buckets(k, percent)
        at = (mix64(s ^ _seed(k)) >> np.uint64(32)).astype(np.int64) * buckets >> 32
        sums = np.zeros(buckets, np.uint64)
        np.add.at(sums, at, mixed)
        token = mix64(sums * _M1 + np.arange(buckets, dtype=np.uint64) ^ _seed(k))
        filled = np.bincount(at, minlength=buckets) > 0
        # more filled buckets than can differ: a linked set agrees on one of them, else it may agree on empty ones only
        out.append(token[filled] if filled.sum() > apart else token)
    return np.concatenate(out)


def _seed(k: int) -> np.uint64:
    return np.uint64((k + 1) * int(_M1) % (1 << 64))


def set_hash(s: np.ndarray) -> int:
    """A 64-bit identity of a set."""
    total = mix64(s + _M2).sum(dtype=np.uint64, keepdims=True) ^ _seed(len(s))
    return int(mix64(total).view(np.int64)[0])


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = shared_count(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def bit_map(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(MAP_BITS, bool)
    bits[(mix64(s * _M3) & np.uint64(MAP_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits)


# ---- Spark stages


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, w: int, percent: int) -> DataFrame:
    """``doc_id, n, f (set identity; NULL without shingles), tokens`` of every document."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                sets = [shingles(t, w) for t in text_bytes(b)]
                tokens = [_signed(matrix_tokens(s, percent)) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n", "f", "tokens"])

    out = documents(docs).mapInArrow(rows, "doc_id long, n long, f long, tokens array<long>")
    return written(out, "jaccard-signatures")


def _narrow(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is in ``keys``: a checked broadcast, else a shuffle join."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def shingle_sets(docs: DataFrame, wanted: DataFrame, w: int) -> DataFrame:
    """``f, s``: the shingles of the sets in ``wanted (f, doc_id)``, read anew from one text each."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                sets = [shingles(t, w) for t in text_bytes(b)]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], names=["f", "s"])

    ids = wanted.select(F.col("doc_id").alias("w_id")).distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = documents(docs)
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    found = texts.mapInArrow(rows, "f long, s binary").where(F.col("f").isNotNull())
    # repeated ids or rows may bring a set more than once
    return written(found.groupBy("f").agg(F.first("s").alias("s")), "jaccard-sets")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of set identities that link."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = _sets_of(pairs, sets, "a").withColumnRenamed("s", "sa")
    right = _sets_of(pairs, sets, "b").withColumnRenamed("s", "sb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def _sets_of(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """The sets that stand on one side of ``pairs``: the others need not be shuffled to meet them."""
    return _narrow(sets.select(F.col("f").alias(side), "s"), pairs.select(side).distinct(), side)


def group_unions(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, least, most, held, every``: sizes of the smallest and largest member, and the bit maps of the
    members' union and of what all of them share."""

    def maps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in s], pa.int64()),
                                              pa.array([bit_map(x).view("<i8") for x in s], pa.list_(pa.int64()))], names=["label", "n", "bits"])

    words = MAP_BITS // 64
    rows = sets.join(labels, "f", "left").select(F.coalesce("label", "f").alias("label"), "s").mapInArrow(maps, "label long, n long, bits array<long>")
    maps_ = [f(F.col("bits")[i]).alias(f"{k}{i}") for k, f in (("o", F.bit_or), ("a", F.bit_and)) for i in range(words)]
    return (rows.groupBy("label").agg(F.min("n").alias("least"), F.max("n").alias("most"), *maps_)
            .select("label", "least", "most", *[F.array(*[f"{k}{i}" for i in range(words)]).alias(c) for k, c in (("o", "held"), ("a", "every"))]))


def qualifying(cells: DataFrame, unions: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups ``(a, b)`` that share a matrix token and whose unions leave room for a link.

    ``cells (token, label)``: tokens that several groups hold.  A token with more than BLOCK groups is
    dealt out in pairs of blocks."""
    size = cells.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int")
    rows = cells.join(size, "token").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label").join(unions, "label")
    groups = rows.groupBy("token", "i", "j").agg(F.collect_list(F.struct("own", "label", "least", "most", "held", "every")).alias("g"))

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seen: set[tuple[int, int]] = set()
            for i, j, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                v = g.values
                own, label, least, most = (v.field(k).to_numpy(zero_copy_only=False) for k in ("own", "label", "least", "most"))
                held, every = (v.field(k).flatten().to_numpy().view(np.uint64).reshape(len(label), -1) for k in ("held", "every"))
                seen.update(_room(own, label, least, most, held, every, i, j, percent))
            if seen:
                a, z = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return groups.select("i", "j", "g").mapInArrow(pairs, "a long, b long").distinct()


def _room(own, label, least, most, held, every, i, j, percent) -> Iterator[tuple[int, int]]:
    """Pairs of labels that a link may join.  A bit that all members of one group set and no member of the
    other is a shingle that two of their members cannot share; sets a and b that link differ in at
    most (100 - percent) / (100 + percent) * (|a| + |b|) shingles."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for x in left:
        y = right[label[right] > label[x]] if i == j else right
        y = y[100 * np.minimum(most[x], most[y]) >= percent * np.maximum(least[x], least[y])]
        if not len(y):
            continue
        apart = np.bitwise_count(every[x] & ~held[y]).sum(1).astype(np.int64) + np.bitwise_count(every[y] & ~held[x]).sum(1)
        for z in label[y[(100 + percent) * apart <= (100 - percent) * (most[x] + most[y])]]:
            yield (int(label[x]), int(z)) if label[x] < z else (int(z), int(label[x]))


def opened(pairs: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The pairs of groups that a link joins: members of the smaller group are queries to blocks of
    the larger one, opened where its union holds enough of the query."""
    # a root is no vertex of ``labels`` and has its own label; sets of groups in no pair are not shuffled
    wanted = pairs.select(F.col("a").alias("label")).union(pairs.select(F.col("b").alias("label"))).distinct()
    of = labels.select("f", "label").join(wanted, "label", "left_semi").select("f", "label").union(wanted.select(F.col("label").alias("f"), "label"))
    of = written(of, "jaccard-wanted")
    few = of.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    members = sets.join(F.broadcast(of) if few else of, "f").select("label", "s", F.xxhash64("f").alias("h"))
    count = members.groupBy("label").agg(F.count("*").alias("m"))
    ca = count.select(F.col("label").alias("a"), F.col("m").alias("ma"))
    cb = count.select(F.col("label").alias("b"), F.col("m").alias("mb"))
    sized = pairs.join(ca, "a").join(cb, "b")
    larger = F.col("ma") >= F.col("mb")
    turned = sized.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("g"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("q"),
                          F.greatest("ma", "mb").alias("m"), F.least("ma", "mb").alias("mq"))
    blocks = turned.groupBy("g").agg(F.ceil(F.max("m") / MEMBERS).cast("int").alias("blocks"), F.ceil(F.sum("mq") / MEMBERS).cast("int").alias("parts"))
    blocks = written(blocks, "jaccard-blocks")
    queries = (turned.select("g", "q").join(members.withColumnRenamed("label", "q"), "q").join(blocks, "g")
               .withColumn("part", F.pmod("h", "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("g", "block", "part", "q", "s"))
    held = (members.withColumnRenamed("label", "g").join(blocks, "g").withColumn("block", F.pmod("h", "blocks").cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "block", "part", F.lit(None).cast("long").alias("q"), "s"))
    both = queries.union(held).groupBy("g", "block", "part").agg(F.collect_list(F.struct("q", "s")).alias("rows"))

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [(g, q) for g, rows in zip(b.column(0).to_pylist(), b.column(1)) for q in _hits(rows.as_py(), percent)]
            if out:
                a, z = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return both.select("g", "rows").mapInArrow(links, "a long, b long").distinct()


def _hits(rows: list[dict], percent: int) -> set[int]:
    """The query groups of which a member links with one of the block's members."""
    block = [np.frombuffer(r["s"], np.uint64) for r in rows if r["q"] is None]
    union = np.unique(np.concatenate(block)) if block else np.zeros(0, np.uint64)
    hit: set[int] = set()
    for r in rows:
        if r["q"] is None or r["q"] in hit:
            continue
        s = np.frombuffer(r["s"], np.uint64)
        if 100 * shared_count(s, union) >= percent * len(s) and any(linked(s, m, percent) for m in block):
            hit.add(r["q"])
    return hit


def jaccard_components(docs: DataFrame, w: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``; component: least id reachable by links."""
    sig = signatures(docs, w, percent)
    meta = written(sig.select("doc_id", "n", "f"), "jaccard-meta")
    # 1. one document a set; tokens that two sets or more hold
    rows = _first_of_each(sig, meta).select("f", F.explode("tokens").alias("token"))
    bands = BANDS if (meta.agg(F.sum("n")).first()[0] or 0) > BAND_SHINGLES else 1
    parts = [_cells(_band(rows, "token", i, bands)) for i in range(bands)]
    cells = reduce(DataFrame.union, parts)
    discard(sig)
    # 2. groups of similar sets: those that link with the least set of a token they hold
    lead = cells.groupBy("token").agg(F.min("f").alias("a"), F.max("f").alias("hi")).where("a < hi").select("token", "a")
    lead = written(cells.join(lead, "token").select("a", F.col("f").alias("b")).distinct(), "jaccard-leads")
    involved = lead.select(F.col("b").alias("f")).distinct()  # a set leads only where it is a member too
    some = written(_narrow(meta.select("f", "doc_id"), involved, "f").groupBy("f").agg(F.min("doc_id").alias("doc_id")), "jaccard-involved")
    full = shingle_sets(docs, some, w)
    stars = [written(compare(_band(lead.where("a <> b"), "a", i, bands), full, percent), "jaccard-stars") for i in range(bands)]
    first = reduce(DataFrame.union, stars)
    discard(lead, some)
    labels = components(first).select(F.col("v").alias("f"), F.col("root").alias("label"))
    # 3. tokens that several groups hold; open the groups that qualify
    named = _labelled(cells.select("token", "f"), labels).select("token", "label").distinct()
    several = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    open_cells = written(named.join(several, "token", "left_semi"), "jaccard-open-cells")
    discard(*parts)
    pairs = written(qualifying(open_cells, group_unions(full, labels), percent), "jaccard-pairs")
    second = opened(pairs, full, labels, percent)
    # 4. components of all links
    root = components(first.union(second)).select(F.col("v").alias("f"), "root")
    discard(full, open_cells, pairs, *stars)
    rooted = meta.join(root, "f", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "f").alias("root"))
    least = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rooted.join(least, "root", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _first_of_each(sig: DataFrame, meta: DataFrame) -> DataFrame:
    """The rows of ``sig`` with shingles, of equal sets only those of the least document id."""
    first = (meta.where(F.col("f").isNotNull()).groupBy("f").agg(F.min("doc_id").alias("first"), F.count("*").alias("m"))
             .where("m > 1").select(F.col("f").alias("g"), "first"))
    few = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = sig.where(F.col("f").isNotNull()).join(F.broadcast(first) if few else first, F.col("f") == F.col("g"), "left")
    return marked.where(F.col("g").isNull() | F.col("doc_id").eqNullSafe(F.col("first")))


def _band(rows: DataFrame, key: str, i: int, bands: int) -> DataFrame:
    return rows.where(F.pmod(key, F.lit(bands)) == i) if bands > 1 else rows


def _cells(rows: DataFrame) -> DataFrame:
    """The distinct ``token, f`` of ``rows`` whose token two rows or more hold."""
    shared = written(rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "jaccard-shared")
    cells = written(_match(rows, shared).distinct(), "jaccard-cells")
    discard(shared)
    return cells


def _match(rows: DataFrame, shared: DataFrame) -> DataFrame:
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(shared) if few else shared, "token").select("token", "f")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    few = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(labels) if few else labels, "f", "left").withColumn("label", F.coalesce("label", "f"))


def keep_one(docs: DataFrame, w: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that link, directly or through others, with a row of smaller
    id; of rows with one id one stays.  Rows with a NULL id stay."""
    found = written(jaccard_components(docs, w, percent), "jaccard-components")
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__lost")).distinct()
    few = lost.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(lost) if few else lost, F.col("doc_id").cast("long") == F.col("__lost"), "left_anti")
    again = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return left
    many = F.col("doc_id").cast("long") == F.col("__again")
    return left.join(again, many, "left_anti").unionByName(left.join(again, many, "left_semi").dropDuplicates(["doc_id"]))


def oracle_sql(table: str = "documents", w: int = 4, percent: int = 85) -> str:
    """The same components in DuckDB SQL."""
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS v FROM {table}),
s AS (SELECT doc_id, CASE WHEN len(v) = 0 THEN [] WHEN len(v) < {w} THEN [array_to_string(v, ' ')]
             ELSE list_distinct(list_transform(range(1, len(v) - {w} + 2), lambda i: array_to_string(v[i:i + {w - 1}], ' '))) END AS g FROM t),
r AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT s.doc_id, len(s.g) AS n_shingles, least(s.doc_id, coalesce(min(c.b), s.doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = s.doc_id GROUP BY s.doc_id, len(s.g)"""

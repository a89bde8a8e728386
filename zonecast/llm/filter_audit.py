"""Operator 11: what each quality filter removes, in every order, and its Shapley share.

Every document gets a mask of the filters it fails, so all that the audit needs is, per part (source) and mask, the
number of documents and of good and toxic ones: at most 32 rows a part.  A coalition S of filters removes the documents
whose mask meets S.  The Hart-Mas-Colell potential of that game is computed by recursion over the 32 coalitions,
``P(S) = (v(S) + sum of P(S without i)) / |S|``, scaled by 5! so that it stays an integer; a filter's Shapley value,
summed over the 120 orders, is the grand potential less the potential without that filter.  The steps of an order are
differences of two coalitions.

* Texts are read once; 40 bytes a document shuffle after that, counted per (document, text, part, mask) before.
* Copies: a text digest's smallest id is an aggregate with map-side combine, joined back on (digest, id), so a text
  that a third of all documents have is no hot key.
* Parts are rows, not columns: their number has no bound.

Defined cases: a NULL text is empty, a NULL source the part ''; a NULL id is neither smaller nor greater than another,
so it neither makes copies nor is one, and has no label; repeated rows count as often as they occur, and rows of one id
are no copies of each other; a document is good (toxic) if any of its label rows says so; texts equal in 128 bits of
xxh3 count as identical; an empty table has no parts; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import documents, portions, text_bytes, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
CAPITALS, CONTINUATION = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0x80, 0xC0))
#: Bytes of a text whose words are held at once.
PIECE = 4 << 20
COUNTS = ("docs", "good", "toxic")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_counts(raw: bytes) -> tuple[int, int]:
    """The words of a text and the distinct ones, a few megabytes at a time."""
    if len(raw) <= PIECE:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + PIECE)
        upto = cut.end() if cut else len(raw)
        words = raw[at:upto].split()
        n, at = n + len(words), upto
        seen.update(words)
    return n, len(seen)


def text_mask(raw: bytes) -> int:
    """The bits of the filters A to D that the text fails."""
    n, distinct = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    code_points = len(raw.translate(None, CONTINUATION))
    return ((n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PERCENT * n) << 1 | (100 * capitals > MAX_CAPITALS_PERCENT * code_points) << 2
            | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, d1, d2, n``: the text filters that documents fail, their texts' digests, and the number of
    such rows."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in portions(it):
            texts = text_bytes(b)
            digest = np.frombuffer(b"".join(map(xxh3_128_digest, texts)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(map(text_mask, texts)), pa.int32()),
                                              pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1]))],
                                             names=["doc_id", "part", "mask", "d1", "d2"])

    named = documents(docs.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit(""))), "source")
    out = named.mapInArrow(rows, "doc_id long, part string, mask int, d1 long, d2 long")
    return out.groupBy("doc_id", "part", "mask", "d1", "d2").agg(F.count("*").alias("n"))


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` of ``failures`` with the copy filter's bit (E) in the mask."""
    first = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["d1", "d2", "doc_id"], "left").withColumn("mask", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask"))).drop("first")


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, docs, good, toxic`` of ``rows (doc_id, part, mask, n)``; at most one row a label id is joined."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    known = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return (rows.join(by_id.where("quality or toxic"), "doc_id", "left").groupBy("part", "mask")
            .agg(F.sum("n").alias("docs"), known("quality").alias("good"), known("toxic").alias("toxic")))


def potentials(removed: np.ndarray, k: int) -> np.ndarray:
    """k! times the Hart-Mas-Colell potential of each coalition (column) of the games in ``removed (games, 2^k)``."""
    out = np.zeros_like(removed)
    for s in range(1, 1 << k):  # every coalition after its parts
        members = [i for i in range(k) if s >> i & 1]
        out[:, s] = (factorial(k) * removed[:, s] + sum(out[:, s ^ 1 << i] for i in members)) // len(members)
    return out


def steps(counts: np.ndarray, k: int = len(FILTERS)) -> dict[str, np.ndarray]:
    """The audit's columns, each ``(games, orders * k)``, of ``counts (3, games, 2^k)``: documents, good and toxic ones by mask."""
    masks = np.arange(1 << k)
    meets = (masks[:, None] & masks != 0).astype(np.int64)
    removed, good, toxic = (c @ meets for c in counts)  # by coalition
    orders = list(permutations(range(k)))
    own = np.array(orders).ravel()
    before = np.array([sum(1 << i for i in o[:n]) for o in orders for n in range(k)])
    after, alone = before | 1 << own, 1 << own
    value = potentials(removed, k)
    gone = removed[:, after] - removed[:, before]
    return {"kept": counts[0].sum(axis=1, keepdims=True) - removed[:, after], "removed": gone, "redundant": removed[:, alone] - gone,
            "unique_fails": counts[0][:, alone], "good_lost": good[:, after] - good[:, before], "toxic_lost": toxic[:, after] - toxic[:, before],
            "shapley": value[:, -1:] - value[:, (1 << k) - 1 - alone]}


def audit(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of
    ``counts (part, mask, docs, good, toxic)``: one row per part, order and step."""
    k = len(letters)
    wide = counts.groupBy("part").agg(*[F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(1 << k)]).alias(c) for c in COUNTS])
    orders = ["".join(o) for o in permutations(letters)]
    named = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.repeat(orders, k).tolist()
        for big in it:
            for lo in range(0, big.num_rows, 200):
                b = big.slice(lo, 200)
                n = b.num_rows
                out = steps(np.stack([c.flatten().to_numpy().reshape(n, 1 << k) for c in b.columns[1:]]), k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(n), len(order)))), pa.array(order * n),
                                                  pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * n)),
                                                  *[pa.array(np.broadcast_to(out[c], (n, len(order))).ravel()) for c in named]],
                                                 names=["part", "filter_order", "step", *named])

    return wide.mapInArrow(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in named))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` by source."""
    return audit(mask_counts(with_copies(written(failures(docs), "audit-rows")), labels))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL; the Shapley column sums what each order removes."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
lab AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
      FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY ALL),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31
      AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, step, f.l, f.b AS own, coalesce((SELECT sum(g.b) FROM f g WHERE position(g.l IN filter_order) < step), 0) AS prior
      FROM o, range(1, 6) r(step), f WHERE f.l = filter_order[step]),
z AS (SELECT part, filter_order, step::INT AS step, l,
             sum(n) FILTER (WHERE mask & (prior | own)::INT = 0) AS kept,
             sum(n) FILTER (WHERE mask & own <> 0 AND mask & prior::INT = 0) AS removed,
             sum(n) FILTER (WHERE mask & own <> 0 AND mask & prior::INT <> 0) AS redundant,
             sum(n) FILTER (WHERE mask = own) AS unique_fails,
             sum(g) FILTER (WHERE mask & own <> 0 AND mask & prior::INT = 0) AS good_lost,
             sum(x) FILTER (WHERE mask & own <> 0 AND mask & prior::INT = 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, l)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, l), 0)::BIGINT AS shapley
FROM z"""

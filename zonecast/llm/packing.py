"""Operator 1: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens.  In every round each queue is granted its share
of ``WINDOW`` tokens (target proportion times window); it serves the whole tokens of its credit and
carries the fraction, its deficit, to the next round.  A drained queue grants its place to the
others.  The rounds form one token stream that is cut into windows of ``WINDOW`` tokens, so
every window is full but the last and holds the targets within the deficits carried.

The state of the scheduler after r rounds has a closed form: queue s has served
``min(tokens_s, floor(weight_s * WINDOW * r / UNIT))``.  So each task computes the deficits that its documents begin with
instead of replaying the rounds before, and windows need no sequential pass.

* Texts are encoded once and written; only counts a (segment, source) are shuffled.
* A segment is what one task encoded: a queue's place of a document is the source's tokens in earlier segments plus those before it
  in its own.  A source with a third of all rows is spread over all segments.

Defined cases: a NULL text is the end id alone; a NULL source is a queue of its own; repeated rows
are packed as often as they occur; NULL ids are carried through; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonecast.llm.common import documents, written
from zonecast.llm.tokens import CACHE, encoder, forget

WINDOW = 4096
#: Weights are integers that add up to about UNIT; 2^16 keeps credits exact below 10^13 tokens.
UNIT = 1 << 16
#: A window cannot hold a token of more sources than it has tokens.
MAX_SOURCES = WINDOW
BROADCAST_ROWS = 1_000_000

TOKENS = "seg long, doc_id long, queue string, n long, before long, width int, ids binary"
PIECES = "doc_id long, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """Each document's ids (with the end id), its task's number and the tokens of its queue before it there."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(it)
        finally:
            if not keep:
                forget()

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, seg = encoder(tokenizer, cache), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        narrow = enc.tok.get_vocab_size() <= 1 << 16
        held: dict[str, int] = {}
        for big in it:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                ids = [enc.ids(t) + end for t in b.column(1).to_pylist()]
                n = [len(x) // 4 for x in ids]
                queues, before = b.column(2).to_pylist(), []
                for q, k in zip(queues, n):
                    before.append(held.get(q, 0))
                    held[q] = before[-1] + k
                if narrow:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array([seg] * len(n), pa.int64()), b.column(0), b.column(2), pa.array(n, pa.int64()),
                                                  pa.array(before, pa.int64()), pa.array([2 if narrow else 4] * len(n), pa.int32()),
                                                  pa.array(ids, pa.binary())], names=["seg", "doc_id", "queue", "n", "before", "width", "ids"])

    queue = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("queue")
    return written(documents(docs, "source").select("doc_id", "text", queue).mapInArrow(rows, TOKENS), "pack-tokens")


class Rounds:
    """The scheduler's closed form: ``tokens`` and integer ``weights`` by queue, in serving order."""

    def __init__(self, tokens: list[int], weights: list[int]):
        self.tokens, self.weights = np.array(tokens, np.int64), np.array(weights, np.int64)

    def served(self, rounds: np.ndarray, queue: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tokens of a queue served before a round."""
        return np.minimum(self.tokens[queue], self.weights[queue] * WINDOW * rounds // UNIT)

    def round_of(self, token: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """The round that serves a queue's token."""
        grant = self.weights[queue] * WINDOW
        return (UNIT * (token + 1) + grant - 1) // grant - 1

    def place(self, rounds: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Where in the stream a queue's share of a round begins."""
        out = np.empty(len(rounds), np.int64)
        known, back = np.unique(rounds, return_inverse=True)
        step = max(1, 2_000_000 // max(len(self.tokens), 1))
        for lo in range(0, len(known), step):
            r = known[lo:lo + step, None]
            now, then = self.served(r), self.served(r + 1)
            part = then - now
            begins = now.sum(1, keepdims=True) + np.cumsum(part, 1) - part
            mine = np.flatnonzero((back >= lo) & (back < lo + step))
            out[mine] = begins[back[mine] - lo, queue[mine]]
        return out


def pieces_of(rounds: Rounds, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces of documents that take ``n`` tokens from ``first`` on of their queues:
    document number, start in it, length, window and offset there."""
    a, z = rounds.round_of(first, queue), rounds.round_of(first + n - 1, queue)
    doc = np.repeat(np.arange(len(n)), z - a + 1)
    r = np.arange(len(doc)) - np.repeat(np.cumsum(z - a + 1) - (z - a + 1), z - a + 1) + a[doc]
    q = queue[doc]
    opens = rounds.served(r, q)
    lo, hi = np.maximum(first[doc], opens), np.minimum((first + n)[doc], rounds.served(r + 1, q))
    at = rounds.place(r, q) + lo - opens
    some = hi > lo
    doc, lo, hi, at = doc[some], lo[some], hi[some], at[some]
    cuts = (at + hi - lo - 1) // WINDOW - at // WINDOW + 1  # windows touched
    k = np.repeat(np.arange(len(doc)), cuts)
    w = np.arange(len(k)) - np.repeat(np.cumsum(cuts) - cuts, cuts) + (at // WINDOW)[k]
    begin, end = np.maximum(at[k], w * WINDOW), np.minimum((at + hi - lo)[k], (w + 1) * WINDOW)
    start = lo[k] + begin - at[k] - first[doc[k]]
    return doc[k], start, end - begin, w, begin - w * WINDOW


def integer_weights(totals: dict[str, int], targets: dict[str, float] | None) -> dict[str, int]:
    """Weights of about UNIT in all; by default each queue's own share, so that all drain together."""
    raw = {q: float(totals[q] if targets is None else targets.get(q, 0.0)) for q in totals}
    whole = sum(raw.values()) or 1.0
    return {q: max(1, round(v / whole * UNIT)) for q, v in raw.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, targets: dict[str, float] | None = None, cache: int = CACHE,
         keep: bool = True) -> DataFrame:
    """The pieces of all documents: ``doc_id, queue, start, length, doc_tokens, sequence_id, offset, ids``.

    ``targets``: proportion of each source in a window (default: its share of all tokens).  Sources
    that it does not name are served a sliver a round, so they are packed as well.  ``cache``: words that
    a worker keeps encoded, from task to task unless ``keep`` is False."""
    spark = docs.sparkSession
    tokens = encode(docs, tokenizer, end_id, cache, keep)
    sums = tokens.groupBy("queue", "seg").agg(F.sum("n").alias("n"))
    base = sums.select(F.col("queue").alias("q"), F.col("seg").alias("g"),
                       (F.sum("n").over(Window.partitionBy("queue").orderBy("seg")) - F.col("n")).alias("base"))
    base = written(base, "pack-offsets")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group small ones under one name first")
    names = sorted(totals)
    named = None if targets is None else {("" if s is None else f"s{s}"): w for s, w in targets.items()}
    weights = integer_weights(totals, named)
    shared = spark.sparkContext.broadcast((names, [totals[q] for q in names], [weights[q] for q in names]))
    schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, total, weight = shared.value
        rounds, number = Rounds(total, weight), {q: i for i, q in enumerate(order)}
        for big in it:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
                names_, n = col["queue"].to_pylist(), col["n"].to_numpy()
                queue = np.array([number[q] for q in names_], np.int64)
                first = col["base"].to_numpy() + col["before"].to_numpy()
                doc, start, length, window, offset = pieces_of(rounds, queue, first, n)
                wide = [x if w == 4 else np.frombuffer(x, "<u2").astype("<u4").tobytes()
                        for x, w in zip(col["ids"].to_pylist(), col["width"].to_pylist())]
                ids = [wide[d][4 * s:4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([col["doc_id"].take(pa.array(doc)), col["queue"].take(pa.array(doc)), pa.array(start), pa.array(length),
                                                  pa.array(n[doc]), pa.array(window), pa.array(offset), pa.array(ids, pa.binary())], schema=schema)

    few = base.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(base) if few else base, (F.col("queue") == F.col("q")) & (F.col("seg") == F.col("g")))
    return placed.select("doc_id", "queue", "n", "before", "base", "width", "ids").mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces: ``sequence_id, used, ids``; padded to WINDOW unless the used
    length is a power of two."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))  # at most WINDOW tokens a group
    got = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("used"))
    pad = pad_id.to_bytes(4, "little").hex()
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    power = F.expr("(used & (used - 1)) = 0")
    fill = F.unhex(F.repeat(F.lit(pad), F.when(power, F.lit(0)).otherwise(F.lit(WINDOW) - F.col("used")).cast("int")))
    return got.select("sequence_id", "used", F.concat(joined, fill).alias("ids"))

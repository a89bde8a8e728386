"""Operator 10: quality rules from a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over every document (raw corpus), one
over trusted documents (labelled good).  A document's score is the mean over its n-grams of
``log p_trusted / p_raw``; every document is kept or rejected by one fixed threshold.

* The ratio table has ``buckets`` fixed-point integers, so it is a bounded broadcast and a
  document's sum is exact: the verdict does not depend on partitioning.
* Trusted documents are a bounded sample of the labelled rows (``sample`` rows, lowest id hash
  first); the raw counts, scores and verdicts cover every document and every byte.
* The threshold is the score that best separates labelled good from labelled bad documents of that
  sample, counted in bins (``threshold`` fixes it instead).  Without bad or good labels every document passes.

Defined cases: a NULL or shorter text than n bytes has no n-gram and scores 0; NULL labels and
labels of unknown documents are ignored; a document labelled twice is trusted only if all its
labels are good; repeated rows get the same verdict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import portions, segment_sums, text_buffer, text_bytes

N_GRAM = 4
#: log2 of the number of hash buckets.
BUCKET_BITS = 16
#: Fixed-point unit of a log ratio, and width of a threshold bin.
UNIT, BIN = 1 << 20, 0.01
SAMPLE = 200_000
#: Bytes of text at once: the work arrays take some 30 times that in a worker.
PORTION = 1 << 20
SYMBOLS = b"#*$%&|<>"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_LETTER = np.array([0 if s or b & 0xC0 == 0x80 else 1 for b, s in enumerate(_SPACE)], np.int64)


@dataclass(frozen=True)
class QualityModel:
    """``table``: fixed-point log ratio by bucket; ``threshold``: least mean ratio that is kept."""
    table: np.ndarray
    threshold: float


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram that begins at each byte, and whether it ends inside its document."""
    if len(data) < N_GRAM:
        return np.zeros(len(data), np.int64), np.zeros(len(data), bool)
    d = np.concatenate([data, np.zeros(N_GRAM - 1, np.uint8)]).astype(np.uint32)
    n = len(data)
    gram = d[:n] | d[1:n + 1] << np.uint32(8) | d[2:n + 2] << np.uint32(16) | d[3:n + 3] << np.uint32(24)
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    whole = np.ones(n, bool)
    for back in range(1, N_GRAM):
        ends = offsets[1:] - back
        whole[ends[ends >= offsets[:-1]]] = False
    return bucket.astype(np.int64), whole


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for b in portions(it, PORTION):
        data, offsets = text_buffer(b)
        bucket, whole = gram_buckets(data, offsets)
        raw += np.bincount(bucket[whole], minlength=1 << BUCKET_BITS)
        trusted = np.array(b.column(b.schema.get_field_index("good")).fill_null(False).to_pylist(), bool)
        whole &= np.repeat(trusted, np.diff(offsets))
        good += np.bincount(bucket[whole], minlength=1 << BUCKET_BITS)
    used = np.flatnonzero(raw)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], ["bucket", "raw", "good"])


def score_batch(model: QualityModel, batch: pa.RecordBatch) -> np.ndarray:
    """Mean log ratio of each text of a batch."""
    data, offsets = text_buffer(batch)
    bucket, whole = gram_buckets(data, offsets)
    total = segment_sums(np.where(whole, model.table[bucket], 0), offsets)
    grams = np.maximum(np.diff(offsets) - (N_GRAM - 1), 0)
    return total / (np.maximum(grams, 1) * float(UNIT))


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled ids (lowest id hash first) with whether all their labels are good."""
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") > 0).alias("good")))
    return ids.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float | None = None) -> QualityModel:
    """The ratio table over all ``docs`` and the threshold from the labelled sample."""
    spark = docs.sparkSession
    picked = labelled_sample(labels, sample).toArrow()  # bounded by ``sample``
    known = F.broadcast(spark.createDataFrame(picked.to_pandas(), "label_id long, good boolean"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = text.join(known, F.col("doc_id") == F.col("label_id"), "left").select("text", "good")
    counts = (marked.mapInArrow(_count, "bucket long, raw long, good long").groupBy("bucket")
              .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow())  # one row a bucket
    raw, good = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    at = counts["bucket"].to_numpy()
    raw[at], good[at] = counts["raw"].to_numpy(), counts["good"].to_numpy()
    size = 1 << BUCKET_BITS
    if not good.sum():
        return QualityModel(np.zeros(size, np.int64), float("-inf") if threshold is None else threshold)
    ratio = np.log((good + 1) / (good.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    table = np.rint(ratio * UNIT).astype(np.int64)
    if threshold is None:
        threshold = best_threshold(text.join(known, F.col("doc_id") == F.col("label_id")).select("text", "good"), table)
    return QualityModel(table, threshold)


def best_threshold(labelled: DataFrame, table: np.ndarray) -> float:
    """The bin edge with the most (share of good kept + share of bad rejected); ties take the lowest."""
    model = QualityModel(table, 0.0)

    def bins(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, PORTION):
            at = np.floor(score_batch(model, b) / BIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(b.schema.get_field_index("good"))], ["bin", "good"])

    found = labelled.mapInArrow(bins, "bin long, good boolean").groupBy("bin", "good").count().collect()  # bounded by the score range
    good = {r["bin"]: r["count"] for r in found if r["good"]}
    bad = {r["bin"]: r["count"] for r in found if not r["good"]}
    if not good or not bad:
        return float("-inf")
    edges = sorted({*good, *bad, max(*good, *bad) + 1})
    value = lambda e: (sum(n for k, n in good.items() if k >= e) / sum(good.values())
                       + sum(n for k, n in bad.items() if k < e) / sum(bad.values()))
    best = max(edges, key=lambda e: (round(value(e), 12), -e))
    below = max((k for k in bad if k < best), default=best)  # halfway to the nearest bad score under it
    return (best + below + 1) / 2 * BIN


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def rule_columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The plain counts of each text of a batch and whether they already fail it."""
    data, offsets = text_buffer(batch)
    texts = text_bytes(batch)
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    n_repeat = np.array([repeated_words(w) for w in words], np.int64)
    return {"n_words": n_words, "word_chars": segment_sums(_LETTER[data], offsets),
            "n_symbols": segment_sums(_SYMBOL[data], offsets),
            "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64), "n_repeat_words": n_repeat,
            "base_failed": (n_words < 50) | (100 * n_repeat > 50 * n_words)}


SCORED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, score double")


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """A row per document: its counts, mean log ratio (``score``) and verdict (``kept``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, PORTION):
            cols = rule_columns(b)
            s = score_batch(shared.value, b)
            cols |= {"kept": ~cols["base_failed"] & (s >= shared.value.threshold), "score": s}
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols.values())], ["doc_id", *cols])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCORED)


def keep(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, PORTION):
            ok = ~rule_columns(b)["base_failed"] & (score_batch(shared.value, b) >= shared.value.threshold)
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(rows, docs.schema)

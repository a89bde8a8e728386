"""Operator 6: token ids as length-delimited binary records with an offset index.

A data file is a run of frames, each a little-endian ``uint64`` payload length, the masked CRC-32C
of those 8 bytes, the payload and its masked CRC-32C (the layout of TFRecord files).  A payload
is the document id (``int64``), a byte that says whether it is NULL, a byte with the width of an
id (2 or 4) and the ids.  Beside it an index file holds the ``uint64`` offset of every frame and of the end,
so a reader can take the records of a file in any order.

* One range shuffle puts documents in ascending id order; each task then encodes and writes its range.
* Every attempt of a task writes files of its own name; the manifest, written by Spark, lists those
  of the attempts that counted, and readers open only what it lists.  Lost executors and
  repeated attempts therefore never mix.
* Files turn over at ``FILE_BYTES``, so neither writer nor reader holds more than one batch.

Defined cases: a NULL or empty text is a record with the end id only; NULL ids come first; rows of one
id are ordered by text hash and text; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonecast.llm.common import batches, documents, written
from zonecast.llm.tokens import encoder
from zonecast.session import scratch_dir

FILE_BYTES = 128 << 20
HEAD = struct.Struct("<qBB")
MANIFEST = "part long, seq long, data string, index string, records long, ids long, bytes long"

# ---- CRC-32C of many byte strings at once

_POLY = 0x82F63B78  # reflected Castagnoli polynomial
_MASK = 0xA282EAD8
_BLOCK = 64


def _advance(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """``crc`` moved on by the number of zero bytes that ``tables`` stand for."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Byte tables for one zero byte, and of ``_BLOCK`` times 2^k zero bytes for each k."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> 1 ^ np.uint32(_POLY), byte >> 1)
    values = np.arange(256, dtype=np.uint32)
    shifted = [values << np.uint32(8 * k) for k in range(4)]
    for _ in range(4):  # four bytes at once
        shifted = [byte[x & 255] ^ x >> 8 for x in shifted]
    word = np.stack(shifted)
    powers, now = [], word
    for _ in range(4):  # 4 -> 64 bytes
        now = _advance(now, now)
    for _ in range(32):
        powers.append(now)
        now = _advance(now, now)
    return word, powers


_WORD, _POWERS = _tables()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string.

    Strings are padded in front with zeros to whole blocks (a zero register ignores them) with the
    initial register laid over their first four bytes; all blocks run side by side and are then
    shifted to their places and XORed."""
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in parts])
    blocks = np.maximum(-(-(np.maximum(sizes, 4)) // _BLOCK), 1)
    buf = np.zeros(blocks.sum() * _BLOCK, np.uint8)
    ends = np.cumsum(blocks) * _BLOCK
    flat = np.frombuffer(b"".join(parts), np.uint8)
    at = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(len(flat))
    buf[at] = flat
    long = np.flatnonzero(sizes >= 4)
    first = (ends - sizes)[long]
    for k in range(4):
        buf[first + k] ^= 255
    rows = buf.view("<u4").reshape(-1, _BLOCK // 4)
    crc = np.zeros(len(rows), np.uint32)
    for k in range(_BLOCK // 4):
        crc = _advance(crc ^ rows[:, k], _WORD)
    after = np.repeat(np.cumsum(blocks), blocks) - np.arange(len(rows)) - 1
    for k in range(int(after.max()).bit_length()):
        move = np.flatnonzero(after >> k & 1)
        crc[move] = _advance(crc[move], _POWERS[k])
    out = np.bitwise_xor.reduceat(crc, np.cumsum(blocks) - blocks) ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes < 4):
        out[i] = _short(parts[i])
    return out


def _short(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (_POLY if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(_MASK)


# ---- frames


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [h + x.tobytes() + p + y.tobytes() for h, x, p, y in zip(heads, a, payloads, b)]


def unframe(chunks: list[bytes]) -> list[bytes]:
    """The payloads of whole frames; raises ``ValueError`` where a length or checksum is wrong."""
    heads, payloads = [c[:8] for c in chunks], [c[12:-4] for c in chunks]
    a = np.array([int.from_bytes(c[8:12], "little") for c in chunks], np.uint32)
    b = np.array([int.from_bytes(c[-4:], "little") for c in chunks], np.uint32)
    size = np.array([int.from_bytes(h, "little") for h in heads], np.uint64)
    bad = (masked(crc32c(heads)) != a) | (size != np.array([len(p) for p in payloads], np.uint64)) | (masked(crc32c(payloads)) != b)
    if bad.any():
        raise ValueError(f"damaged record {int(np.flatnonzero(bad)[0])} of {len(chunks)}")
    return payloads


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return HEAD.pack(doc_id or 0, doc_id is None, width) + ids


def from_payload(data: bytes) -> tuple[int | None, bytes]:
    doc_id, null, width = HEAD.unpack_from(data)
    ids = np.frombuffer(data, f"<u{width}", offset=HEAD.size).astype("<u4").tobytes()
    return None if null else doc_id, ids


# ---- the files


def _filesystem(path: str):
    """The shared folder as this task sees it: any file system that pyarrow reaches by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class _Writer:
    """The data and index file that a task is at."""

    def __init__(self, folder: str, part: int, seq: int):
        self.fs, at = _filesystem(folder)
        self.row = {"part": part, "seq": seq, "records": 0, "ids": 0}
        name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}"
        self.row |= {"data": f"{name}.rec", "index": f"{name}.idx"}
        self.at, self.offsets = at, [0]
        self.out = self.fs.open_output_stream(f"{at}/{name}.rec")

    def add(self, chunks: list[bytes], ids: int) -> None:
        for c in chunks:
            self.offsets.append(self.offsets[-1] + len(c))
        self.out.write(b"".join(chunks))
        self.row["records"] += len(chunks)
        self.row["ids"] += ids

    def close(self) -> tuple:
        self.out.close()
        with self.fs.open_output_stream(f"{self.at}/{self.row['index']}") as out:
            out.write(np.array(self.offsets, "<u8").tobytes())
        r = self.row
        return r["part"], r["seq"], r["data"], r["index"], r["records"], r["ids"], self.offsets[-1]


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, file_bytes: int = FILE_BYTES,
                  rows_at_once: int = 1000) -> tuple[str, DataFrame]:
    """Encodes ``docs`` in ascending id order into record files; returns the folder and the manifest."""
    folder = folder or scratch_dir(docs.sparkSession, "records")
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("data", pa.string()), ("index", pa.string()),
                        ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        width = 2 if enc.tok.get_vocab_size() <= 1 << 16 else 4
        part, rows, now = TaskContext.get().partitionId(), [], None
        for b in it:
            for lo in range(0, b.num_rows, rows_at_once):
                piece = b.slice(lo, rows_at_once)
                ids = [enc.ids(t) + end for t in piece.column(1).to_pylist()]
                if now is None:
                    _fs, at = _filesystem(folder)
                    _fs.create_dir(at)
                    now = _Writer(folder, part, len(rows))
                now.add(frames([payload(d, i, width) for d, i in zip(piece.column(0).to_pylist(), ids)]), sum(map(len, ids)) // 4)
                if now.offsets[-1] >= file_bytes:
                    rows.append(now.close())
                    now = None
        if now is not None:
            rows.append(now.close())
        yield from batches(iter(rows), schema)

    by_id = F.col("doc_id").asc_nulls_first()
    ranged = (documents(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(by_id, F.col("h"))
              .sortWithinPartitions(by_id, "h", "text").select("doc_id", "text"))
    return folder, written(ranged.mapInArrow(write, MANIFEST), "records-manifest")


def read_records(manifest: DataFrame, folder: str, seed: int | None = None) -> DataFrame:
    """``part, seq, pos, doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every record.

    ``start`` counts the ids of all records before in file order.  With ``seed`` the records of each
    file are read in a random order through the index."""
    spark = manifest.sparkSession
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()),
                        ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                yield from batches(_records(folder, row, seed), schema, 2000)

    base = F.sum("ids").over(Window.orderBy("part", "seq")) - F.col("ids")  # one row a file
    files = manifest.select("part", "seq", "data", "index", base.alias("base"))
    n = max(manifest.count(), 1)
    spread = files.repartition(min(n, 100_000), "part", "seq")
    return spread.mapInArrow(read, "part long, seq long, pos long, doc_id long, start long, n_tokens long, ids binary")


def _records(folder: str, row: dict, seed: int | None) -> Iterator[tuple]:
    fs, at = _filesystem(folder)
    with fs.open_input_stream(f"{at}/{row['index']}") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    n = len(offsets) - 1
    if seed is None:
        start = row["base"]
        with fs.open_input_stream(f"{at}/{row['data']}") as f:
            for lo in range(0, n, 1000):
                cuts = offsets[lo:min(lo + 1000, n) + 1]
                data = f.read(int(cuts[-1] - cuts[0]))
                for k, p in enumerate(unframe([data[a - cuts[0]:z - cuts[0]] for a, z in zip(cuts, cuts[1:])])):
                    doc_id, ids = from_payload(p)
                    yield row["part"], row["seq"], lo + k, doc_id, start, len(ids) // 4, ids
                    start += len(ids) // 4
        return
    width = 2  # start needs the sizes alone: (frame - head - 16) / width, the width is in each payload
    with fs.open_input_file(f"{at}/{row['data']}") as f:
        order = np.random.default_rng([seed, row["part"], row["seq"]]).permutation(n)
        if n:
            width = HEAD.unpack(f.read_at(HEAD.size, 12))[2]
        sizes = (np.diff(offsets) - 16 - HEAD.size) // width
        starts = row["base"] + np.cumsum(sizes) - sizes
        for k in order:
            doc_id, ids = from_payload(unframe([f.read_at(int(offsets[k + 1] - offsets[k]), int(offsets[k]))])[0])
            yield row["part"], row["seq"], int(k), doc_id, int(starts[k]), len(ids) // 4, ids

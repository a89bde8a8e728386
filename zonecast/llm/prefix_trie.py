"""Operator 12: the prefix trie of conversations, from vertical bitmaps.

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it.
Conversations are dealt by ranges of ids into slabs.  A slab indexes (position, turn) to the bit set of its conversations
with that turn there.  Depth first, the members that have not ended are met with the posting of the lowest one's next turn:
the intersection is a child, and its popcount, lowest member and the list of members that end there are the slab's
share of the node.  Below a single member the path is its own turns.

A node is known by 128 bits: the exclusive or of its turns' hashes, each mixed with its position.  Slabs' shares are
added by node.  What a subtree holds is added without walking the merged trie: each node's smallest member lies in one
slab, and a slab counts ``(members - 1 if the smallest is here, else members) * bytes`` and ``1 if childless and the
smallest is here`` over its own subtree (a sum over preorder numbers); summed over the slabs that gives every
node once.  A parent's smallest member comes the same way, so no join has a parent as its key.

* A first turn, a whole conversation or the root that a third of all conversations share is one row a slab.
* Ids that end at a node stay in compressed lists, one a slab; SHA-256 runs over the sorted lists as a stream, so a
  node's ids are never held at once.
* Some 50 bytes a turn shuffle, no texts.  A slab holds the hashes of at most ``SLAB_CONVERSATIONS`` conversations and
  ``SLAB_TURNS`` turns, or of one longer conversation.

Defined cases: turns are ordered by turn, NULL first, ties by the MD5 of role and text; a NULL role or text is empty; rows without
conv_id belong to no conversation; repeated rows are turns of their own; conversations without turns are members of the
root alone; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonecast.llm.common import batches, ship, written

SLAB_CONVERSATIONS, SLAB_TURNS = 4096, 200_000
_ODD, _MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: A slab's share of a node; ``last``: the greatest preorder number of its subtree, ``up``: its parent's, -1 at the root.
SHARES = pa.schema([("slab", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("up", pa.int32()), ("depth", pa.int64()), ("k1", pa.int64()),
                    ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("bytes", pa.int64()),
                    ("first_end", pa.int64()), ("ends", pa.binary())])
DDL = ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long'}).get(f.type, 'binary')}" for f in SHARES)


def turn_keys(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos (from 1), h1, h2, bytes`` of every turn: two hashes of its role and text, the text's length."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    keyed = rows.select("conv_id", "turn", F.unhex(F.md5(F.concat("role", F.lit(chr(1)), "text"))).alias("tie"), F.xxhash64("role", "text").alias("h1"),
                        F.xxhash64(F.lit(1), F.octet_length("role"), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "tie")
    return keyed.withColumn("pos", F.row_number().over(order).cast("long")).select("conv_id", "pos", "h1", "h2", "bytes")


def shared_heads(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``turns`` (all conversations' keys) with each conversation's first h turns replaced by those of conversation
    ``conv_id - conv_id % group``; h is the CRC-32 of the decimal id modulo ``most``.  Every conversation also has a row of NULL
    hashes at position 0, so one left without turns stays."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    ids = turns.select("conv_id").distinct().select("conv_id", head, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = turns.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    heads = ids.where("h > 0").join(first, "base").where("pos <= h").select("conv_id", "pos", "h1", "h2", "bytes")
    tails = turns.select("*", head).where("pos > h").select("conv_id", "pos", "h1", "h2", "bytes")
    return heads.union(tails).union(marks(turns))


def marks(turns: DataFrame) -> DataFrame:
    """One row without hashes for each conversation of ``turns``, at position 0."""
    none = F.lit(None).cast("long")
    return turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), none.alias("h1"), none.alias("h2"), none.alias("bytes"))


def _slabs(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``ids, offsets, h1, h2, bytes`` of runs of whole conversations from sorted rows; each begins with its row at position 0."""
    held: list[tuple] = []
    rows = starts = 0

    def closed(parts: list[tuple]) -> tuple:
        conv, pos, h1, h2, size = (np.concatenate(x) for x in zip(*parts))
        mark = np.flatnonzero(pos == 0)
        turn = pos > 0
        return conv[mark], np.append(mark - np.arange(len(mark)), turn.sum()), h1[turn], h2[turn], size[turn]

    for b in it:
        columns = [b.column(i).fill_null(0).to_numpy() for i in range(5)]
        at = 0
        for begin in np.flatnonzero(columns[1] == 0).tolist():  # here a conversation begins
            if starts >= SLAB_CONVERSATIONS or rows + begin - at >= SLAB_TURNS and starts:
                held.append(tuple(c[at:begin] for c in columns))
                yield closed(held)
                held, rows, starts, at = [], 0, 0, begin
            starts += 1
        held.append(tuple(c[at:].copy() for c in columns))
        rows += b.num_rows - at
    if starts:
        yield closed(held)


def prefix_keys(offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the key of each turn's node: running exclusive ors over its conversation."""
    length = np.diff(offsets)
    place = (np.arange(len(h1)) - np.repeat(offsets[:-1], length) + 1).astype(np.uint64)
    out = []
    for h, odd in ((h1, _ODD), (h2, _MIX)):
        x = h.view(np.uint64) + place * odd
        x = (x ^ x >> np.uint64(31)) * _MIX
        x = (x ^ x >> np.uint64(29)) * _ODD
        run = np.bitwise_xor.accumulate(x ^ x >> np.uint64(32)) if len(x) else x
        before = np.concatenate([np.zeros(1, np.uint64), run])[offsets[:-1]]
        out.append((run ^ np.repeat(before, length)).view(np.int64))
    return out[0], out[1]


def shares(slab: int, ids: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of one slab in preorder, as ``SHARES``."""
    _, code = np.unique(np.stack([h1, h2], axis=1), axis=0, return_inverse=True) if len(h1) else (None, np.zeros(0, np.int64))
    code, length = code.ravel().tolist(), np.diff(offsets)
    begins, lengths = offsets.tolist(), length.tolist()
    postings: list[dict[int, int]] = [{} for _ in range(max(lengths, default=0))]
    ended: dict[int, int] = {}
    for s, n in enumerate(lengths):
        bit = 1 << s
        ended[n] = ended.get(n, 0) | bit
        for p, c in enumerate(code[begins[s]:begins[s + 1]]):
            postings[p][c] = postings[p].get(c, 0) | bit
    slot, depth, count, up, ends = [], [], [], [], []
    last: list[int] = []
    stack = [((1 << len(lengths)) - 1, 0, -1)]
    while stack:
        members, d, parent = stack.pop()
        pre, low = len(slot), (members & -members).bit_length() - 1
        slot.append(low)
        depth.append(d)
        count.append(members.bit_count())
        up.append(parent)
        last.append(pre)
        over = members & ended.get(d, 0)
        ends.append(over)
        rest = members ^ over
        if rest and not rest & (rest - 1) and rest == members:  # one member: its own turns
            for more in range(d + 1, lengths[low] + 1):
                slot.append(low)
                depth.append(more)
                count.append(1)
                up.append(len(slot) - 2)
                last.append(len(slot) - 1)
                ends.append(rest if more == lengths[low] else 0)
            continue
        children = []
        while rest:
            s = (rest & -rest).bit_length() - 1
            child = rest & postings[d][code[begins[s] + d]]
            rest ^= child
            children.append((child, d + 1, pre))
        stack.extend(reversed(children))
    for pre in range(len(last) - 1, 0, -1):
        if last[pre] > last[up[pre]]:
            last[up[pre]] = last[pre]
    slot, depth = np.array(slot), np.array(depth)
    at = offsets[slot] + depth - 1
    k1, k2 = prefix_keys(offsets, h1, h2)

    def pick(x: np.ndarray, less: int) -> np.ndarray:
        """Each node's value at its turn, or ``less`` turns before; 0 for the root."""
        out, some = np.zeros(len(slot), np.int64), depth > less
        out[some] = x[at[some] - less]
        return out

    first_end, blobs = [], []
    for over in ends:
        if not over:
            first_end.append(None)
            blobs.append(None)
            continue
        mine = ids[np.flatnonzero(np.unpackbits(np.frombuffer(over.to_bytes((over.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))]
        first_end.append(int(mine[0]))
        blobs.append(_packed(mine))
    n = len(slot)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(n, slab)), *[pa.array(x, pa.int32()) for x in (np.arange(n), last, up)], pa.array(depth), pa.array(pick(k1, 0)), pa.array(pick(k2, 0)),
        pa.array(pick(k1, 1)), pa.array(pick(k2, 1)), pa.array(count, pa.int64()), pa.array(ids[slot]), pa.array(pick(size, 0)),
        pa.array(first_end, pa.int64()), pa.array(blobs, pa.binary())], schema=SHARES)


def _packed(ids: np.ndarray) -> bytes:
    """Ascending ids: few as they are, many as compressed differences."""
    raw = np.diff(ids, prepend=0).astype("<i8").tobytes()
    return b"\0" + raw if len(ids) < 16 else b"\1" + zstandard.compress(raw, 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data[1:] if data[0] == 0 else zstandard.decompress(data[1:]), "<i8"))


def slab_nodes(turns: DataFrame) -> DataFrame:
    """``SHARES`` of ``turns (conv_id, pos, h1, h2, bytes)``, where every conversation has a row at position 0."""

    def nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = TaskContext.get().partitionId() << 32  # of the attempt that is written
        for part in _slabs(it):
            yield from shares(slab, *part)
            slab += 1

    return written(turns.select("conv_id", "pos", "h1", "h2", "bytes").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")
                   .mapInArrow(nodes, DDL), "trie-shares")


def subtree_sums(rows: DataFrame) -> DataFrame:
    """``k1, k2, parent, saved, leaves`` of ``rows (slab, pre, last, up, k1, k2, n, least, bytes, conv_id, n_children)``, a slab's
    share of each: the last two hold for the whole trie."""

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in _by_slab(it):
            last, up, n, least, size, conv, children = (slab[c] for c in ("last", "up", "n", "least", "bytes", "conv_id", "n_children"))
            own = least == conv
            inside = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[last + 1] - c[np.arange(len(x))]
            parent = pa.array(conv[up], mask=up < 0)
            yield pa.RecordBatch.from_arrays([pa.array(slab["k1"]), pa.array(slab["k2"]), parent, pa.array(inside((n - own) * size)),
                                              pa.array(inside((own & (children == 0)).astype(np.int64)))], names=["k1", "k2", "parent", "saved", "leaves"])

    return rows.repartition("slab").sortWithinPartitions("slab", "pre").mapInArrow(sums, "k1 long, k2 long, parent long, saved long, leaves long")


def _by_slab(it: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each slab of sorted rows."""
    held: list[pa.RecordBatch] = []

    def closed() -> dict[str, np.ndarray]:
        whole = pa.Table.from_batches(held)
        return {c: whole[c].to_numpy() for c in whole.column_names}

    for b in it:
        cuts = [0, *(np.flatnonzero(np.diff(b.column(0).to_numpy())) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0] != b.column(0)[a]:
                yield closed()
                held.clear()
            if z > a:
                held.append(b.slice(a, z - a))
    if held:
        yield closed()


def end_digests(nodes: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256``: SHA-256 of the ascending ids of the conversations that end at a node, comma-joined."""

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in it for row in zip(*(c.to_pylist() for c in b.columns)))
        out = ((*key, _joined(x[3] for x in group)) for key, group in groupby(rows, key=lambda r: r[:2]))
        yield from batches(out, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]))

    lists = nodes.where("ends is not null").select("k1", "k2", "first_end", "ends")
    return lists.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first_end").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def _joined(lists: Iterator[bytes]) -> str:
    h, comma = hashlib.sha256(), b""
    for data in lists:
        h.update(comma + ",".join(map(str, _unpacked(data).tolist())).encode())
        comma = b","
    return h.hexdigest()


def trie(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of ``turns
    (conv_id, pos, h1, h2, bytes)``, where every conversation has a row at position 0."""
    ship(turns.sparkSession)
    nodes = slab_nodes(turns)
    merged = nodes.groupBy("k1", "k2").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min("depth").alias("depth"),
                                           F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    merged = written(merged, "trie-nodes")
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    known = merged.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    known = written(known.select("k1", "k2", "depth", "conv_id", "n_convs", "n_children"), "trie-nodes")
    rows = nodes.join(known.select("k1", "k2", "conv_id", "n_children"), ["k1", "k2"])
    sums = subtree_sums(rows.select("slab", "pre", "last", "up", "k1", "k2", "n", "least", "bytes", "conv_id", "n_children"))
    totals = sums.groupBy("k1", "k2").agg(F.max("parent").alias("parent_conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    empty = hashlib.sha256().hexdigest()
    out = known.join(totals, ["k1", "k2"]).join(end_digests(nodes), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = written(turn_keys(conversations), "trie-turns")
    return trie(turns.union(marks(turns)))


def oracle_sql() -> str:
    """The trie of conversations with shared heads in DuckDB SQL; a path is the joined hashes of its turns."""
    return r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(1) || coalesce(text, ''))) AS pos,
                  md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS bytes
           FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 5 AS base, (list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
          lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda s, _k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))
          ::UBIGINT) AS crc FROM (SELECT DISTINCT conv_id FROM o)),
c AS (SELECT conv_id, base, (xor(crc, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM i),
t AS (SELECT c.conv_id, o.pos, o.m, o.bytes FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
      UNION ALL SELECT o.conv_id, o.pos, o.m, o.bytes FROM o JOIN c USING (conv_id) WHERE o.pos > c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, bytes, string_agg(m, '') OVER w AS path FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
a AS (SELECT conv_id, depth, bytes, path FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM a GROUP BY conv_id),
n AS (SELECT path, a.depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE e.depth = a.depth), '')) AS ends_sha256
      FROM a JOIN e USING (conv_id) GROUP BY path, a.depth),
k AS (SELECT left(path, 32 * (depth - 1)::INT) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT left(path, 32 * d::INT) AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
      FROM x, unnest(range(0, depth + 1)) r(d) GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s USING (path) LEFT JOIN n u ON x.depth > 0 AND u.path = left(x.path, 32 * (x.depth - 1)::INT)"""

"""Operator 9: removal of lines that many sites share (DataFrame functions only).

Each line's sites are gathered in a HyperLogLog sketch per line hash, merged by aggregation.  A
line whose estimate is clear of the threshold is judged by it; lines near the threshold get an
exact distinct count.  A line on ``min_sites`` sites or more is boilerplate: it stays in the
document of the smallest id that has it and goes from all others.

* A line's key is 64 bits of xxhash and 32 of CRC over the line without surrounding blanks.
* Sketches merge map-side, so a line that a third of all rows hold is one row a task.
* Document texts move only in the last join, which gives each document the positions to drop; work is
  linear in the lines of a text, however many it has.

Defined cases: blank lines are never boilerplate; a NULL site counts for no line; a NULL text
stays NULL; documents with a NULL id are never the one that keeps a line; repeated rows are
treated alike; a document left without lines keeps its row with an empty text; the sites of an
empty table are none, so nothing is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import written

MIN_SITES = 8
#: log2 of the sketch's registers, and the standard errors that a clear estimate is away.
LG_K, MARGIN = 12, 6
BROADCAST_ROWS = 500_000


def _lines(docs: DataFrame, site: str) -> DataFrame:
    text = F.col("text").cast("string")
    line = F.trim(F.col("line"), F.lit(" \t\r"))
    # a text is hashed and split once, below the explosion: none is carried along with each of its lines
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        F.col(f"`{site}`").cast("string").alias("site"), F.split(text, "\n", -1).alias("lines"))
    return (split.select("doc_id", "text_hash", "site", F.posexplode("lines").alias("pos", "line")).where(line != "")
            .select("doc_id", "text_hash", "site", "pos", F.xxhash64(line).alias("k1"), F.crc32(line).alias("k2")))


def site_spread(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The boilerplate lines: ``k1, k2, first_doc`` (smallest id that has the line), ``sites``."""
    lines = _lines(docs, site)
    band = max(1.0, MARGIN * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = (lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc_id").alias("first_doc"))
              .select("k1", "k2", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
              .where(F.col("sites") >= min_sites - band))
    spread = written(spread, "line-spread")
    near = spread.where(F.col("sites") <= min_sites + band)
    exact = (_sided(lines.select("k1", "k2", "site"), near.select("k1", "k2"))
             .groupBy("k1", "k2").agg(F.countDistinct("site").alias("exact")))
    judged = spread.join(exact, ["k1", "k2"], "left").withColumn("sites", F.coalesce("exact", "sites")).drop("exact")
    return written(judged.where(F.col("sites") >= min_sites), "boilerplate-lines")


def _sided(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose line is among ``keys``: broadcast when few, else a shuffle join that splits hot lines."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, ["k1", "k2"], "inner")


def removable(docs: DataFrame, boilerplate: DataFrame, site: str = "source") -> DataFrame:
    """``doc_id, text_hash, gone``: the positions that a document loses."""
    hits = _sided(_lines(docs, site).drop("site"), boilerplate.select("k1", "k2", "first_doc"))
    return (hits.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
            .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")))


def _kept_text(text: Column, gone: Column) -> Column:
    """The lines between removed positions, slice by slice: linear in the lines of a text."""
    at = F.array_sort(gone)
    parts = F.struct(F.split(text, "\n", -1).alias("lines"), F.concat(F.array(F.lit(-1)), at).alias("after"),
                     F.concat(at, F.array(F.lit((1 << 31) - 1))).alias("upto"))
    # an array of one, so that the lambda's variable holds what is computed once
    slices = lambda p: F.flatten(F.transform(p["upto"], lambda z, i: F.slice(p["lines"], p["after"][i] + 2, z - p["after"][i] - 1)))
    left = F.transform(F.array(parts), lambda p: F.concat_ws("\n", slices(p)))[0]
    return F.when(gone.isNull(), text).otherwise(left)


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text`` and a column ``n_removed_lines``."""
    gone = removable(docs, site_spread(docs, site, min_sites), site).select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("gone").alias("__gone"))
    text = F.col("text").cast("string")
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__hash")), "left")
    return joined.select(*[_kept_text(text, F.col("__gone")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                         F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed_lines"))


def oracle_sql(table: str = "documents", min_sites: int = MIN_SITES) -> str:
    """The same result in DuckDB SQL, with exact distinct counts throughout."""
    return f"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {table}),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
b AS (SELECT t, min(doc_id) AS first_doc FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {min_sites}),
m AS (SELECT k.doc_id, k.line, k.pos, (b.t IS NOT NULL AND k.doc_id IS DISTINCT FROM b.first_doc) AS gone FROM k LEFT JOIN b ON k.t = b.t),
d AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
             count(*) FILTER (WHERE gone) AS n_removed_lines FROM m GROUP BY doc_id)
SELECT x.doc_id, x.source, d.text, d.n_removed_lines FROM {table} x JOIN d USING (doc_id)"""

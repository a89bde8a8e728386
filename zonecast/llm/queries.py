"""One query per operator, over its whole table with production parameters, and DuckDB texts where
SQL can express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm import (block_search, bloom_lm, decontamination, filter_audit, html_layout, jaccard_join, line_spread, mixing, packing,
                          prefix_trie, quality_llr, record_files, substring_dedup)
from zonecast.llm.common import table, written


def tokenizer_path() -> str:
    """The public tokenizer that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.duplicate_spans(table(spark, sf, "documents")).drop("t")


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op4_block_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return block_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"), w=4, percent=85)


def op6_record_files(spark: SparkSession, sf: str) -> DataFrame:
    folder, manifest = record_files.write_records(table(spark, sf, "documents"), tokenizer_path())
    return record_files.read_records(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_html_layout(spark: SparkSession, sf: str) -> DataFrame:
    return html_layout.extract(table(spark, sf, "pages"))


def op8_bloom_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = bloom_lm.split_rows(table(spark, sf, "documents"))
    model, words = bloom_lm.fit(docs)
    return bloom_lm.score(docs, model, words)


def op9_line_spread(spark: SparkSession, sf: str) -> DataFrame:
    return line_spread.remove_boilerplate(table(spark, sf, "documents")).select("doc_id", "source", "text", "n_removed_lines")


def op10_quality_llr(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality_llr.score(docs, quality_llr.fit(docs, table(spark, sf, "labels")))


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = written(prefix_trie.turn_keys(table(spark, sf, "conversations")), "trie-turns")
    return prefix_trie.trie(prefix_trie.shared_heads(turns))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontamination.report(decontamination.find(docs, table(spark, sf, "benchmark")))


QUERIES = (op1_packing, op2_substring_dedup, op3_mixing, op4_block_search, op5_jaccard_join, op6_record_files, op7_html_layout, op8_bloom_lm,
           op9_line_spread, op10_quality_llr, op11_filter_audit, op12_prefix_trie, op13_decontamination)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_block_search": block_search.oracle_sql(), "op5_jaccard_join": jaccard_join.oracle_sql(), "op9_line_spread": line_spread.oracle_sql(),
            "op11_filter_audit": filter_audit.oracle_sql(), "op12_prefix_trie": prefix_trie.oracle_sql(),
            "op13_decontamination": decontamination.oracle_sql()}

"""The queries of the operators over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, fill_middle, html_text, jaccard, line_dedup, lm_score, packing, quality, secret_scan, simhash, token_counts, token_files
from .common import shared_dir, table
from .tokens import vocabulary_path


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"), "byte", 0)
    records = token_files.read_token_files(spark, path).select("part", "number", "doc_id", "start_in_shard", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return token_files.with_global_starts(records, token_files.directory(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), "word", 2, limit=packing.MANY_PIECES)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secret_scan.Ledger(spark, shared_dir(spark))
    ledger.update(docs)
    found = secret_scan.report(docs, ledger)
    kinds = [r.kind for r in secret_scan.BASE]

    def spans_of(*some: str):
        return F.filter("spans", lambda s: s.kind.isin(*some))

    counts = [F.size(spans_of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(spans_of(*kinds)), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, end = shared_dir(spark), 49407
    token_counts.write_flat_files(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), "word", end)
    counts = token_counts.count_tokens(spark, path, end, 2)
    return counts.join(token_counts.document_keys(spark, path), ["part", "ordinal"]).select("doc_id", "part", "ordinal", "start", "n_tokens")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept", "log_ppl", "low", "high")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontaminate.OVERLAPS_SQL, "op6_secret_scan": secret_scan.scan_sql(), "op11_fill_middle": fill_middle.SQL, "op12_collocations": collocations.SQL, "op13_jaccard": jaccard.SQL}

"""The registered queries of the operators: thin callers that read their whole
table, apply the operator with production parameters and derive the columns
of the query's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multisvm.llm.common import fold, table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file (the same on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.html_text import extract_text

    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.mtree import top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.quality_rules import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]
    return quality_rules(docs).select("doc_id", *[f"quality.{n}" for n in names], "quality.base_failed", "quality.kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.substrings import dedup_substrings

    cut = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cut.select("doc_id", "removed.n_words", "removed.n_removed", kept.alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.quality_ranking import rank_quality

    return rank_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.language import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "language.lang_pred", "language.score")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.licenses import LONG_REACH, scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), reach=LONG_REACH)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.line_dedup import dedup_lines

    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.whitening import whiten

    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from multisvm.llm.hard_negatives import hard_negatives

    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy.alias("label"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_top_k": op2_top_k,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_quality_ranking": op8_quality_ranking,
    "op9_language": op9_language,
    "op10_license_scans": op10_license_scans,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

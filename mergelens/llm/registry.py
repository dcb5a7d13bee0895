"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, lines, lm, njoin, packing, pii, quality, secrets, snapdiff, topk, whitening
from .common import table
from .oracle import oracle_sql  # noqa: F401  part of this module's interface


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's kept text and the numbers of its lines that went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    numbers = F.array_join(F.transform("removed_lines", lambda i: i.cast("string")), ",")
    return lines.dedup_lines(docs).select("doc_id", "text", numbers.alias("removed_lines"), F.size("removed_lines").alias("n_removed"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer())


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return njoin.jaccard_components(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op12_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapdiff.snapshot_report(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_decontamination,
            op2_lm_scoring,
            op3_exact_top_k,
            op4_line_dedup,
            op5_quality_classifier,
            op6_secret_scan,
            op7_language_id,
            op8_packing,
            op9_ngram_join,
            op10_license_scan,
            op11_personal_data,
            op12_snapshot_diff,
            op13_embedding_whitening,
        )
    }

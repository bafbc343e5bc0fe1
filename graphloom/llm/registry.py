"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anisotropic_ann import search
from .bpe_codec import decode, encode, ids_text
from .common import table
from .fill_middle import SQL as FILL_SQL
from .fill_middle import fill_middle, restore
from .language_id import held_out, identify
from .language_id import train as train_languages
from .license_scan import license_scan
from .license_scan import sql as license_sql
from .line_dedup import line_dedup
from .mixing import SQL as MIX_SQL
from .mixing import mix
from .ngram_join import join as ngram_join
from .source_divergence import SQL as DIVERGENCE_SQL
from .source_divergence import divergence
from .suffix_dedup import suffix_dedup
from .syncmers import fingerprints
from .token_counts import token_counts
from .toxicity import score
from .toxicity import train as train_toxicity


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str):
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2))
    return train_toxicity(table(spark, sf_dir, "documents"), labels.select("doc_id", "toxic"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang"))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id"), 5, 0)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle(table(spark, sf_dir, "documents"))
    restored = restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_line_dedup": op2_line_dedup,
        "op3_ann": op3_ann,
        "op4_mix": op4_mix,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_syncmers": op6_syncmers,
        "op7_ngram_join": op7_ngram_join,
        "op8_toxicity": op8_toxicity,
        "op9_token_counts": op9_token_counts,
        "op10_language_id": op10_language_id,
        "op11_fill_middle": op11_fill_middle,
        "op12_divergence": op12_divergence,
        "op13_licenses": op13_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix": MIX_SQL,
        "op11_fill_middle": FILL_SQL,
        "op12_divergence": DIVERGENCE_SQL,
        "op13_licenses": license_sql(),
    }

"""A corpus pipeline over documents, built from the operators of graphloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe_codec import decode, encode, ids_text
from graphloom.llm.common import Workspace, fresh, table
from graphloom.llm.language_id import held_out
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.mixing import WORD, copies_of, mix
from graphloom.llm.ngram_join import one_of_each
from graphloom.llm.toxicity import score_column_kept, train

SEED = "mix-1"
#: Executors hold what earlier stages left, so tokens are made in smaller blocks than alone.
BLOCK_CHARS = 6_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more go. The model is learned from the labels of rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "toxic")
    return score_column_kept(docs, train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document, or earlier in the same, go; a document that loses its last line goes."""
    kept = line_dedup(docs)
    kept = kept.where((F.col("n_removed") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike(r"\S"))
    kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    _, plan = mix(docs, seed=SEED)
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    copies, copy = fresh(docs, "copies", "copy")
    taken = copies_of(docs, plan, F.col("doc_id"), size, SEED, copies)
    return taken.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies, copy)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(docs, path, public_tokenizers.PATTERN, block_chars=BLOCK_CHARS), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(ids_text("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs

"""Token counts by rank-synchronous array merging, without building the ids.

A map over partitions: nothing is shuffled, and what a task holds is one batch of texts, its pre-tokens and a
bounded cache. Cost follows the bytes of the texts alone, so neither hot sources nor copies are special.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import JsonVocabulary
from .common import ship

CHUNK_CHARS = 2_000_000
CACHE_WORDS = 400_000

_vocabularies: dict[tuple, tuple[JsonVocabulary, dict[str, int]]] = {}


def _vocabulary(file: bytes, pattern: str) -> tuple[JsonVocabulary, dict[str, int]]:
    key = (len(file), hash(file), pattern)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = (JsonVocabulary(file, pattern), {})
    return _vocabularies[key]


def counts_of(texts: list[str | None], vocabulary: JsonVocabulary, cache: dict[str, int]) -> np.ndarray:
    """Tokens of each text. cache: pre-token -> its number of tokens; emptied when it is full."""
    out = np.zeros(len(texts), np.int64)
    begin = 0
    while begin < len(texts):
        end, chars, split = begin, 0, []
        while end < len(texts) and (end == begin or chars < CHUNK_CHARS):
            words, special = vocabulary.pieces(texts[end] or "")
            out[end] += special
            split.append(words)
            chars += len(texts[end] or "")
            end += 1
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list({w for words in split for w in words if w not in cache})
        if new:
            _, sizes = vocabulary.merger.encode([w.encode() for w in new])
            cache.update(zip(new, sizes.tolist()))
        for k, words in enumerate(split):
            out[begin + k] += sum(map(cache.__getitem__, words))
        begin = end
    return out


def token_counts(docs: DataFrame, vocabulary_path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Null texts count as empty (0 tokens). Repeated rows and ids are counted row by row; other columns are left
    out, whatever their names. An empty table gives an empty result. A text of any length is counted whole.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # fixed size

    def run(batches):
        vocabulary, cache = _vocabulary(file.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = counts_of(texts, vocabulary, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

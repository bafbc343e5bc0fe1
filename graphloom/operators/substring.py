"""Substring search by an index of trigrams: which rows may hold a text is told by postings, and only these rows are read and looked at.

A table of rows lies in blocks; for each trigram and block there is a posting, the row numbers in it as differences of one byte or more.
Both tables are sorted by what they are looked up by, so filters on it skip most of their files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

BLOCK_ROWS = 4096
PENDING = 4_000_000  # trigrams that a task holds before it gives them out
ROWS_GROUP, POSTINGS_GROUP = 4 << 20, 1 << 20  # bytes of a row group, what a filter reads at least
LISTED_BLOCKS = 10_000  # blocks that a filter names; more are found by the join alone


def grams(text: str) -> np.ndarray:
    """The different trigrams of a text, three code points of 21 bits each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.empty(0, np.int64)


def packed(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes, seven bits each, the low ones first, the high bit where another follows; and how many bytes each took."""
    sizes = np.ones(len(gaps), np.int64)
    for k in (7, 14, 21, 28):
        sizes += gaps >> k > 0
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[begins[has] + k] = gaps[has] >> 7 * k & 127 | (sizes[has] > k + 1) << 7
    return out, sizes


def unpacked(data: bytes) -> np.ndarray:
    """Row numbers of a posting."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    last = b < 128
    group = np.concatenate(([0], np.cumsum(last)[:-1]))
    begins = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(b) else np.empty(0, np.int64)
    return np.cumsum(np.bincount(group, (b & 127) << 7 * (np.arange(len(b)) - begins[group]), int(last.sum())).astype(np.int64)) if len(b) else begins


def _numbered(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = 0
    for batch in batches:
        k = np.arange(at, at + batch.num_rows)
        block = (np.int64(TaskContext.get().partitionId()) << 32) + k // block_rows
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array((k % block_rows).astype(np.int32)), *batch.columns], ["block", "no", "id", "text"])
        at += batch.num_rows


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for batch in batches:
        for block, no, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            g = grams(text or "")
            if found and (found[0][0] != block or held > PENDING):
                yield from _given(found)
                found, held = [], 0
            found.append((block, no, g))
            held += len(g)
    if found:
        yield from _given(found)


def _given(found: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Postings of some rows of one block."""
    g = np.concatenate([x for *_, x in found])
    if not len(g):
        return
    no = np.repeat([n for _, n, _ in found], [len(x) for *_, x in found])
    order = np.lexsort((no, g))
    g, no = g[order], no[order]
    first = np.concatenate(([True], g[1:] != g[:-1]))
    gaps = np.where(first, no, np.diff(no, prepend=0))
    data, sizes = packed(gaps)
    begins = np.flatnonzero(first)
    ends = np.concatenate((begins[1:], [len(g)]))
    offsets = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate((begins, [len(g)]))].astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    block = pa.array(np.full(len(begins), found[0][0], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(g[begins]), block, pa.array((ends - begins).astype(np.int32)), binary], ["gram", "block", "n", "nos"])


def build(texts: DataFrame, folder: str, id_col: str = "id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> None:
    """Writes the index of texts to a folder: rows (block, no, id, text) and postings (gram, block, n, nos).

    Two shuffles: rows by id, postings by (gram, block), so that a trigram of every row is spread as well. Null texts are kept and never found.
    """
    spark = texts.sparkSession
    ship(spark)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(lambda batches: _numbered(batches, block_rows), f"block long, no int, id {kind}, text string")
    rows.write.option("parquet.block.size", ROWS_GROUP).parquet(f"{folder}/rows")
    made = spark.read.parquet(f"{folder}/rows").select("block", "no", "text").mapInArrow(_postings, "gram long, block long, n int, nos binary")
    made.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.option("parquet.block.size", POSTINGS_GROUP).parquet(f"{folder}/postings")


def contains(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """id, text of the rows of an index whose text holds the pattern, exactly and with its case.

    Blocks that hold every trigram of the pattern are found from its postings, rows in them by meeting the row numbers; what is left is
    read and verified. Patterns under three characters have no trigram: all rows are looked at.
    """
    rows = spark.read.parquet(f"{folder}/rows")
    wanted = grams(pattern).tolist()
    if not wanted:
        return rows.where(F.contains("text", F.lit(pattern))).select("id", "text")
    ship(spark)
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("gram").isin(wanted))
    held = postings.groupBy("block").agg(F.collect_list(F.struct("gram", "nos")).alias("lists"), F.count_distinct("gram").alias("k")).where(F.col("k") == len(wanted))  # postings of one block

    @F.pandas_udf("array<int>")
    def common(lists: pd.Series) -> pd.Series:
        def one(parts):
            by_gram: dict[int, list[np.ndarray]] = {}
            for part in parts:
                by_gram.setdefault(part["gram"], []).append(unpacked(part["nos"]))
            sets = sorted((np.concatenate(x) for x in by_gram.values()), key=len)
            left = sets[0]
            for x in sets[1:]:
                left = np.intersect1d(left, x)
            return left.astype(np.int32)

        return lists.map(one)

    found = held.select("block", F.explode(common("lists")).alias("no"))
    blocks = [r.block for r in held.select("block").limit(LISTED_BLOCKS + 1).collect()]
    if len(blocks) <= LISTED_BLOCKS:
        rows = rows.where(F.col("block").isin(blocks))
    return rows.join(found, ["block", "no"], "left_semi").where(F.contains("text", F.lit(pattern))).select("id", "text")

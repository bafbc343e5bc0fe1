"""Exact vector similarity in blocks: pairs over a threshold, nearest neighbours, search by one vector.

Rows are packed into blocks of bounded size, as narrow as their column; each pair of blocks is one row of an equi-join
and a matrix product in double precision, a few rows at a time. Each block travels once for each other, so blocks are
as large as a task can hold, and pairs without an order meet in one of the two orders of their blocks. What leaves
a pair of blocks is what passes the threshold or the best k of each row; where components or counts are all that is
asked, no more than a row for each of its vectors, or for each two groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Components of a block at most; blocks at least, if these have ROWS rows; products at a time.
CELLS, BLOCKS, ROWS, STEP = 1 << 21, 6, 512, 1 << 22
#: The group of rows without one, inside blocks.
NONE = -(1 << 63)


def _packed(df: DataFrame, id_col: str, vector_col: str, blocks: int, width: type, group_col: str | None = None) -> DataFrame:
    """block, ids (with a group: and then the groups), v (as bytes), one row for each block; null and zero vectors go."""
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if width is np.float32 else "array<double>").alias("v"), *([F.coalesce(F.col(group_col).cast("long"), F.lit(NONE)).alias("group")] if group_col else [])).where(norm > 0)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        v = group.column("v").combine_chunks().flatten().to_numpy()
        ids = b"".join(group.column(c).to_numpy().tobytes() for c in (("id", "group") if group_col else ("id",)))
        return pa.table({"block": group.column("block")[:1], "ids": pa.array([ids], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())})

    return rows.groupBy("block").applyInArrow(pack, "block int, ids binary, v binary")


def _blocks(df: DataFrame, id_col: str, vector_col: str, run, schema: str, ordered: bool = True, group_col: str | None = None) -> DataFrame:
    """run(ids, other ids, unit vectors, other unit vectors, same block) -> record batches; every ordered pair of blocks once, or every pair without an order. With a group, ids has a second row: the groups."""
    ship(df.sparkSession)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_col)).alias("d")).first()
    blocks = max(1, -(-size.n * max(1, size.d or 1) // CELLS), min(-(-size.n // ROWS), BLOCKS))
    width = np.float32 if df.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64
    packed = _packed(df, id_col, vector_col, blocks, width, group_col)
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = packed.withColumn("other", F.explode(every if ordered else F.sequence(F.col("block"), F.lit(blocks - 1))))
    right = packed.select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("v").alias("v2"))
    right = right.withColumn("block", F.explode(every if ordered else F.sequence(F.lit(0), F.col("other"))))
    met = left.join(right, ["block", "other"]).select("ids", "v", "ids2", "v2", (F.col("block") == F.col("other")).alias("same"))

    def unit(v: pa.Scalar, n: int) -> np.ndarray:
        v = np.frombuffer(v.as_buffer(), width).reshape(n, -1).astype(np.float64)
        return v / np.sqrt((v * v).sum(1, keepdims=True))

    def each(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ids2 = (np.frombuffer(batch.column(k)[row].as_buffer(), np.int64) for k in (0, 2))
                if group_col:
                    ids, ids2 = ids.reshape(2, -1), ids2.reshape(2, -1)
                yield from run(ids, ids2, unit(batch.column(1)[row], ids.shape[-1]), unit(batch.column(3)[row], ids2.shape[-1]), batch.column(4)[row].as_py())

    return met.mapInArrow(each, schema)


def _steps(v: np.ndarray, v2: np.ndarray):
    """First row and products of a few rows at a time."""
    step = max(1, STEP // len(v2))
    for at in range(0, len(v), step):
        yield at, v[at : at + step] @ v2.T


def _products(df: DataFrame, id_col: str, vector_col: str, pick, ordered: bool = True) -> DataFrame:
    """pick(ids, other ids, products, same block) -> a, b, score of what goes on."""

    def run(ids, ids2, v, v2, same):
        for at, product in _steps(v, v2):
            a, b, score = pick(ids[at : at + len(product)], ids2, product, same)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], ["a", "b", "score"])

    return _blocks(df, id_col, vector_col, run, "a long, b long, score double", ordered)


def similar_pairs(df: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """a, b, score: pairs a < b whose cosine is at least the threshold."""

    def pick(ids, ids2, product, same):
        i, j = np.nonzero(product >= threshold)
        a, b, score = ids[i], ids2[j], product[i, j]
        if same:
            ok = a < b
            return a[ok], b[ok], score[ok]
        ok = a != b
        return np.minimum(a, b)[ok], np.maximum(a, b)[ok], score[ok]

    return _products(df, id_col, vector_col, pick, ordered=False)


def _hooked(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """low, the least known node of the component of each node, after the links (i, j)."""
    while True:
        before = low
        x, y = low[i], low[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        low = low.copy()
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, deeper := low[low]):
            low = deeper
        if np.array_equal(low, before):
            return low


def similar_forest(df: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """a, b: links with the same components as all pairs whose cosine is at least the threshold, but no more than a row for each vector of a pair of blocks."""

    def run(ids, ids2, v, v2, same):
        every = np.unique(np.concatenate([ids, ids2]))
        to, to2 = np.searchsorted(every, ids), np.searchsorted(every, ids2)
        low = np.arange(len(every))
        for at, product in _steps(v, v2):
            i, j = np.nonzero(product >= threshold)
            low = _hooked(low, to[at + i], to2[j])
        a = np.flatnonzero(low != np.arange(len(every)))
        yield pa.RecordBatch.from_arrays([pa.array(every[low[a]]), pa.array(every[a])], ["a", "b"])

    return _blocks(df, id_col, vector_col, run, "a long, b long", ordered=False)


def similar_counts(df: DataFrame, threshold: float, group_col: str, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """c1, c2, edges: pairs of vectors whose cosine is at least the threshold, counted by their groups (whole numbers, c1 <= c2; rows without one have null) where the blocks meet."""

    def run(ids, ids2, v, v2, same):
        names, place = np.unique(np.concatenate([ids[1], ids2[1]]), return_inverse=True)
        place, place2 = place[: len(v)], place[len(v) :]
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, product in _steps(v, v2):
            i, j = np.nonzero(product >= threshold)
            if same:
                i, j = (x[ids[0][at + i] < ids2[0][j]] for x in (i, j))
            x, y = place[at + i], place2[j]
            found, m = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_counts=True)
            codes, where = np.unique(np.concatenate([codes, found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, m]), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[codes // len(names)]), pa.array(names[codes % len(names)]), pa.array(n)], ["c1", "c2", "edges"])

    met = _blocks(df, id_col, vector_col, run, "c1 long, c2 long, edges long", ordered=False, group_col=group_col)
    name = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return met.groupBy("c1", "c2").agg(F.sum("edges").alias("edges")).select(name("c1"), name("c2"), "edges")


def nearest(df: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", threshold: float | None = None) -> DataFrame:
    """src, dst, score, rank: each row's k nearest others by cosine, ties to the smaller id."""

    def pick(ids, ids2, product, same):
        if same:
            product = np.where(ids[:, None] == ids2[None, :], -np.inf, product)
        take = min(k, product.shape[1])
        cut = np.partition(product, product.shape[1] - take, 1)[:, product.shape[1] - take, None]
        i, j = np.nonzero((product >= cut) & (product > (-np.inf if threshold is None else threshold - 1e-15)))
        return ids[i], ids2[j], product[i, j]

    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))
    found = _products(df, id_col, vector_col, pick).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score", "rank")


def search_vector(df: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id, score: the k rows nearest to one vector."""
    v = F.col(vector_col).cast("array<double>")
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return df.select(F.col(id_col).alias("id"), F.try_divide(dot, norm * F.lit(length)).alias("score")).where("score is not null").orderBy(F.col("score").desc(), "id").limit(k)

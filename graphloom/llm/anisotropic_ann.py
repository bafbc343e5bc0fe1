"""Largest inner products by score-aware (anisotropic) product quantisation.

Vectors are cut into pairs of components, each coded by one of 16 centres (four bits). Codes and centres minimise
|r|^2 + (eta - 1) (r . x/|x|)^2 for the residual r of a vector x: an error along x changes large inner products and
so costs eta times one across it. A query's products with all centres make a table; a row's approximate score is a
sum over the table at its codes. The best rows by that, for each query over all rows, are ranked by the exact
product in double precision.

Centres are fitted on the driver on at most SAMPLE vectors (those with the smallest hash of their id); every row is
coded. Codes, lengths of residuals and vectors lie in blocks of bounded size, and each pair of a block of rows and a
block of queries is one row of an equi-join and one piece of work, which sends on no more than each query's `top` rows.

How many rows of a block are ranked exactly is told by the rows: first the best by approximate score (LEAST at least,
or ROOT times the root of the number of rows), whose exact products give what a row must reach; then all whose
approximate score reaches it with an error of SIGMAS times what errors are found to be for that query, as shares
of the residuals' lengths. Where codes do not tell rows apart (tight groups, lengths that differ much, many dimensions)
more rows are ranked exactly, and no list is cut. An error is at most the residual's length times the query's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, ship

SAMPLE = 10_000
CENTRES = 16
#: Components of a block of rows; queries of a block, of a step within it; pieces of work at least, if there are queries for them.
BLOCK_CELLS, QUERY_BLOCK, STEP, PIECES = 1 << 22, 4_096, 64, 8
LEAST, ROOT = 100, 2
SIGMAS, PROBES = 4.0, 256
#: With more centres than that (times two) these are not fitted all at once.
WIDEST = 4_096
THRESHOLD = 0.2


class Quantiser:
    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta  # pairs x 16 x 2

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        """rows x pairs x 2; an odd dimension gets a zero."""
        if x.shape[1] % 2:
            x = np.hstack([x, np.zeros((len(x), 1), x.dtype)])
        return x.reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2, start: np.ndarray | None = None) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres on."""
        parts = self.parts(x)
        unit = parts / np.maximum(np.sqrt((parts**2).sum((1, 2), keepdims=True)), 1e-30)
        if start is None:
            start = np.stack([((parts[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(parts.shape[1])], 1)
        codes = start.copy()
        at = np.arange(parts.shape[1])
        along = ((parts - self.centres[at, codes]) * unit).sum((1, 2))
        for _ in range(sweeps):
            for m in range(parts.shape[1]):
                r = parts[:, m, None] - self.centres[m]
                p = (r * unit[:, m, None]).sum(2)
                rows = np.arange(len(codes))
                rest = along - p[rows, codes[:, m]]
                cost = (r**2).sum(2) + (self.eta - 1) * (rest[:, None] + p) ** 2
                codes[:, m] = cost.argmin(1)
                along = rest + p[rows, codes[:, m]]
        return codes

    def off(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of the residuals."""
        return np.sqrt(((self.parts(x) - self.centres[np.arange(codes.shape[1]), codes]) ** 2).sum((1, 2)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """pairs x 16 x queries."""
        return np.einsum("mkc,qmc->mkq", self.centres, self.parts(queries)).astype(np.float32)


def fit(sample: np.ndarray, rounds: int = 6, seed: int = 3) -> Quantiser:
    d = sample.shape[1]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    parts = Quantiser.parts(sample.astype(np.float64))
    n, pairs = parts.shape[:2]
    rng = np.random.default_rng(seed)
    centres = np.stack([parts[rng.integers(0, n, CENTRES), m] for m in range(pairs)])
    for m in range(pairs):
        for _ in range(8):
            code = ((parts[:, m, None] - centres[m]) ** 2).sum(2).argmin(1)
            size = np.bincount(code, minlength=CENTRES)
            for c in range(2):
                mean = np.bincount(code, parts[:, m, c], CENTRES) / np.maximum(size, 1)
                centres[m, :, c] = np.where(size > 0, mean, centres[m, :, c])
    q, codes = Quantiser(centres, eta), None
    unit = parts / np.maximum(np.sqrt((parts**2).sum((1, 2), keepdims=True)), 1e-30)
    norm = (parts * unit).sum((1, 2))
    width = pairs * CENTRES * 2
    for _ in range(rounds if width <= WIDEST else 0):
        codes = q.encode(sample.astype(np.float64), sweeps=1, start=codes)
        # all centres at once: the loss is quadratic in them
        A, b = np.zeros((width, width)), np.zeros(width)
        column = (np.arange(pairs) * CENTRES + codes) * 2
        for at in range(0, n, 2048):
            k = slice(at, at + 2048)
            V = np.zeros((len(codes[k]), width))
            rows = np.arange(len(V))[:, None]
            for c in range(2):
                V[rows, column[k] + c] = unit[k, :, c]
            A += (eta - 1) * (V.T @ V)
            b += (eta - 1) * (V.T @ norm[k])
        for c in range(2):
            size = np.bincount((column + c).ravel(), minlength=width)
            A[np.arange(width), np.arange(width)] += size
            b += np.bincount((column + c).ravel(), parts[:, :, c].ravel(), width)
        A[np.arange(width), np.arange(width)] += 1e-6
        q = Quantiser(np.linalg.solve(A, b).reshape(pairs, CENTRES, 2), eta)
    return q


def shortlist_size(rows: int, top: int) -> int:
    return max(LEAST, top + 1, math.ceil(ROOT * math.sqrt(rows)))


def best_of_block(quantiser: Quantiser, ids: np.ndarray, codes: np.ndarray, off: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, first: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, product of each query's `top` best rows of a block, its own row left out; rows lie in order of ids."""
    n = len(ids)
    probes = np.unique(np.linspace(0, n - 1, min(n, PROBES)).astype(np.int64))
    probed, off = vectors[probes].astype(np.float64), off.astype(np.float64)
    tiny = max(float(off.max()) * 1e-9, 1e-300)
    out = []
    for start in range(0, len(query_ids), STEP):
        asked = queries[start : start + STEP]
        tables = quantiser.tables(asked)
        approx = np.zeros((n, len(asked)), np.float32)
        for at in range(0, n, 1024):
            for m in range(codes.shape[1]):
                approx[at : at + 1024] += tables[m][codes[at : at + 1024, m]]
        approx = np.ascontiguousarray(approx.T)
        for k, q in enumerate(asked):
            own, s = query_ids[start + k], approx[k]
            found = np.argpartition(s, n - first)[n - first :] if n > first else np.arange(n)
            score = (vectors[found].astype(np.float64) * q).sum(1)
            if n > first:
                length = float(np.sqrt((q * q).sum()))
                shares = [(exact - s[rows]) / np.maximum(off[rows], tiny) for exact, rows in (((probed * q).sum(1), probes), (score, found))]
                error = min(length * (1 + 1e-6), SIGMAS * max(float(np.sqrt((x * x).mean())) for x in shares))
                others = np.sort(score[ids[found] != own])
                # what is not below, and not what is above: products beyond 32 bits are no numbers
                may = ~(s + error * off < others[-top])
                may[found] = False
                more = np.flatnonzero(may)
                found, score = np.concatenate([found, more]), np.concatenate([score, (vectors[more].astype(np.float64) * q).sum(1)])
            other = ids[found] != own
            found, score = ids[found][other], score[other]
            best = np.lexsort((found, -score))[:top]
            out.append((np.full(len(best), own), found[best], score[best]))
    return tuple(np.concatenate(part) for part in zip(*out))


def search(embeddings: DataFrame, every: int = 20, top: int = 20, rerank: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` its `top` largest inner products among other rows.

    Takes no part: rows whose id is null, whose vector is null, zero, holds a null, NaN or infinite component, or has
    another dimension than most. Rows that repeat an id count once, with the smallest of their vectors. Of equal vectors
    only the top + 1 with the smallest ids are looked at, as no more can be among the nearest. Ties go to
    the smaller id; an empty table gives an empty result; further columns are left out.
    """
    spark = embeddings.sparkSession
    ship(spark)
    space = Workspace(spark, "ann")
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size(v) == sizes.d)
    if sizes.n > sizes.ids:
        rows = space.keep(rows.groupBy("id").agg(F.min("v").alias("v")), "rows")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    quantiser = spark.sparkContext.broadcast(fit(np.array([r.v for r in sorted(sample)])))  # fixed size
    d, first = sizes.d, rerank or shortlist_size(sizes.ids, top)
    first = max(first, top + 1)
    blocks, asking = -(-sizes.ids // max(1, BLOCK_CELLS // d)), -(-sizes.ids // every)
    query_blocks = max(-(-asking // QUERY_BLOCK), min(-(-asking // STEP), -(-PIECES // blocks)))
    # as narrow as the column that is read
    width = np.float32 if embeddings.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64

    def encode(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            codes = quantiser.value.encode(x) if len(x) else np.zeros((0, 2), np.int64)
            off = quantiser.value.off(x, codes).astype(np.float32) if len(x) else np.zeros(0, np.float32)
            codes = codes.astype(np.uint8)
            if codes.shape[1] % 2:
                codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
            codes = codes[:, 0::2] | (codes[:, 1::2] << 4)
            held = [pa.array([c.tobytes() for c in part], pa.binary()) for part in (codes, x.astype(width))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(off), *held], ["id", "same", "off", "codes", "v"])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        joined = lambda c: b"".join(group.column(c).to_pylist())
        return pa.table({"block": group.column("block")[:1], "ids": pa.array([group.column("id").to_numpy().tobytes()], pa.binary()), "codes": pa.array([joined("codes")], pa.binary()), "off": pa.array([group.column("off").to_numpy().tobytes()], pa.binary()), "v": pa.array([joined("v")], pa.binary())})

    def pack_queries(group: pa.Table) -> pa.Table:
        x = group.column("v").combine_chunks().flatten().to_numpy()
        return pa.table({"other": group.column("other")[:1], "query_ids": pa.array([group.column("id").to_numpy().tobytes()], pa.binary()), "queries": pa.array([x.tobytes()], pa.binary())})

    def scan(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, codes, off, v, query_ids, queries = (np.frombuffer(batch.column(k)[row].as_buffer(), t) for k, t in enumerate((np.int64, np.uint8, np.float32, width, np.int64, np.float64)))
                packed = codes.reshape(len(ids), -1)
                codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(ids), -1)[:, : (d + 1) // 2]
                found = best_of_block(quantiser.value, ids, codes, off, v.reshape(-1, d), query_ids, queries.reshape(-1, d), first, top)
                yield pa.RecordBatch.from_arrays([pa.array(part) for part in found], ["query_id", "vec_id", "score"])

    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    coded = rows.select("id", "v", F.xxhash64("v").alias("same")).mapInArrow(encode, "id long, same long, off float, codes binary, v binary")
    copy = F.row_number().over(Window.partitionBy("same").orderBy("id"))
    coded = coded.withColumn("copy", copy).where(F.col("copy") <= top + 1)
    left = coded.select(place(blocks).alias("block"), "id", "codes", "off", "v").groupBy("block").applyInArrow(pack, "block int, ids binary, codes binary, off binary, v binary")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = rows.where(F.col("id") % every == 0)
    right = asked.select(place(query_blocks).alias("other"), "id", "v").groupBy("other").applyInArrow(pack_queries, "other int, query_ids binary, queries binary")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = left.join(right, ["block", "other"]).select("ids", "codes", "off", "v", "query_ids", "queries")
    found = met.mapInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

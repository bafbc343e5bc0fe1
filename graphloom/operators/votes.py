"""The most frequent label around each node, counted in buckets of packed neighbourhoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, ship

#: Ends of edges in a bucket, about.
VOTES = 1 << 22


def neighbourhoods(links: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Neighbourhoods (a, b, distinct, every a with itself) packed by a bucket of a, and the nodes (bucket, id) that each bucket asks for."""
    ship(links.sparkSession)
    links = kept(links.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(max(1, buckets))).cast("int")), "links")

    def pack(group: pa.Table) -> pa.Table:
        """Ends as places among the ids asked for: sorted by the voter, steps from one to the next in two planes, of which the upper is mostly zeros."""
        a, b = (group.column(c).to_numpy() for c in ("a", "b"))
        names, to = np.unique(b, return_inverse=True)
        who = np.searchsorted(names, a)
        order = np.lexsort((to, who))
        voters, n = np.unique(who, return_counts=True)
        steps = np.diff(to[order], prepend=0).astype(np.int32).view(np.uint32)
        planes = (steps & 0xFFFF).astype(np.uint16).tobytes() + (steps >> 16).astype(np.uint16).tobytes()
        return pa.table({"bucket": group.column("bucket")[:1], "voters": [voters.astype(np.int32).tobytes()], "n": [n.astype(np.int32).tobytes()], "steps": [planes]})

    packed = links.groupBy("bucket").applyInArrow(pack, "bucket int, voters binary, n binary, steps binary")
    return kept(packed, "near"), kept(links.select("bucket", F.col("b").alias("id")).distinct(), "asked")


def voted(near: DataFrame, asked: DataFrame, labels: DataFrame) -> DataFrame:
    """id, community, new: the most frequent community around each node, ties to the smaller."""

    def count(packed: pa.Table, told: pa.Table) -> pa.Table:
        get = lambda name, kind: np.frombuffer(packed.column(name)[0].as_buffer(), kind)
        voters, n, planes = get("voters", np.int32), get("n", np.int32), get("steps", np.uint16)
        low, high = planes[: len(planes) // 2].astype(np.uint32), planes[len(planes) // 2 :].astype(np.uint32)
        to = np.cumsum((low | high << np.uint32(16)).view(np.int32), dtype=np.int64)
        told = told.sort_by("id")
        names, codes = np.unique(told.column("community").to_numpy(), return_inverse=True)
        found, votes = np.unique(np.repeat(np.arange(len(voters)), n) * len(names) + codes[to], return_counts=True)
        order = np.lexsort((found, -votes, found // len(names)))
        voter = found[order] // len(names)
        first = order[np.flatnonzero(np.diff(voter, prepend=-1))]
        mine = told.select(["id", "community"]).take(pa.array(voters))
        new = told.column("community").take(pa.array(np.unique(codes, return_index=True)[1][found[first] % len(names)]))
        return pa.table({"id": mine.column("id"), "community": mine.column("community"), "new": new})

    kind = labels.schema["id"].dataType.simpleString()
    told = asked.join(labels, "id").select("bucket", "id", "community")
    return near.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(count, f"id {kind}, community {kind}, new {kind}")

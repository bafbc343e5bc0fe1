"""Removal of every byte covered by a string of SPAN bytes that also starts elsewhere, by sorting suffixes.

Sorting the suffix at every byte would move the corpus many times over, so suffixes are first thinned without loss:

1. A window is a start of SPAN bytes. Its anchor is the GRAM bytes in it with the smallest hash; equal windows have equal
   anchors at equal distance. Windows with the same anchor form a run (about one for every hundred bytes). Runs whose
   anchor occurs once in the corpus cannot repeat and go.
2. Runs that are equal as a whole (their bytes by a 128-bit hash) are repeats. They are counted with partial
   sums and one of each goes on, so large groups of copies cost nothing further.
3. What differs within an anchor's group is sorted: suffixes from the anchor on are range-partitioned by their leading
   bytes with sampled splitters (equal leading bytes never part, so nothing straddles a boundary), and each bucket
   sorts them by multikey quicksort on tokens of eight bytes, which also gives common prefix lengths; what stands
   before the anchor is sorted likewise, backwards. A window repeats if another has its class in both orders.
4. Repeats are joined to intervals of each text and cut out.

Anchors with more than HOT different runs are not gathered: their windows are counted by a 128-bit hash instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ship

SPAN, GRAM = 400, 200
HOT = 20_000
BATCH_ROWS = 20_000
_NO_ID = -(1 << 63)
SEGMENT = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and those of its inverse, modulo 2**64."""
    if not _powers:
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                a = np.full(SEGMENT + 2 * SPAN + 2, b, np.uint64)
                a[0] = 1
                pair.append(np.cumprod(a))
            _powers.append(tuple(pair))
    return _powers


class Hashed:
    """Hashes of any stretch of some bytes, by two bases."""

    def __init__(self, data: np.ndarray):
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: data.size])]) for p, _ in powers()]

    def of(self, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        return _mix((self.sums[base][end] - self.sums[base][begin]) * powers()[base][1][begin])


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each m neighbours, by running minima of blocks from both sides."""
    n = x.size - m + 1
    padded = np.concatenate([x, np.full(-x.size % m, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, m)
    forth = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[m - 1 : m - 1 + n])


def runs_of(data: bytes):
    """lo, hi, gram, two hashes: the starts lo..hi of SPAN bytes whose smallest GRAM bytes (by hash, then place) are the same piece of the text."""
    whole = np.frombuffer(data, np.uint8)
    out = []
    for at in range(0, whole.size - SPAN + 1, SEGMENT):
        part = whole[at : at + SEGMENT + SPAN - 1]
        hashed = Hashed(part)
        place = np.arange(part.size - GRAM + 1)
        gram = hashed.of(place, place + GRAM, 0)
        low = sliding_min((gram & np.uint64(0xFFFFFFFFFF000000)) | place.astype(np.uint64), SPAN - GRAM + 1)
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        hi = np.append(lo[1:], anchor.size) - 1
        out.append((lo + at, hi + at, gram[anchor[lo]], hashed.of(lo, hi + SPAN, 0), hashed.of(lo, hi + SPAN, 1)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))


def multikey_order(tokens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group, then by tokens (big-endian words of a string), and how many bytes each has in common with the row before it (0 for the first of a group).

    Multikey quicksort, all parts at once: each round parts what is still equal by its next token, and what is alone rests.
    """
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.append(0, group[order][1:] != group[order][:-1])) if order.size else order
    common = np.full(order.size, 8 * tokens.shape[1])
    if order.size:
        common[np.append(True, part[1:] != part[:-1])] = 0
    for k in range(tokens.shape[1]):
        size = np.bincount(part)
        at = np.flatnonzero(size[part] > 1)
        if not at.size:
            break
        word = tokens[order[at], k]
        inner = np.lexsort((word, part[at]))
        order[at], word = order[at][inner], word[inner]
        new = np.flatnonzero((word[1:] != word[:-1]) & (part[at][1:] == part[at][:-1])) + 1
        same = np.zeros(new.size, np.int64)
        for byte in range(7):
            same += (word[new] >> np.uint64(56 - 8 * byte) == word[new - 1] >> np.uint64(56 - 8 * byte)) & (same == byte)
        common[at[new]] = 8 * k + same
        step = np.zeros(part.size, np.int64)
        step[at[new]] = 1
        part = part + np.cumsum(step)
    return order, common


def _words(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in rows), ">u8").reshape(len(rows), -1).astype(np.uint64)


def repeated(group: np.ndarray, rows: list[bytes], before: np.ndarray, known: np.ndarray, gram: int = GRAM, span: int = SPAN) -> list[tuple[int, int]]:
    """(row, start) of the windows that occur in another row of the group too.

    rows: the bytes of runs; before: how many stand before the anchor; known rows count as partners but are not reported.
    """
    n = len(rows)
    right = _words([r[b:] for r, b in zip(rows, before)], -(-span // 8) * 8)
    width = -(-(span - gram) // 8) * 8
    left = _words([r[:b][::-1] for r, b in zip(rows, before)], max(8, width))
    classes = []
    for words in (left, right):
        order, common = multikey_order(words, group)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        classes.append((common, place))
    most = np.array([len(r) - span for r in rows])  # last start within the run
    index = np.arange(n)
    out = []
    for o in range(span - gram + 1):
        valid = np.flatnonzero((before - most <= o) & (o <= before))
        if valid.size < 2:
            continue
        key = np.zeros(valid.size, np.int64)
        for (common, place), depth in zip(classes, (o, span - o)):
            # rows with no bytes to compare still part by group
            new = common < depth if depth else np.append(True, group[np.argsort(place)][1:] != group[np.argsort(place)][:-1])
            start = np.maximum.accumulate(np.where(new, index, 0))
            key = key * n + start[place[valid]]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = valid[(count[inverse] > 1) & ~known[valid]]
        out += [(int(r), int(before[r] - o)) for r in hit]
    return out


def joined(starts: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers."""
    s = np.unique(np.array(starts, np.int64))
    cut = np.flatnonzero(np.diff(s) > 1) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(s, cut)]


def _find_runs(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, ties = batch.column(0), batch.column(1)
        take, found = [], []
        for k, text in enumerate(batch.column(2)):
            got = runs_of((text.as_py() or "").encode())
            take.append(np.full(len(got[0]), k))
            found.append(got)
        take = pa.array(np.concatenate(take))
        lo, hi, gram, x, y = (np.concatenate(c) for c in zip(*found))
        yield pa.RecordBatch.from_arrays([ids.take(take), ties.take(take), *(pa.array(c.view(np.int64)) for c in (lo, hi, gram, x, y))], ["id", "tie", "lo", "hi", "gram", "x", "y"])


def _cut_runs(batches):
    """The bytes of each wanted run; of hot anchors a hash for each window instead."""
    schema = ["gram", "lead", "bytes", "before", "known", "id", "tie", "lo", "h1", "h2"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out = []
        for key, tie, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
            data = (text or "").encode()
            for w in wanted:
                piece = data[w["lo"] : w["hi"] + SPAN]
                part = np.frombuffer(piece, np.uint8)
                hashed = Hashed(part)
                if w["hot"]:
                    at = np.arange(w["hi"] - w["lo"] + 1)
                    for k, a, b in zip(at.tolist(), hashed.of(at, at + SPAN, 0).view(np.int64).tolist(), hashed.of(at, at + SPAN, 1).view(np.int64).tolist()):
                        out.append((w["gram"], None, None, None, w["known"], key, tie, w["lo"] + k, a, b))
                    continue
                place = np.arange(part.size - GRAM + 1)
                before = int(np.flatnonzero(hashed.of(place, place + GRAM, 0).view(np.int64) == w["gram"])[0])
                out.append((w["gram"], piece[before : before + 16], piece, before, w["known"], key, tie, w["lo"], None, None))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema)


def _sort_bucket(batches):
    """Intervals of repeated starts, from runs that lie in order of their anchors."""

    def answer(held):
        number = {}
        group = np.array([number.setdefault((r[0], r[1]), len(number)) for r in held])
        found: dict[int, list[int]] = {}
        for r, start in repeated(group, [r[2] for r in held], np.array([r[3] for r in held]), np.array([r[4] for r in held])):
            found.setdefault(r, []).append(start)
        rows = [(held[r][5], held[r][6], held[r][7] + a, held[r][7] + b) for r, starts in found.items() for a, b in joined(starts)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((),) * 4)], ["id", "tie", "lo", "hi"])

    held, last = [], None
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if len(held) >= BATCH_ROWS and (row[0], row[1]) != last:
                yield answer(held)
                held = []
            held.append(row)
            last = (row[0], row[1])
    if held:
        yield answer(held)


def _remove(batches):
    for batch in batches:
        out = []
        for key, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = (text or "").encode()
            keep, at, n, removed, begin = [], 0, 0, 0, None
            end = 0
            for lo, hi in sorted((s["lo"], s["hi"] + SPAN) for s in spans or ()):
                if begin is None or lo > end:
                    if begin is not None:
                        n, removed = n + 1, removed + end - begin
                        keep.append(data[at:begin])
                        at = end
                    begin, end = lo, hi
                else:
                    end = max(end, hi)
            if begin is not None:
                n, removed = n + 1, removed + end - begin
                keep.append(data[at:begin])
                at = end
            kept = b"".join([*keep, data[at:]])
            out.append((key, len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out)) if out else [()] * 6
        types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for each row.

    Null texts count as empty. Matches never cross rows; rows that repeat are copies like any others and lose what they
    share, both. Ids may be null or repeat. An empty table gives an empty result; further columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "suffix-dedup")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    runs = rows.select("id", "tie", "text").mapInArrow(_find_runs, "id long, tie long, lo long, hi long, gram long, x long, y long")
    runs = space.keep(runs, "runs")
    again = space.keep(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    runs = space.keep(runs.join(again, "gram", "left_semi"), "repeated")
    kinds = runs.groupBy("gram", "x", "y").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "tie", "lo", "hi")).alias("one"))
    kinds = space.keep(kinds, "kinds")
    groups = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = kinds.where("copies > 1").select("gram", "x", "y")
    equal = runs.join(several, ["gram", "x", "y"], "left_semi").select("id", "tie", "lo", "hi")
    apart = kinds.join(groups, "gram").select("one.id", "one.tie", F.struct("gram", "one.lo", "one.hi", (F.col("copies") > 1).alias("known"), (F.col("n") > hot).alias("hot")).alias("run"))
    wanted = apart.groupBy("id", "tie").agg(F.collect_list("run").alias("wanted"))
    cut = rows.join(wanted, ["id", "tie"]).select("id", "tie", "text", "wanted")
    cut = cut.mapInArrow(_cut_runs, "gram long, lead binary, bytes binary, before int, known boolean, id long, tie long, lo long, h1 long, h2 long")
    cut = space.keep(cut, "cut")
    bucketed = cut.where("bytes is not null").drop("h1", "h2").repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram")
    sorted_ = bucketed.select("gram", "lead", "bytes", "before", "known", "id", "tie", "lo").mapInArrow(_sort_bucket, "id long, tie long, lo long, hi long")
    windows = cut.where("h1 is not null")
    twice = windows.groupBy("gram", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hashed = windows.where("not known").join(twice, ["gram", "h1", "h2"], "left_semi").select("id", "tie", "lo", F.col("lo").alias("hi"))
    spans = equal.unionByName(sorted_).unionByName(hashed).groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = space.keep(spans, "spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, ["id", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

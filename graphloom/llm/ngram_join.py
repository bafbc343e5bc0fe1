"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. A map over partitions hashes each text's shingles in numpy and makes a key of the whole set and a MinHash
   signature. Texts with equal sets are one class from here on.
2. Fixed LSH banding, in place of an LSH forest: each of TREES parts of a signature gives one key, the hash of its
   first values. Their number is one constant, the largest at which the recall expected at the threshold reaches the
   target; no prefix is shortened by rows. Classes that share a key are candidates. Buckets become stars around
   their smallest class, and stars components.
3. The shingles of each class in a component are made again and meet in pairs of blocks of at most BLOCK classes;
   every pair is verified exactly in numpy. Blocks send on counts and a spanning forest, never pairs.
4. Verified links are joined to components; counts are summed.

A bucket or component of any size is dealt over pairs of blocks, so no task holds a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh, released, ship
from .graph import components

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.998
BLOCK = 192
CHUNK = 1_500_000
_NO_ID = -(1 << 63)


def depth_for(recall: float = RECALL, similarity: float = SIMILARITY, trees: int = TREES, full: int = DEPTH) -> int:
    """The longest prefix at which two texts of that similarity meet in some tree with at least that probability."""
    depth = full
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text, sorted, one text after the other, and how many each has.

    Words are runs without blanks. A text of one to four words is one shingle, a text without words has none.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power = np.full(joined.size, _P)
    power[0] = 1
    inverse = np.full(joined.size, _P_INVERSE)
    inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power)])
    word = _mix((h[ends] - h[starts]) * inverse[starts]) if starts.size else np.zeros(0, np.uint64)
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    per_doc = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((per_doc > 0) & (per_doc < WORDS))
    out, owner = [], []
    if word.size >= WORDS:
        n = word.size - WORDS + 1
        total = np.zeros(n, np.uint64)
        for k in range(WORDS):
            total += word[k : k + n] * _STEPS[k]
        inside = doc[:n] == doc[WORDS - 1 :]
        out.append(_mix(total[inside]))
        owner.append(doc[:n][inside])
    begin = np.cumsum(per_doc) - per_doc
    for k in short:
        w = word[begin[k] : begin[k] + per_doc[k]]
        out.append(_mix(np.array([np.sum(w * _STEPS[: w.size]) + np.uint64(w.size)], np.uint64)))
        owner.append(np.array([k]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    value, owner = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    return value[first], np.bincount(owner[first], minlength=len(texts))


def set_keys(value: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, equal for equal sets; None for empty ones."""
    has = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[has]
    out: list[bytes | None] = [None] * len(n)
    if has.size:
        a, b = (np.add.reduceat(_mix(value * s), starts) for s in _STEPS[:2])
        for k, x, y in zip(has.tolist(), a.byteswap().tolist(), b.byteswap().tolist()):
            out[k] = x.to_bytes(8, "little") + y.to_bytes(8, "little")
    return out


def prefixes(value: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """For each non-empty set and tree a hash of the first `depth` MinHashes."""
    has = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[has]
    rng = np.random.default_rng(11)
    out = np.zeros((len(has), TREES), np.uint64)
    for tree in range(TREES):
        odd = rng.integers(0, 1 << 63, DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, DEPTH, np.uint64)
        for level in range(depth):
            low = np.minimum.reduceat((value * odd[level] + add[level]) >> np.uint64(20), starts)
            out[:, tree] = _mix(out[:, tree] * _P + low + np.uint64(level))
    return out


def _chunks(texts: list[str | None]):
    begin = 0
    while begin < len(texts):
        end, size, part = begin, 0, []
        while end < len(texts) and (end == begin or size < CHUNK):
            part.append((texts[end] or "").encode())
            size += len(part[-1])
            end += 1
        yield begin, part
        begin = end


def _keyed(depth: int):
    def run(batches):
        for batch in batches:
            keys, trees = [], []
            for _, part in _chunks(batch.column(1).to_pylist()):
                value, n = shingles(part)
                own = set_keys(value, n)
                forest = iter(prefixes(value, n, depth))
                keys += own
                trees += [None if k is None else next(forest).view(np.int64) for k in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(trees, pa.list_(pa.int64()))], ["id", "tie", "key", "trees"])

    return run


def _sets(batches):
    """(root, key, copies, blocks, shingles) of rows whose text has the set of that key."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        keep, sets = [], []
        for begin, part in _chunks(columns[4]):
            value, n = shingles(part)
            ends = np.cumsum(n)
            for k, (own, a, b) in enumerate(zip(set_keys(value, n), ends - n, ends)):
                if own == columns[1][begin + k]:
                    keep.append(begin + k)
                    sets.append(value[a:b].tobytes())
        picked = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(picked) for k in range(4)), pa.array(sets, pa.binary())], ["root", "key", "copies", "blocks", "shingles"])


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of the sets (arrays of different hashes) have that Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    shared = np.zeros((len(sets), len(sets)), np.float32)
    if len(sets) <= 3:
        for i in range(len(sets)):
            for j in range(i):
                shared[i, j] = shared[j, i] = np.intersect1d(sets[i], sets[j], assume_unique=True).size
    else:
        owner = np.repeat(np.arange(len(sets)), size)
        _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = count[number] > 1
        place = np.cumsum(count > 1) - 1
        owner, number = owner[common], place[number[common]]
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        cuts = np.searchsorted(number, np.arange(0, (number[-1] if number.size else -1) + 4097, 4096))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            m = np.zeros((len(sets), 4096), np.float32)
            m[owner[a:b], number[a:b] - 4096 * k] = 1
            shared += m @ m.T
    union = size[:, None] + size[None, :] - shared
    out = shared.astype(np.float64) >= similarity * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def _verify(similarity: float):
    def group(i: int, j: int, rows: list[tuple]):
        rows = list({r[0]: r for r in rows}.values())
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        block = np.array([r[3] for r in rows])
        ok = linked(sets, similarity)
        if i != j:  # pairs inside a block are another group's
            ok &= block[:, None] != block[None, :]
        copies = np.array([r[1] for r in rows])
        n = ok @ copies
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(*np.nonzero(np.triu(ok))):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [(rows[k][0], int(n[k]), rows[find(k)][0]) for k in range(len(rows)) if n[k]]

    def run(batches):
        key, held, out = None, [], []
        for batch in batches:
            for root, i, j, own, copies, block, packed in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (root, i, j) != key:
                    if len(held) > 1:
                        out += group(key[1], key[2], held)
                    key, held = (root, i, j), []
                held.append((own, copies, packed, block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "n", "other"])
                out = []
        if len(held) > 1:
            out += group(key[1], key[2], held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "n", "other"])

    return run


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, text_hash, class_key for each row: the smallest id of its group (texts joined by links) and its number of links.

    class_key tells groups apart whatever their ids; it is null for texts without words.

    A link joins two rows whose shingle sets are alike by `similarity`; equal sets have similarity 1, so repeated rows
    and copies link. Texts without words (null, empty, blank) have no links and their own id as class. A null id is
    reported as null and as class only where no other id is in the group. An empty table gives an empty result;
    further columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "ngram-join")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    depth = depth_for(recall, similarity)
    keyed = space.keep(rows.mapInArrow(released(_keyed(depth)), "id long, tie long, key binary, trees array<long>"), "keyed")
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    classes = keyed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(real("id")).alias("first"), F.min(F.struct("id", "tie")).alias("some"))
    classes = space.keep(classes, "classes")
    buckets = keyed.where("key is not null").select("key", F.posexplode("trees").alias("tree", "prefix"))
    stars = buckets.groupBy("tree", "prefix").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").drop("high")
    stars = buckets.join(stars, ["tree", "prefix"]).where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    near = space.keep(components(stars, space), "near")
    counts = near.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = near.join(counts, "root").join(classes, near["node"] == classes["key"])
    members = members.select("root", "key", "copies", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), "some.id", "some.tie")
    # one text of each class, found by id and text together, as ids may be null or repeat
    texts = rows.select("id", F.col("text_hash").alias("tie"), "text")
    members = members.join(texts, ["id", "tie"]).dropDuplicates(["id", "tie"]).select("root", "key", "copies", "blocks", "text")
    sets = members.mapInArrow(released(_sets), "root binary, key binary, copies long, blocks int, shingles binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("root", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "key", "copies", "block", "shingles")
    sets = sets.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = space.keep(sets.mapInArrow(released(_verify(similarity)), "key binary, n long, other binary"), "links")
    groups = components(links.select(F.col("key").alias("a"), F.col("other").alias("b")), space)
    groups = groups.join(classes, groups["node"] == classes["key"]).select("root", "key", "first")
    groups = groups.join(groups.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("root", "key", "class_id")
    others = links.groupBy("key").agg(F.sum("n").alias("n"))
    found = classes.join(groups, "key", "left").join(others, "key", "left")
    found = found.select("key", F.coalesce("root", "key").alias("class_key"), F.coalesce("class_id", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return keyed.select("id", "tie", "key").join(found, "key", "left").select(
        real("id").alias("doc_id"), F.when(F.col("key").isNull(), real("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("tie").alias("text_hash"), F.lower(F.hex("class_key")).alias("class_key")
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group stays: that with the smallest id, of one id by a hash of the text.

    Null ids come last. Texts without words are no group and stay. Of rows that repeat id and text one stays. Columns may have any names;
    an empty table gives an empty result.
    """
    id_, hash_, k_ = fresh(docs, "id", "hash", "k")
    found = join(docs, similarity, recall, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text_hash", "class_key")
    first = found.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct((F.col("id") == _NO_ID).alias("last"), "id", "text_hash")).alias("one")).select("one.id", "one.text_hash")
    first = first.union(found.where("class_key is null").select("id", "text_hash").distinct())
    own = docs.withColumn(id_, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))).withColumn(hash_, F.xxhash64(text_col))
    kept = own.join(first.select(F.col("id").alias(id_), F.col("text_hash").alias(hash_)), [id_, hash_], "left_semi")
    return kept.withColumn(k_, F.row_number().over(Window.partitionBy(id_, hash_).orderBy(id_))).where(F.col(k_) == 1).drop(id_, hash_, k_)

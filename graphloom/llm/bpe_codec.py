"""Byte-level BPE encoding and decoding of whole tables.

Encoding sends each distinct pre-token of a block of documents once, to the task that owns its hash (the global
distinct-word shuffle); there every distinct pre-token is encoded once, and its ids go back to the blocks that
asked. What stays of a document meanwhile is, by position, the number of each pre-token in its block's
list. A word that every text holds is thus one entry a block, not one row for each place, and nothing is larger
than a block: tasks stream over messages. A lost executor costs the tasks it ran; the split table is read again.

Decoding looks every id up in the table of token bytes, which has as many rows as the vocabulary and so is
broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Merger, merger_of_ranks, ranks_of
from .common import Workspace, release, released, ship

BLOCK_CHARS = 24_000_000
CACHE_WORDS = 300_000


def _pack(*parts: bytes) -> bytes:
    """Byte strings with their lengths before them, compressed."""
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(parts))


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.append(0, np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))) + 4 * (n + 1)
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _planes(values: np.ndarray) -> list[bytes]:
    """Integers as four strings: all lowest bytes, then the next; these compress well."""
    by = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [by[:, k].tobytes() for k in range(4)]


def _joined(planes: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).copy().view("<u4").ravel().astype(np.int64)


class _Numbers(dict):
    """A number for each different word, in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _split_block(numbers: _Numbers, keys: list, docs: list[np.ndarray], shards: int):
    """A message for each shard of words, then (id, packed numbers) for each document; frequent words get small numbers."""
    seen = np.bincount(np.concatenate(docs), minlength=len(numbers))
    place = np.empty(len(numbers), np.int64)
    place[np.argsort(-seen, kind="stable")] = np.arange(len(numbers))
    owned: dict[int, list[tuple[int, bytes]]] = {}
    for word, n in zip(numbers, place.tolist()):
        owned.setdefault(zlib.crc32(b := word.encode()) % shards, []).append((n, b))
    for shard, pairs in owned.items():
        pairs.sort()
        steps = np.diff(np.array([n for n, _ in pairs]), prepend=0)
        yield shard, None, _pack(*_planes(steps), *_planes(np.array([len(b) for _, b in pairs])), b"".join(b for _, b in pairs))
    for key, words in zip(keys, docs):
        yield -1, key, _pack(*_planes(place[words]))


class _Encoder:
    def __init__(self, file: bytes):
        self.ranks = ranks_of(file)
        self.merger: Merger = merger_of_ranks(self.ranks)
        self.cache: dict[bytes, np.ndarray] = {}

    def ids(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; a word that is a token itself is that token."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        merge = [w for w in new if w not in self.ranks]
        sym, n = self.merger.encode(merge)
        self.cache.update(zip(merge, np.split(sym, np.cumsum(n)[:-1]) if merge else []))
        self.cache.update((w, np.array([self.ranks[w]])) for w in new if w in self.ranks)
        return [self.cache[w] for w in words]


_encoders: dict[tuple, _Encoder] = {}


def _encoder(file: bytes) -> _Encoder:
    key = (len(file), hash(file))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Encoder(file)
    return _encoders[key]


def ragged(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Indices of the runs named by which, one run after the other."""
    n = sizes[which]
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(starts[which] - before, n)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text, without special tokens.

    Null texts count as empty and give an empty array. Rows keep apart even where ids repeat or are null; further
    columns are left out. An empty table gives an empty result. Smaller blocks take less memory and send more words.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shards = max(64, rows.rdd.getNumPartitions())
    if kind != "bigint":
        raise ValueError("ids of documents must be long")
    doc_type = pa.int64()

    def split(batches):
        pieces = regex.compile(pattern)
        block = TaskContext.get().partitionId() << 32

        def flush(numbers, keys, held):
            out = []
            for row in _split_block(numbers, keys, held, shards):
                out.append((block, *row))
                if len(out) == 1024:
                    yield _messages(out, doc_type)
                    out = []
            yield _messages(out, doc_type)

        numbers, keys, held, chars = _Numbers(), [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                words = pieces.findall(text)
                keys.append(key)
                held.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                chars += len(text)
                if chars >= block_chars:
                    yield from flush(numbers, keys, held)
                    numbers, keys, held, chars, block = _Numbers(), [], [], 0, block + 1
        if held:
            yield from flush(numbers, keys, held)

    def answer(batches):
        encoder = _encoder(file.value)
        for batch in batches:
            out = []
            for packed in batch.column(2):
                part = _unpack(packed.as_py())
                sizes, text = _joined(part[4:8]), part[8]
                ends = np.cumsum(sizes).tolist()
                ids = encoder.ids([text[a:b] for a, b in zip([0, *ends[:-1]], ends)])
                out.append(_pack(*part[:4], *_planes(np.array([len(x) for x in ids])), *_planes(np.concatenate(ids))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "packed"])
        encoder.cache.clear()  # other tasks have other words

    def reassemble(docs: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        codes, sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for packed in answers.column("packed"):
            part = _unpack(packed.as_py())
            codes.append(np.cumsum(_joined(part[:4])))
            sizes.append(_joined(part[4:8]))
            ids.append(_joined(part[8:12]).astype(np.int32))
        n, order, ids = np.concatenate(sizes), np.argsort(np.concatenate(codes)), np.concatenate(ids).astype(np.int32)
        starts, n = (np.cumsum(n) - n)[order], n[order]
        out = [ids[ragged(starts, n, _joined(_unpack(packed.as_py())))] for packed in docs.column("packed")]
        return pa.Table.from_batches([_lists(docs.column("doc_id").to_pylist(), out, doc_type)])

    space = Workspace(spark, "bpe")
    split_docs = rows.mapInArrow(released(split), "block long, shard int, doc_id long, packed binary")
    parted = space.keep_bucketed(split_docs, "split", "block", shards)
    asked = parted.where("shard >= 0").select("block", "shard", "packed").repartition("shard")
    answered = asked.mapInArrow(released(answer), "block long, packed binary")
    # the split table is bucketed by block, so only the answers move
    met = parted.where("shard < 0").groupBy("block").cogroup(answered.groupBy("block"))
    return met.applyInArrow(reassemble, "doc_id long, ids array<int>")


def _messages(rows: list[tuple], doc_type) -> pa.RecordBatch:
    b, s, d, p = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(s, pa.int32()), pa.array(d, doc_type), pa.array(p, pa.binary())], ["block", "shard", "doc_id", "packed"])


def _lists(keys: list, rows: list[np.ndarray], doc_type) -> pa.RecordBatch:
    ends = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
    values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys, doc_type), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "ids"])


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """Adds decoded (binary): the bytes of each row's ids, one token's after the other. Null ids give null."""
    spark = encoded.sparkSession
    ship(spark)
    with open(vocabulary_path, "rb") as f:
        ranks = ranks_of(f.read())
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    table = spark.sparkContext.broadcast(tokens)  # one row for each token of the vocabulary
    columns = encoded.columns

    def run(batches):
        text = np.frombuffer(b"".join(table.value), np.uint8)
        sizes = np.array([len(t) for t in table.value])
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column(columns.index("ids"))
            out = []
            for at in range(0, len(lists), 256):
                part = lists.slice(at, 256)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                raw = text[ragged(starts, sizes, ids)].tobytes()
                ends = np.append(0, np.cumsum(sizes[ids]))
                counts = part.value_lengths().to_pylist()
                k = 0
                for n in counts:
                    if n is None:
                        out.append(None)
                        continue
                    out.append(raw[ends[k] : ends[k + n]])
                    k += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*columns, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(released(run), f"{schema}, decoded binary")


def ids_text(ids: str) -> Column:
    """Decimal ids joined by one space."""
    return F.concat_ws(" ", F.col(ids).cast("array<string>"))

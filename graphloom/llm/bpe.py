"""Byte-pair merging over ragged numpy arrays, for many pre-tokens at a time.

Pre-tokens lie one after another in one array of symbols beside an array of the pre-token each belongs to.
In each round every pre-token that can still merge applies its own lowest-rank pair, at all places where
that pair stands and from the left where they overlap. A new symbol takes part only in pairs of a later rank,
so this equals merging one pair at a time.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import regex

NONE = np.int64(1) << 62


class Merger:
    """pairs: (left symbol, right symbol) -> (rank, merged symbol). first: the symbol of each byte."""

    def __init__(self, first: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        key = (left.astype(np.int64) << 32) | right
        order = np.argsort(key, kind="stable")
        self.first = first.astype(np.int64)
        self.key = np.append(key[order], NONE)
        self.rank = np.append(rank[order].astype(np.int64), NONE)
        self.merged = np.append(merged[order].astype(np.int64), 0)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, one word after the other, and the number of symbols of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_seq = [], []
        while sym.size:
            pair = (sym[:-1] << 32) | sym[1:]
            at = np.searchsorted(self.key, pair)
            ok = (self.key[at] == pair) & (seq[:-1] == seq[1:])
            rank = np.append(np.where(ok, self.rank[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, starts)
            low_at = np.repeat(low, np.diff(np.append(starts, sym.size)))
            open_ = low_at < NONE
            if not open_.all():
                done_sym.append(sym[~open_])
                done_seq.append(seq[~open_])
            if not open_.any():
                break
            hit = open_ & (rank == low_at)
            # of places that overlap (one symbol repeated) every second counts, from the left
            place = np.arange(hit.size)
            begins = hit & ~np.append(False, hit[:-1])
            hit &= (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
            at_hit = np.flatnonzero(hit)
            sym[at_hit] = self.merged[at[at_hit]]
            open_[at_hit + 1] = False
            sym, seq = sym[open_], seq[open_]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        seq, sym = np.concatenate(done_seq), np.concatenate(done_sym)
        return sym[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(words))


def ranks_of(tiktoken_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in tiktoken_file.splitlines() if line)}


def merger_of_ranks(ranks: dict[bytes, int]) -> Merger:
    """Any two neighbours whose joined bytes are a token merge, at that token's rank."""
    rows = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                rows.append((a, b, rank))
    left, right, rank = np.array(rows, np.int64).reshape(-1, 3).T
    return Merger(np.array([ranks[bytes([x])] for x in range(256)]), left, right, rank, rank)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next unused code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(rest)}


class JsonVocabulary:
    """A byte-level BPE file of the tokenizers library: merges in order of rank; added tokens stand for themselves in a text."""

    def __init__(self, file: bytes, pattern: str):
        spec = json.loads(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        vocab, rows = model["vocab"], []
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            rows.append((vocab[a], vocab[b], k, vocab[a + b]))
        left, right, rank, merged = np.array(rows, np.int64).T
        letters = byte_letters()
        self.merger = Merger(np.array([vocab[letters[x]] for x in range(256)]), left, right, rank, merged)
        self.pattern = regex.compile(pattern)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how many added tokens stand in it."""
        if self.added is None or not self.added.search(text):
            return self.pattern.findall(text), 0
        parts = self.added.split(text)
        return [w for part in parts for w in self.pattern.findall(part)], len(parts) - 1

"""Token counts by rank-synchronous merging of ragged numpy arrays.

A batch's distinct pre-tokens lie one after another in one symbol array. Each round finds every sequence's lowest-rank
pair and merges all its occurrences at once in all sequences; sequences without a pair left leave the array. What
survives is counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed
from .pretok import REMEMBERED, byte_alphabet, chunks, pretokens

#: Characters of text whose pre-tokens are merged together.
CHUNK = 4 << 20
NONE = np.int64(1 << 40)


class PairTable:
    """(left, right) -> rank and merged symbol, by open addressing in numpy arrays."""

    def __init__(self, left, right, rank, merged):
        self.bits = max(10, int(len(left) * 8).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int64)
        self.merged = np.zeros(size, np.int32)
        left, right, rank, merged = (np.asarray(x, np.int64) for x in (left, right, rank, merged))
        key, slot, todo = self._key(left, right), self._slot(left, right), np.arange(len(left))
        while len(todo):
            free = todo[self.key[slot[todo]] == -1]
            self.key[slot[free]] = key[free]  # of several for one slot the last wins
            won = free[self.key[slot[free]] == key[free]]
            self.rank[slot[won]], self.merged[slot[won]] = rank[won], merged[won]
            todo = np.setdiff1d(todo, won)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = self._key(a, b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair; its rank is NONE if there is no such pair."""
        key, slot = self._key(a, b), self._slot(a, b)
        todo = np.flatnonzero((self.key[slot] != key) & (self.key[slot] != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            todo = todo[(self.key[slot[todo]] != key[todo]) & (self.key[slot[todo]] != -1)]
        return slot


class Merger:
    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(merges)]
        self.table = PairTable(*zip(*ids, strict=True))
        self.first = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int32)
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.known: dict[str, int] = {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive of each (non-empty) word."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq, which = np.repeat(np.arange(len(words)), size), np.arange(len(words))
        while len(sym):
            rank = np.full(len(sym), NONE)
            inside = np.flatnonzero(seq[:-1] == seq[1:])
            slot = self.table.find(sym[inside], sym[inside + 1])
            rank[inside] = self.table.rank[slot]
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(seq)))
            done = low == NONE
            out[which[done]] = length[done]
            hit = (rank == np.repeat(low, length)) & (rank != NONE)
            at = np.flatnonzero(hit)
            # of overlapping occurrences (a run of one symbol) the first, third, ... merge
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.table.merged[self.table.find(sym[at], sym[at + 1])]
            stay = np.repeat(~done, length)
            stay[at + 1] = False
            sym, seq, which = sym[stay], (np.cumsum(~done) - 1)[seq[stay]], which[~done]
        return out

    def batch(self, texts: list[str | None]) -> list[int]:
        parts, owner, out = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            own = [text or ""]
            for special in self.added:  # the library's default: an added token's string is that token
                own = [q for p in own for q in p.split(special)]
            out[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        words, sizes = pretokens(parts)
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(set(words))
        if new:
            self.known.update(zip(new, self.counts([w.encode() for w in new]).tolist(), strict=True))
        ends = np.cumsum(np.concatenate(([0], np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))))
        at = np.cumsum([0, *sizes])
        for i, n in zip(owner, (ends[at[1:]] - ends[at[:-1]]).tolist(), strict=True):
            out[i] += n
        return out


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); tokenizer: a byte-level BPE .json file.

    Every row gives one row. Null and empty texts: no bytes, no tokens. Special strings inside texts count as their
    token. Long texts are counted whole. An empty table gives an empty one; other columns, whatever their names, play no
    part.
    """
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(tokenizer)
        for b in batches:
            for first, texts in chunks(b.column("text"), CHUNK):
                n = own.batch(texts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(texts)), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names)

    return keyed(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Byte-level BPE by replaying merges over a corpus.

A worker gathers the distinct pre-tokens of a stretch of its documents, keeps an inverted index from token pair to the
positions in those words where it stands, and applies the merges present in rank order, each at all its positions at
once; only the two neighbours of a merged place change the index. Words are remembered, so a word is replayed once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed
from .pretok import REMEMBERED, chunks, pretokens

#: Characters of text whose new words are replayed together.
CHUNK = 4 << 20
SHIFT = 20
LOW = (1 << SHIFT) - 1


class Replay:
    def __init__(self, path: str):
        """path: base64 token and rank on each line; ranks are ids."""
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        get = self.rank.get
        self.merges: dict[int, int] = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = get(t[:i]), get(t[i:])
                if a is not None and b is not None:
                    self.merges[a << SHIFT | b] = r
        self.first = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.text = [str(i) for i in range(len(self.token))]
        self.known: dict[str, bytes] = {}

    def words(self, words: list[bytes]) -> list[bytes]:
        """ids (u32, little endian) of each non-empty word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        flat = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        after[start + size - 1], before[start] = -1, -1
        left = np.flatnonzero(after >= 0)
        pair = flat[left] << SHIFT | flat[left + 1]
        order = np.argsort(pair, kind="stable")
        pair, left = pair[order], left[order]
        cut = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else left
        merges = self.merges
        index = {key: at.tolist() for key, at in zip(pair[cut].tolist(), np.split(left, cut[1:]), strict=True) if key in merges}
        heap = [(merges[key], key) for key in index]
        heapify(heap)
        sym, after, before = flat.tolist(), after.tolist(), before.tolist()
        while heap:
            new, key = heappop(heap)
            a, b = key >> SHIFT, key & LOW
            for i in sorted(index.pop(key)):
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                k, h = after[j], before[i]
                after[i] = k
                if k >= 0:
                    before[k] = i
                    touched = new << SHIFT | sym[k]
                    if touched in merges:
                        if touched in index:
                            index[touched].append(i)
                        else:
                            index[touched] = [i]
                            heappush(heap, (merges[touched], touched))
                if h >= 0:
                    touched = sym[h] << SHIFT | new
                    if touched in merges:
                        if touched in index:
                            index[touched].append(h)
                        else:
                            index[touched] = [h]
                            heappush(heap, (merges[touched], touched))
        flat = np.array(sym, np.int64)
        live = flat >= 0
        raw = flat[live].astype("<u4").tobytes()
        ends = np.cumsum(np.add.reduceat(live, start, dtype=np.int64)) * 4 if len(start) else start
        return [raw[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        found, sizes = pretokens(texts)
        new = {w for w in set(found) if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, set(found)
        if new:
            raw = {w: w.encode() for w in new}
            whole = {w: self.rank[r] for w, r in raw.items() if r in self.rank}
            self.known.update((w, np.array([r], "<u4").tobytes()) for w, r in whole.items())
            rest = [w for w in raw if w not in whole]
            if rest:
                self.known.update(zip(rest, self.words([raw[w] for w in rest]), strict=True))
        ids = list(map(self.known.__getitem__, found))
        ends = np.cumsum([0, *sizes]).tolist()
        return [np.frombuffer(b"".join(ids[a:b]), "<u4") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def replay(path: str) -> Replay:
    return Replay(path)


def encoded(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (u32, little endian).

    Every row gives one row; null and empty texts have no ids (both digests are of nothing). No special tokens: their
    strings in a text are text. Long texts are encoded whole. An empty table gives an empty one; other columns, whatever
    their names, play no part.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replay(ranks)
        for b in batches:
            for first, texts in chunks(b.column("text"), CHUNK):
                arrays = own.encode(texts)
                digests, decoded = [], []
                for a in arrays:
                    ids = a.tolist()
                    digests.append(hashlib.sha256(" ".join(map(own.text.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(texts)), pa.array([len(a) for a in arrays], pa.int64()), pa.array(digests), pa.array(decoded), pa.array([a.tobytes() for a in arrays], pa.binary())], names)

    return keyed(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")

"""Harmonic packing of token sequences.

Class k takes pieces of length in (C/(k+1), C/k], k to a bin of capacity C. Each worker fills its classes' bins alone:
no shuffle and no shared state. As documents may be cut, a document gives whole-capacity pieces first, then the rest is
cut greedily to just C/k (so a full bin of a class wastes under k ids) until it nearly fills a class or is short. What a
worker's open bins hold at its end is packed first-fit decreasing, and its last sequence is cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed
from .pretok import chunks, library_encoder

#: A piece may leave this share of its class's room empty, else it is cut.
SLACK = 1 / 64
#: Classes go to this k; shorter pieces join it.
CLASSES = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n ids, in order."""
    out = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left:
        k = min(capacity // left, CLASSES)  # its class, if it stays whole
        room = capacity // k
        smaller = capacity // (k + 1)
        if room - left <= room * SLACK or k == CLASSES or smaller == 0:
            out.append((left, k))
            break
        out.append((smaller, k + 1))
        left -= smaller
    return out


class Worker:
    """One worker's open bins; add() and close() yield finished sequences as lists of pieces (doc, start, ids, total)."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, defaultdict(list)

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        at = 0
        for length, k in cuts(len(ids), self.capacity):
            bin_ = self.open[k]
            bin_.append((doc, at, ids[at : at + length], len(ids)))
            at += length
            if len(bin_) == k:
                yield self.open.pop(k)

    def close(self) -> Iterator[list]:
        """At most k - 1 pieces of each class are left, so this is bounded."""
        left = sorted((p for bin_ in self.open.values() for p in bin_), key=lambda p: -len(p[2]))
        bins: list[list] = []
        room = np.zeros(0, np.int64)
        for p in left:
            fit = np.flatnonzero(room >= len(p[2]))
            if not len(fit):
                bins.append([]), (room := np.append(room, self.capacity))
                fit = [len(bins) - 1]
            bins[fit[0]].append(p)
            room[fit[0]] -= len(p[2])
        # bins with room left are joined and cut anew: full sequences, then one for each power of two
        yield from (b for b, r in zip(bins, room, strict=True) if r <= self.capacity * SLACK)
        loose = [p for b, r in zip(bins, room, strict=True) if r > self.capacity * SLACK for p in b]
        total = sum(len(p[2]) for p in loose)
        sizes = [self.capacity] * (total // self.capacity) + [1 << i for i in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> i & 1]
        queue = loose[::-1]
        for size in sizes:
            out = []
            while size:
                doc, start, ids, n = queue.pop()
                if len(ids) > size:
                    queue.append((doc, start + size, ids[size:], n))
                    ids = ids[:size]
                out.append((doc, start, ids, n))
                size -= len(ids)
            yield out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids (u32, little endian).

    Null and empty texts have end_id alone; a null doc_id stays null; every row is a document of its own. Rows with a
    sequence_id make up one sequence, gapless from offset 0. An empty table gives no rows. Long texts are cut as others.
    Columns but doc_id and text, whatever their names, play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = library_encoder(tokenizer)
        worker, sequence, rows = Worker(capacity), TaskContext.get().partitionId() << 32, []

        def placed(finished: Iterator[list]) -> None:
            nonlocal sequence
            for pieces in finished:
                offset = 0
                for doc, start, ids, total in pieces:
                    raw = ids.tobytes()
                    rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw))
                    offset += len(ids)
                sequence += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
            rows.clear()
            return out

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, texts in chunks(b.column("text")):
                for doc, own in zip(ids[first : first + len(texts)], encode(texts), strict=True):
                    placed(worker.add(doc, np.append(own, end_id).astype("<u4")))
                if len(rows) >= 4096:
                    yield batch()
        placed(worker.close())
        if rows:
            yield batch()

    return keyed(docs).mapInArrow(run, SCHEMA)

"""Token ids in rANS-coded blocks (static range asymmetric numeral system).

A token file is a folder: `table` holds the frequency table that all blocks share, `blocks` one row for each block, in
folders part=K in ascending document order. A block holds whole documents and decodes alone: its ids are dealt
round-robin to interleaved lanes, each with a 64-bit state that sheds 32-bit words into one stream; every few steps a
checkpoint holds all lanes' states and the stream's position, from which decoding can start; crc32 guards the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keyed, shuffle_width, written
from .pretok import chunks, library_encoder

#: Frequencies sum to 2**PRECISION; states stay in [2**31, 2**63).
PRECISION = 20
LOW = np.uint64(1 << 31)
#: About 400 kB a row of 16-bit ids: small enough for the JVM to move about like other objects.
BLOCK_IDS = 200_000
LANES = 2048
#: Steps (of one id for each lane) between checkpoints.
CHECKPOINT_STEPS = 64


class Coder:
    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        """ids: ascending; freq: of each, summing to 2**PRECISION."""
        size = int(ids[-1]) + 1 if len(ids) else 0
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        # of each id: frequency in the upper half, sum of those before in the lower; one look-up gives both
        self.slots = np.zeros(size, np.uint64)
        self.slots[ids] = freq.astype(np.uint64) << np.uint64(32) | (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(ids.astype(self.kind), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> dict:
        n, ids = len(ids), np.asarray(ids, self.kind)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, int, bytes]] = []
        count, low32, shift, up = 0, np.uint64(0xFFFFFFFF), np.uint64(63 - PRECISION), np.uint64(PRECISION)
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            slot, now = self.slots.take(s), x[: len(s)]
            f = slot >> np.uint64(32)
            full = np.flatnonzero(now >= f << shift)
            words.append((now[full] & low32).astype(np.uint32))
            count += len(full)
            now[full] >>= np.uint64(32)
            q = now // f
            x[: len(s)] = (q << up) + (now - q * f) + (slot & low32)
            if t and t % CHECKPOINT_STEPS == 0:
                marks.append((t, count, x.astype("<u8").tobytes()))
        stream = np.concatenate(words[::-1]).astype("<u4") if words else np.zeros(0, "<u4")
        marks = [(0, count, x.astype("<u8").tobytes()), *marks[::-1]]
        return {"n_ids": n, "lanes": lanes, "stream": stream.tobytes(), "mark_step": [m[0] for m in marks], "mark_word": [count - m[1] for m in marks], "mark_states": b"".join(m[2] for m in marks), "crc32": zlib.crc32(ids)}

    def decode(self, b: dict, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the block's checkpoints first..last-1 (all by default)."""
        n, lanes = b["n_ids"], b["lanes"]
        last = len(b["mark_step"]) if last is None else last
        end = b["mark_step"][last] if last < len(b["mark_step"]) else -(-n // lanes)
        begin, at = b["mark_step"][first], b["mark_word"][first]
        x = np.frombuffer(b["mark_states"], "<u8", lanes, first * lanes * 8).astype(np.uint64)
        stream = np.frombuffer(b["stream"], "<u4")
        mask, up, low32 = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(0xFFFFFFFF)
        out = np.empty(max(0, min(n, end * lanes) - begin * lanes), self.kind)
        for t in range(begin, end):
            m = min(lanes, n - t * lanes)
            now = x[:m]
            low = now & mask
            s = self.symbol.take(low.view(np.int64))
            slot = self.slots.take(s)
            now = (slot >> np.uint64(32)) * (now >> up) + low - (slot & low32)
            need = np.flatnonzero(now < LOW)
            now[need] = (now[need] << np.uint64(32)) | stream[at : at + len(need)]
            at += len(need)
            x[:m] = now
            out[(t - begin) * lanes : (t - begin) * lanes + m] = s
        return out


# crc32 of a block is over its ids in the table's width (little endian)


def quantised(count: np.ndarray) -> np.ndarray:
    """Positive counts scaled to sum to 2**PRECISION, each 1 at least."""
    total, n = 1 << PRECISION, len(count)
    if n > total:
        raise ValueError(f"{n} different ids; a table holds {total}")
    freq = 1 + np.floor(count / count.sum() * (total - n)).astype(np.int64)
    freq[np.argmax(count)] += total - freq.sum()
    return freq


def _encoded(path: str, end_id: int, bounds: np.ndarray):
    """Documents -> (part, doc_id, tie, ids with end_id). Parts are ranges of (doc_id, tie) between the bounds.

    An id that several bounds share holds many rows; those are dealt to its parts by ranges of their text's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path)
        wide = encode.dtype if end_id < 1 << 16 else "<u4"
        end = np.array([end_id], wide).tobytes()
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                b = batch.slice(first, len(texts))
                doc = b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
                tie = b.column("tie").to_numpy()
                low, high = np.searchsorted(bounds, doc), np.searchsorted(bounds, doc, side="right")
                part = low + (tie.astype(np.uint64) * (high - low + 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                ids = [own.astype(wide, copy=False).tobytes() + end for own in encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column("doc_id"), b.column("tie"), pa.array([int(wide[-1])] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["part", "doc_id", "tie", "width", "ids"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded documents in order, a part after another -> blocks of whole documents, with the ids before each in its part.

    A part's last row has no documents but how often the part holds each id.
    """
    part, width, ids, docs, sizes, held, before, block = None, 0, [], [], [], 0, 0, 0
    total = np.zeros(0, np.int64)

    def row(counts: bytes | None = None) -> pa.RecordBatch:
        nonlocal total, ids, docs, sizes, held, before, block
        joined = b"".join(ids)
        if joined:
            total = added(total, np.bincount(np.frombuffer(joined, f"<u{width}")))
        out = pa.RecordBatch.from_pylist([{"part": part, "block": block, "before": before, "doc_ids": docs, "sizes": sizes, "width": width, "ids": joined, "counts": counts}], schema=BLOCKS_ARROW)
        ids, docs, sizes, held, before, block = [], [], [], 0, before + held, block + 1
        return out

    def ended() -> Iterator[pa.RecordBatch]:
        nonlocal total, before, block
        if docs:
            yield row()
        if part is not None:
            yield row(total.astype("<i8").tobytes())
        total, before, block = np.zeros(0, np.int64), 0, 0

    for b in batches:
        for p, doc, w, own in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("width").to_pylist(), b.column("ids"), strict=True):
            if p != part:
                yield from ended()
                part, width = p, w
            own = own.as_py()
            ids.append(own), docs.append(doc), sizes.append(len(own) // w)
            held += sizes[-1]
            if held >= BLOCK_IDS:
                yield row()
    yield from ended()


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = np.pad(a, (0, max(0, len(b) - len(a))))
    a[: len(b)] += b
    return a


BLOCKS = "part int, block int, before long, doc_ids array<long>, sizes array<int>, width int, ids binary, counts binary"
BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("width", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])
CODED = "part int, block int, start long, doc_ids array<long>, sizes array<int>, n_ids long, lanes int, stream binary, mark_step array<int>, mark_word array<int>, mark_states binary, crc32 long"
CODED_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("lanes", pa.int32()), ("stream", pa.binary()), ("mark_step", pa.list_(pa.int32())), ("mark_word", pa.list_(pa.int32())), ("mark_states", pa.binary()), ("crc32", pa.int64())])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for counts in b.column("counts"):
            total = added(total, np.frombuffer(counts.as_py(), "<i8"))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text (null: empty), append end_id to each, and write a token file at path.

    Documents are in ascending doc_id order (nulls first; rows with equal ids by their text's hash). Every row of docs,
    repeated ones too, is a document. An empty table gives a file without blocks. Columns but doc_id
    and text, whatever their names, play no part.
    """
    spark = docs.sparkSession
    rows, parts = keyed(docs), 2 * shuffle_width(spark)
    cuts = rows.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(-(1 << 63))), [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    tie = F.shiftrightunsigned(F.xxhash64("text"), 32)
    encoded = rows.withColumn("tie", tie).mapInArrow(_encoded(tokenizer, end_id, np.array(cuts or [], np.int64)), "part int, doc_id long, tie long, width int, ids binary")
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "tie")
    rows = written(dealt.mapInArrow(_blocks, BLOCKS), "token-blocks", "uncompressed")  # ids hardly shrink, and are read once
    blocks = rows.where("counts is null").drop("counts")
    # both are bounded: by the vocabulary, and by the number of partitions
    table = rows.select("counts").where("counts is not null").mapInArrow(_histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").toPandas()
    before = dict(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))
    ids = table["id"].to_numpy(np.int64)
    freq = quantised(table["n"].to_numpy(np.float64)) if len(ids) else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((ids, freq))
    spark.createDataFrame(list(zip(ids.tolist(), freq.tolist(), strict=True)), "id long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_encoder.cache_clear()  # this worker's words are not needed any more
        coder = Coder(*shared.value)
        for b in batches:
            for r in b.to_pylist():
                own = coder.encode(np.frombuffer(r["ids"], f"<u{r['width']}"))
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("part", "block", "doc_ids", "sizes")} | {"start": before[r["part"]] + r["before"]} | own], schema=CODED_ARROW)

    out = blocks.mapInArrow(coded, CODED).sortWithinPartitions("part", "block")
    out.write.option("compression", "uncompressed").partitionBy("part").parquet(f"{path}/blocks")
    discard(rows)


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (u32, little endian), a row a document.

    All blocks are decoded and checked either way; without with_ids the ids column is null and costs no transfer.
    """
    table = spark.read.parquet(f"{path}/table").orderBy("id").toPandas()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["freq"].to_numpy(np.int64)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            for b in batch.to_pylist():
                ids = coder.decode(b)
                if zlib.crc32(ids) != b["crc32"]:
                    raise ValueError(f"block {b['block']} does not match its checksum")
                ids = ids.astype("<u4")
                ends = np.cumsum(b["sizes"])
                starts = ends - b["sizes"]
                cut = [ids[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                sums = pa.array([zlib.crc32(c) for c in cut], pa.int64())
                cut = pa.array([c.tobytes() for c in cut] if with_ids else [None] * len(cut), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array(starts + b["start"]), pa.array(ends - starts, pa.int64()), sums, cut], names)

    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_digests(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    write_token_file(docs, path, tokenizer, end_id)
    return read_token_file(docs.sparkSession, path, with_ids=False).drop("ids")

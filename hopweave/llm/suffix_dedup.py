"""Removal of repeated byte strings by merging the Burrows-Wheeler columns of shards.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. Only suffixes that can start such a string
are merged: in every LENGTH-byte window the window's smallest K-gram hash (rightmost of equals) is its anchor, which
equal windows share at the same offset. Anchors whose surroundings occur once end there. For the rest, the stretches
around one anchor form a collection, whose shards' columns of preceding bytes are merged by interleave refinement: the
first interleave is shard after shard, all suffixes being empty; the next one, a byte further left, is the stable
partition of the present one by the bytes before it (the collection's Burrows-Wheeler column), and its common prefixes
follow from those of the present one. No suffixes are sorted. Neighbours with a common prefix of LENGTH are the repeated
intervals. Several lengths are read from one merge: anchors belong to windows of the least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shuffle_width, small_batches, written

LENGTH = 400
#: A passage that repeats: PASSAGE bytes or more in a row that stand elsewhere, with WORDS words or LENGTH bytes.
PASSAGE, WORDS = 200, 50
#: Window starts that are anchored together; longer texts take several turns.
TURN = 1 << 20
#: Stretches of one anchor beyond this are compared window by window over the cluster.
HOT = 20_000
#: Stretches that one task merges, about, and shards of documents whose columns it merges.
SHARD, PARTS = 20_000, 64


class Shape:
    """Sizes that follow from the strings' lengths, of which the least has the anchors."""

    def __init__(self, *lengths: int):
        self.lengths = tuple(sorted(set(lengths or (LENGTH,))))
        length, self.most = self.lengths[0], self.lengths[-1]
        self.turn = TURN
        self.length = length
        self.gram = max(1, length * 4 // 25)
        self.near = (length - self.gram) // 2  # offsets up to this have the right seed, others the left one


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    out = h[:-step] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out += h[step:]
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _gram_hashes(data: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For each size the hashes of all strings of that size."""
    h, step, out = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), 1, {}
    while True:
        for s in sizes:
            if step <= s < 2 * step:
                n = max(0, len(data) - s + 1)
                out[s] = h[:n].copy() if s == step else h[:n] * np.uint64(0xFF51AFD7ED558CCD) + (h[s - step :][:n] ^ (h[s - step :][:n] >> np.uint64(31)))
        if len(out) == len(set(sizes)) or len(h) <= step:
            return [out.get(s, np.zeros(0, np.uint64)) for s in sizes]
        h, step = _doubled(h, step), 2 * step


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    grid = np.concatenate((x, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 :][:n])


def stretches(data: bytes, ends: np.ndarray, starts: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Parts one after another, ending at ends -> (first window, windows, bytes, offset of the anchor, seed, digest).

    starts: how many windows of each part are its own; those after them only lend their bytes. Bytes reach to the end of
    the last window of the greatest length, or of the part. Windows that start at most `near` before
    their anchor and others are different stretches; seeds are hashes of what all windows of a stretch hold.
    """
    length, gram, near = shape.length, shape.gram, shape.near
    raw = np.frombuffer(data, np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    if len(raw) < length:
        return none
    grams, right, left = _gram_hashes(raw, [gram, length - near, near + 1 + gram])
    mask = np.uint64((1 << 24) - 1)
    key = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    anchor = (mask - (_sliding_min(key, length - gram + 1) & mask)).astype(np.int64)
    over = np.zeros(len(raw) + 1, np.int32)  # windows that would run into the next text
    sizes = np.diff(np.concatenate(([0], ends)))
    np.add.at(over, ends - sizes + np.minimum(np.maximum(sizes - length + 1, 0), starts), 1)
    np.add.at(over, ends, -1)
    anchor[np.cumsum(over)[: len(anchor)] > 0] = -1
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(cut[1:], len(anchor)) - 1
    live = anchor[cut] >= 0
    at, lo, hi = anchor[cut][live], cut[live], last[live]
    lo0, hi1 = np.maximum(lo, at - near), np.minimum(hi, at - near - 1)
    is0, is1 = lo0 <= hi, lo <= hi1
    first = np.concatenate((lo0[is0], lo[is1]))
    count = np.concatenate((hi[is0], hi1[is1])) - first + 1
    offset = np.concatenate((at[is0], at[is1])) - first
    seed = np.concatenate((right[at[is0]], left[at[is1] - near - 1] ^ np.uint64(0x5851F42D4C957F2D)))
    stop = np.minimum(first + count + shape.most - 1, ends[np.searchsorted(ends, first, side="right")])
    view = memoryview(data)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[f:e], seed=o) for f, e, o in zip(first.tolist(), stop.tolist(), offset.tolist(), strict=True)), np.uint64, len(first))
    return first, count, stop - first, offset, seed, digest


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with equal keys have equal ids and texts."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("k1"), F.xxhash64(F.col("text").cast("string")).alias("k2"), F.col("text").cast("string").alias("text"))


OCCURRENCE = "k1 long, k2 long, lo long, n int, size int, off int, seed long, ctx long"


def _occurrences(shape: Shape):
    names = [c.split()[0] for c in OCCURRENCE.split(", ")]

    def turn(keys: list[tuple[int, int, int]], parts: list[bytes]) -> pa.RecordBatch:
        """keys: (k1, k2, first byte) of each part."""
        ends = np.cumsum([len(p) for p in parts])
        first, count, size, offset, seed, digest = stretches(b"".join(parts), ends, np.full(len(parts), shape.turn), shape)
        own = np.searchsorted(ends, first, side="right")
        k = np.array(keys, np.int64).reshape(-1, 3)[own]
        lo = first - np.concatenate(([0], ends))[own] + k[:, 2]
        ints = [pa.array(x, pa.int32()) for x in (count, size, offset)]
        return pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(lo), *ints, pa.array(seed.view(np.int64)), pa.array(digest.view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, held = [], [], 0
        for b in batches:
            for k1, k2, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), strict=True):
                data = (text.as_py() or "").encode()
                for at in range(0, len(data) - shape.length + 1, shape.turn):
                    part = data[at : at + shape.turn + shape.most - 1]
                    keys.append((k1, k2, at)), parts.append(part)
                    held += len(part)
                    if held >= shape.turn:
                        yield turn(keys, parts)
                        keys, parts, held = [], [], 0
        if parts:
            yield turn(keys, parts)

    return run


def interleaves(group: np.ndarray, data: list[bytes], off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place, from the last to the first: (place, order of the rows that hold it, common prefix with the row before).

    Places are counted from the anchor (off: bytes of a row before it). Rows are in order of group and of their suffixes
    from the place on; prefixes are -1 between groups. The step from one place to the next looks at one byte a row.
    """
    size = np.fromiter(map(len, data), np.int64, len(data))
    start, end = -off, size - off
    at = np.cumsum(size) - size + off  # where each row's anchor is in the bytes of all
    raw = np.frombuffer(b"".join(data), np.uint8)
    rank = np.unique(group, return_inverse=True)[1]
    rank = rank.astype(np.uint16 if rank.max(initial=0) < 1 << 16 else np.int64)
    entering = np.argsort(end, kind="stable")[::-1]
    due, entered = end[entering], 0
    order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for place in range(int(end.max(initial=0)) - 1, int(start.min(initial=0)) - 1, -1):
        upto = int(np.searchsorted(-due, -place, side="left"))  # rows that end here: their suffixes are still empty
        if upto > entered:
            new = np.sort(entering[entered:upto])  # shard after shard
            entered = upto
            both = np.concatenate((new, order))
            old = np.concatenate((np.zeros(len(new), np.int64), np.maximum(prefix, 0)))
            merge = np.argsort(rank[both], kind="stable")
            order, prefix = both[merge], old[merge]
            prefix[np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))] = -1
        stay = np.flatnonzero(start[order] <= place)
        rows = order[stay]
        if not len(rows):
            order, prefix = rows, prefix[:0]
            continue
        column = raw[at[rows] + place]  # the bytes before the suffixes of the present interleave
        by = np.argsort(column, kind="stable")
        by = by[np.argsort(rank[rows[by]], kind="stable")]
        moved, byte, alike = rows[by], column[by], rank[rows[by]]
        same = (alike[1:] == alike[:-1]) & (byte[1:] == byte[:-1])
        fresh = np.where(np.concatenate(([True], alike[1:] != alike[:-1])), -1, 0)
        if same.any():
            was = stay[by]
            pairs = np.stack((was[:-1][same] + 1, was[1:][same] + 1), axis=1).ravel()
            fresh[1:][same] = np.minimum.reduceat(np.append(prefix, 0), pairs)[::2] + 1
        order, prefix = moved, fresh
        yield place, order, prefix


def repeated_windows(group: np.ndarray, data: list[bytes], off: np.ndarray, count: np.ndarray, lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each length and stretch the windows (0: its first) whose string another stretch of its group holds at the same offset."""
    found: list[tuple[list, list]] = [([], []) for _ in lengths]
    for place, order, prefix in interleaves(group, data, off):
        for (rows, windows), length in zip(found, lengths, strict=True):
            alike = prefix >= length
            if not alike.any():
                continue
            interval = np.cumsum(~alike)
            window = off[order] + place
            own = window < count[order]  # after its last window a row only lends its bytes
            several = (np.bincount(interval[own], minlength=interval[-1] + 1) > 1)[interval] & own
            rows.append(order[several]), windows.append(window[several])
    out = []
    for rows, windows in found:
        row, window = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, windows))
        by = np.lexsort((window, row))
        out.append(np.split(window[by], np.searchsorted(row[by], np.arange(1, len(data)))))
    return out


def _ranges(window: np.ndarray, length: int) -> list[dict]:
    if not len(window):
        return []
    cut = np.flatnonzero(np.diff(window) > 1)
    return [{"l": length, "a": int(a), "b": int(b)} for a, b in zip(window[np.append(0, cut + 1)], window[np.append(cut, len(window) - 1)], strict=True)]


RANGES = "array<struct<l:int,a:int,b:int>>"


def _merged(shape: Shape):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["seed", "ctx"]).sort_values("part", kind="stable", ignore_index=True)
        group = pdf["seed"].to_numpy(np.int64)
        windows = repeated_windows(group, pdf["data"].tolist(), pdf["off"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), shape.lengths)
        ranges = [[r for length, w in zip(shape.lengths, of, strict=True) for r in _ranges(w, length)] for of in zip(*windows, strict=True)]
        keep = [i for i, r in enumerate(ranges) if r]
        return pd.DataFrame({"seed": group[keep], "ctx": pdf["ctx"].to_numpy()[keep], "ranges": pd.Series([ranges[i] for i in keep], dtype=object)})

    return run


def _windows(shape: Shape):
    """A hot anchor's stretches -> a row for each window: its offset and its string's digest."""
    names = ["seed", "ctx", "l", "window", "at", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.select(["seed", "ctx", "off", "n", "data"]).to_pylist():
                view = memoryview(r["data"])
                for length in shape.lengths:
                    n = max(0, min(r["n"], len(view) - length + 1))
                    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[i : i + length]) for i in range(n)), np.uint64, n)
                    yield pa.RecordBatch.from_arrays([pa.array([r["seed"]] * n, pa.int64()), pa.array([r["ctx"]] * n, pa.int64()), pa.array([length] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(r["off"] - np.arange(n), pa.int32()), pa.array(digest.view(np.int64))], names)

    return run


def _sliced(shape: Shape):
    names = ["seed", "ctx", "off", "n", "part", "data"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, wanted in zip(b.column("text"), b.column("wanted"), strict=True):
                data, rows = text.as_py().encode(), wanted.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names[:-1], kinds, strict=True)] + [pa.array([data[r["lo"] : r["lo"] + r["size"]] for r in rows], pa.binary())], names)

    return run


def repeated_spans(docs: DataFrame, *lengths: int) -> DataFrame:
    """(k1, k2, spans): for documents (by _keyed) with repeated strings, structs (l, a, b) of the byte spans that strings
    of each length cover, unmerged."""
    spark, shape = docs.sparkSession, Shape(*lengths)
    rows = _keyed(docs)
    found = written(rows.mapInArrow(_occurrences(shape), OCCURRENCE), "suffix-occurrences")
    # written, so that the join's sides are both plain shuffles, of which Spark can split a hot seed's
    more = written(found.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed"), "suffix-seeds")
    cand = written(found.join(more, "seed"), "suffix-candidates")
    discard(found)
    one = cand.groupBy("seed", "ctx").agg(F.count("*").alias("k"), F.min(F.struct("k1", "k2", "lo", "size", "off", "n")).alias("r"))
    one = written(one.select("seed", "ctx", "k", "r.*"), "suffix-contexts")
    several = written(one.groupBy("seed").agg(F.count("*").alias("m")).where("m > 1"), "suffix-several")
    # contexts that occur once, among others of their seed, are compared; those met twice only stand by
    shards = max(shuffle_width(spark), (several.agg(F.sum("m")).first()[0] or 0) // SHARD)
    unlike = one.join(several, "seed").withColumn("part", F.pmod(F.xxhash64("k1"), F.lit(PARTS)).cast("int"))
    wanted = unlike.groupBy("k1", "k2").agg(F.collect_list(F.struct("seed", "ctx", "lo", "size", "off", "n", "part")).alias("wanted"))  # bounded by the text
    asked = rows.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])  # rows with equal keys are equal
    data = written(asked.select("text", "wanted").mapInArrow(_sliced(shape), "seed long, ctx long, off int, n int, part int, data binary"), "suffix-data")
    hot = several.where(F.col("m") > HOT).select("seed")
    calm = data.join(hot, "seed", "left_anti").withColumn("shard", F.pmod("seed", F.lit(shards)))
    partial = calm.groupBy("shard").applyInPandas(_merged(shape), f"seed long, ctx long, ranges {RANGES}")
    windows = data.join(hot, "seed", "left_semi").dropDuplicates(["seed", "ctx"]).mapInArrow(_windows(shape), "seed long, ctx long, l int, window int, at int, digest long")
    twice = windows.groupBy("seed", "l", "at", "digest").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    of_hot = windows.join(twice, ["seed", "l", "at", "digest"]).groupBy("seed", "ctx").agg(F.collect_list(F.struct("l", F.col("window").alias("a"), F.col("window").alias("b"))).alias("ranges"))
    fits = [F.struct(F.lit(x).alias("l"), F.lit(0).alias("a"), (F.least("n", F.col("size") - x + 1) - 1).alias("b")) for x in shape.lengths]
    whole = F.filter(F.array(*fits), lambda r: r["b"] >= 0)
    met = one.where("k > 1").select("seed", "ctx", whole.alias("ranges"))
    single = one.where("k = 1").select("seed", "ctx")
    known = met.union(partial.union(of_hot).join(single, ["seed", "ctx"], "left_semi"))
    spans = cand.join(known, ["seed", "ctx"]).select("k1", "k2", F.transform("ranges", lambda r: F.struct(r["l"].alias("l"), (F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"] + r["l"]).alias("b"))).alias("s"))
    out = written(spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("s")).alias("spans")), "suffix-spans")  # a set: repeated rows have the same
    discard(more, cand, one, several, data)
    return out


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover, in order; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def passages(data: bytes, covered: list[tuple[int, int]], words: int, size: int) -> list[tuple[int, int]]:
    """The runs that hold so many words or bytes."""
    return [(a, b) for a, b in covered if b - a >= size or len(data[a:b].split()) >= words]


def cut_out(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for a, b in gone:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]])


def _with_spans(docs: DataFrame, *lengths: int) -> DataFrame:
    """_row (docs' columns), doc_id, text and _spans (null without repeats)."""
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("k1", F.coalesce("doc_id", F.lit(-1).cast("long"))).withColumn("k2", F.xxhash64("text"))
    spans = repeated_spans(docs, *lengths).withColumnRenamed("spans", "_spans")
    return own.join(spans, ["k1", "k2"], "left").select("_row", "doc_id", "text", "_spans")


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PASSAGES = "n_passages long, passage_bytes long"


def digests(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs.

    With passage, also n_passages, passage_bytes: what without_repeats(docs, passage) takes out, from the same merge.
    Texts are UTF-8 bytes (null: empty), judged whole and on the input; matches never cross texts. Equal rows, also
    those with one id, hold each other's strings, so long ones go whole. Texts under `length` bytes stay; an empty table
    gives none; other columns play no part.
    """
    schema = f"{DIGESTS}, {PASSAGES}" if passage else DIGESTS
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())[: len(names) - 1]
    bounds = WORDS, LENGTH

    def of(data: bytes, spans: list[dict]) -> tuple:
        gone = runs([(s["a"], s["b"]) for s in spans if s["l"] == length])
        out = len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(cut_out(data, gone)).hexdigest()
        if not passage:
            return out
        found = passages(data, runs([(s["a"], s["b"]) for s in spans if s["l"] == passage]), *bounds)
        return *out, len(found), sum(b - a for a, b in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = [of((text.as_py() or "").encode(), spans.as_py() or []) for text, spans in zip(b.column("text"), b.column("_spans"), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    rows = _with_spans(docs.select("doc_id", "text"), length, *([passage] if passage else []))
    return rows.select("doc_id", "text", "_spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """docs without the passages that repeat: runs of bytes covered by `passage`-byte strings that also start elsewhere,
    if they hold WORDS words or LENGTH bytes.

    All occurrences go, judged on the input; a character that a cut splits goes whole. Null, empty and short texts stay
    as they are, equal rows lose the same, all rows and other columns stay, and an empty table stays empty.
    """

    bounds = WORDS, LENGTH

    @F.pandas_udf("string")
    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if s is not None and t is not None:
                data = t.encode()
                t = cut_out(data, passages(data, runs([(int(x["a"]), int(x["b"])) for x in s]), *bounds)).decode(errors="ignore")
            out.append(t)
        return pd.Series(out)

    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(left(F.col("text"), "_spans"))
    return _with_spans(docs, passage).select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])

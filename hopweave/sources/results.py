"""Result, sparse-matrix and graph-index files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import checkpointed
from .vecfiles import made, opened


def _values(column: pa.Array, kind: str) -> bytes:
    """Values, or those of all lists, one after another."""
    flat = column.flatten() if pa.types.is_list(column.type) else column
    if flat.null_count:
        raise ValueError("a null has no place in this file")
    return flat.to_numpy(zero_copy_only=False).astype(kind).tobytes()


def _lists(column: pa.Array) -> bytes:
    """Lists of ids, each led by its length; a null is an empty list."""
    around = [np.array(ids or [], "<i4") for ids in column.to_pylist()]
    return b"".join(np.array([len(a)], "<u8").tobytes() + a.tobytes() for a in around)


def _poured(ordered: DataFrame, column: str, packed: Callable, *kind: str) -> Iterator[bytes]:
    """The bytes of a column in row order; tasks make them of whole batches, the driver only passes them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packed(b.column(0), *kind)], pa.binary())], ["raw"])

    for r in ordered.select(column).mapInArrow(run, "raw binary").toLocalIterator():
        yield bytes(r[0])


def _rows(spark: SparkSession, path: str, parts: list[tuple], schema: str, read: Callable) -> DataFrame:
    """read(file, part) -> columns, for byte ranges dealt over the cluster."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = opened(path)
        for b in batches:
            for i in b.column(0).to_pylist():
                with system.open_input_file(name) as f:
                    yield pa.RecordBatch.from_arrays(read(f, parts[i]), names)

    return spark.range(len(parts), numPartitions=max(1, len(parts))).mapInArrow(run, schema)


def _at(f, offset: int, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(f.read_at(count * np.dtype(kind).itemsize, offset), kind)


def _ranges(n: int, step: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def read_knn(spark: SparkSession, path: str, step: int = 10_000) -> DataFrame:
    """u32 queries, u32 k, ids (i32), distances (f32) -> q_id, rank (from 1), b_id, dist."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        n, k = map(int, _at(f, 0, 2, "<u4"))

    def read(f, part):
        a, b = part
        ids = _at(f, 8 + 4 * k * a, k * (b - a), "<i4")
        dist = _at(f, 8 + 4 * k * n + 4 * k * a, k * (b - a), "<f4")
        return [pa.array(np.repeat(np.arange(a, b), k)), pa.array(np.tile(np.arange(1, k + 1), b - a), pa.int32()), pa.array(ids.astype(np.int64)), pa.array(dist.astype(float))]

    return _rows(spark, path, _ranges(n, step), "q_id long, rank int, b_id long, dist double", read)


def read_range(spark: SparkSession, path: str) -> DataFrame:
    """i32 queries, i32 total, counts (i32), ids (i32), distances (f32) -> q_id, b_id, dist."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        n, total = map(int, _at(f, 0, 2, "<i4"))
        ends = np.cumsum(_at(f, 8, n, "<i4"), dtype=np.int64)
    start = np.concatenate(([0], ends))

    def read(f, part):
        a, b = part
        lo, hi = int(start[a]), int(start[b])
        ids = _at(f, 8 + 4 * n + 4 * lo, hi - lo, "<i4")
        dist = _at(f, 8 + 4 * n + 4 * total + 4 * lo, hi - lo, "<f4")
        return [pa.array(np.repeat(np.arange(a, b), np.diff(start[a : b + 1]))), pa.array(ids.astype(np.int64)), pa.array(dist.astype(float))]

    return _rows(spark, path, _ranges(n, 10_000), "q_id long, b_id long, dist double", read)


def read_csr(spark: SparkSession, path: str, step: int = 50_000) -> DataFrame:
    """i64 rows, columns, entries; i64 starts; i32 indices; f32 values -> row_id, idx, val (arrays)."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        n, _, nnz = map(int, _at(f, 0, 3, "<i8"))

    def read(f, part):
        a, b = part
        start = _at(f, 24 + 8 * a, b - a + 1, "<i8")
        lo, hi = int(start[0]), int(start[-1])
        base = 24 + 8 * (n + 1)
        idx, val = _at(f, base + 4 * lo, hi - lo, "<i4"), _at(f, base + 4 * nnz + 4 * lo, hi - lo, "<f4")
        cut = pa.array((start - lo).astype(np.int32))
        return [pa.array(np.arange(a, b)), pa.ListArray.from_arrays(cut, pa.array(idx)), pa.ListArray.from_arrays(cut, pa.array(val))]

    return _rows(spark, path, _ranges(n, step), "row_id long, idx array<int>, val array<float>", read)


def write_csr(rows: DataFrame, path: str, columns: int) -> None:
    """(row_id from 0 without gaps, idx, val) as one file, sorted once."""
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()
    ordered = checkpointed(rows.select("row_id", "idx", "val", F.size("idx").alias("n")).orderBy("row_id"))
    system, name = made(path)
    with system.open_output_stream(name) as f:
        f.write(np.array([size[0], columns, size[1]], "<i8").tobytes())
        f.write(np.zeros(1, "<i8").tobytes())
        end = 0
        for raw in _poured(ordered, "n", _values, "<i8"):
            ends = end + np.cumsum(np.frombuffer(raw, "<i8"))
            f.write(ends.astype("<i8").tobytes())
            end = int(ends[-1]) if len(ends) else end
        for column, kind in (("idx", "<i4"), ("val", "<f4")):
            for raw in _poured(ordered, column, _values, kind):
                f.write(raw)


def write_knn(found: DataFrame, path: str, k: int) -> None:
    """(q_id, rank, b_id, dist), every query with k rows, as one file in q_id order."""
    n = found.select("q_id").distinct().count()
    if found.count() != n * k:
        raise ValueError("every query needs k rows")
    ordered = checkpointed(found.select("q_id", "rank", "b_id", "dist").orderBy("q_id", "rank"))
    system, name = made(path)
    with system.open_output_stream(name) as f:
        f.write(np.array([n, k], "<u4").tobytes())
        for column, kind in (("b_id", "<i4"), ("dist", "<f4")):
            for raw in _poured(ordered, column, _values, kind):
                f.write(raw)


def write_range(found: DataFrame, path: str, queries: int) -> None:
    """(q_id in 0..queries-1, b_id, dist) as one file, by q_id and distance."""
    count = {r.q_id: r["count"] for r in found.groupBy("q_id").count().toLocalIterator()}
    ordered = checkpointed(found.select("q_id", "b_id", "dist").orderBy("q_id", "dist", "b_id"))
    system, name = made(path)
    with system.open_output_stream(name) as f:
        f.write(np.array([queries, sum(count.values())], "<i4").tobytes())
        f.write(np.array([count.get(i, 0) for i in range(queries)], "<i4").tobytes())
        for column, kind in (("b_id", "<i4"), ("dist", "<f4")):
            for raw in _poured(ordered, column, _values, kind):
                f.write(raw)


#: Headers of the graph families' files: (name, type) in order (fixed formats).
HEADERS = {
    "hnsw": (("m", "<u8"), ("m0", "<u8"), ("efc", "<u8"), ("mult", "<f8"), ("rev", "<f8"), ("max_level", "<i4"), ("entry", "<i4"), ("seed", "<i4")),
    "nsg": (("n", "<u8"), ("r", "<u8"), ("dim", "<u8"), ("lc", "<u8"), ("entry", "<i4")),
    "hcnng": (("t", "<u8"), ("ls", "<u8"), ("s", "<u8")),
    "vamana": (("n", "<u8"), ("r", "<u8"), ("dim", "<u8"), ("lc", "<u8"), ("alpha", "<f4"), ("entry", "<i4")),
}


#: Nodes whose lists a task reads at once, and bytes of a graph file that are held where list starts are looked for.
LISTED, WINDOW = 1 << 14, 8 << 20


def _list_starts(f, at: int, n: int, levels: Callable[[int, int], np.ndarray], step: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(first node, last + 1, first byte, last + 1) of each `step` nodes' lists: a list's length leads to the next."""
    held, base = b"", at
    for first, last in _ranges(n, step):
        start = at
        for _ in range(int((levels(first, last) + 1).sum())):
            if at + 8 > base + len(held):
                held, base = f.read_at(window, at), at
                if len(held) < 8:
                    raise ValueError("the file ends before its last list")
            at += 8 + 4 * int.from_bytes(held[at - base : at - base + 8], "little")
        yield first, last, start, at


def _parsed(raw: bytes, first: int, levels: np.ndarray) -> list[np.ndarray]:
    """level, src, pos, dst of the lists of nodes from `first`."""
    head, at = [], 0
    while at < len(raw):
        head.append(at)
        at += 8 + 4 * int.from_bytes(raw[at : at + 8], "little")
    if at > len(raw):
        raise ValueError("the file ends within a list")
    head = np.array(head, np.int64) // 4
    word = np.frombuffer(raw, "<i4")
    listed = np.ones(len(word), bool)
    listed[head] = listed[head + 1] = False
    size = np.diff(np.append(head, len(word))) - 2
    lists = levels.astype(np.int64) + 1
    src = np.repeat(np.arange(first, first + len(levels)), lists)
    level = np.arange(len(src)) - np.repeat(np.cumsum(lists) - lists, lists)
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return [np.repeat(level, size).astype(np.int32), np.repeat(src, size), pos.astype(np.int32), word[listed].astype(np.int64)]


def read_index(spark: SparkSession, path: str, family: str, n: int) -> tuple[DataFrame, DataFrame, dict]:
    """(edges, nodes, header) of a graph file. Its lists have no fixed places: a task follows their lengths through the
    file, a window of bytes at a time, and ranges of lists are then read over the cluster."""
    system, name = opened(path)
    size = sum(np.dtype(k).itemsize for _, k in HEADERS[family])
    with system.open_input_file(name) as f:
        raw = f.read_at(size, 0)
    head, at = {}, 0
    for key, kind in HEADERS[family]:
        head[key] = np.frombuffer(raw, kind, 1, at)[0].item()
        at += np.dtype(kind).itemsize
    entry, layered, step, window = head.get("entry", -1), family == "hnsw", LISTED, WINDOW

    def levels(f, a: int, b: int) -> np.ndarray:
        return _at(f, size + 4 * a, b - a, "<i4") if layered else np.zeros(b - a, np.int32)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        system, name = opened(path)
        with system.open_input_file(name) as f:
            for row in _list_starts(f, size + 4 * n * layered, n, lambda a, b: levels(f, a, b), step, window):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["first", "last", "at", "ends"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = opened(path)
        with system.open_input_file(name) as f:
            for b in batches:
                for first, last, at, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    found = _parsed(f.read_at(ends - at, at), first, levels(f, first, last))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["level", "src", "pos", "dst"])

    def read(f, part):
        ids = np.arange(*part)
        return [pa.array(ids), pa.array(levels(f, *part)), pa.array(ids == entry)]

    ranges = spark.range(1, numPartitions=1).mapInArrow(starts, "first long, last long, at long, ends long")
    edges = ranges.repartition(max(1, min(-(-n // step), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(lists, "level int, src long, pos int, dst long")
    return edges, _rows(spark, path, _ranges(n, step), "id long, level int, is_entry boolean", read), head


def write_index(edges: DataFrame, nodes: DataFrame, path: str, family: str, header: dict) -> None:
    """A graph file from edges (level, src, pos, dst) and nodes (id from 0 without gaps, level), streamed in node order."""
    lists = edges.groupBy("level", "src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("around"))
    slots = nodes.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), "level")).alias("level")).join(lists, ["src", "level"], "left").orderBy("src", "level")
    system, name = made(path)
    with system.open_output_stream(name) as f:
        for key, kind in HEADERS[family]:
            f.write(np.array([header[key]], kind).tobytes())
        if family == "hnsw":
            for raw in _poured(nodes.orderBy("id"), "level", _values, "<i4"):
                f.write(raw)
        for raw in _poured(slots, "around", _lists):
            f.write(raw)


def save_index(edges: DataFrame, nodes: DataFrame, meta: DataFrame, path: str) -> None:
    """The library's own form: Parquet of edges by level, nodes and one row of meta."""
    edges.write.mode("overwrite").partitionBy("level").parquet(f"{path}/edges")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("edges", "nodes", "meta"))


#: Family codes of adjacency files (fixed values).
FAMILY_CODES = {0: "hcnng", 1: "vamana", 2: "nsg", 3: "hnsw"}


def read_adjacency(spark: SparkSession, path: str, code: int, n: int) -> DataFrame:
    """src, pos, dst of a graph file by its family's code; of layered graphs the lowest level."""
    return read_index(spark, path, FAMILY_CODES[code], n)[0].where("level = 0").drop("level")


def write_ivf(centroids: DataFrame, assigned: DataFrame, path: str, rounds: int) -> None:
    """(cid from 0, embedding) and (vec_id, cid) as one file: counts, centroids, ends of the lists, ids by list."""
    kc = centroids.count()
    size = {r.cid: r["count"] for r in assigned.groupBy("cid").count().collect()}  # as many as centroids
    system, name = made(path)
    with system.open_output_stream(name) as f:
        f.write(np.array([kc, rounds], "<u8").tobytes())
        for r in centroids.orderBy("cid").select("embedding").toLocalIterator():
            f.write(np.asarray(r[0], "<f4").tobytes())
        f.write(np.cumsum([size.get(i, 0) for i in range(kc)]).astype("<u8").tobytes())
        for raw in _poured(assigned.orderBy("cid", "vec_id"), "vec_id", _values, "<i4"):
            f.write(raw)


def read_ivf(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(centroids (cid, embedding), assignments (vec_id, cid))."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        kc = int(_at(f, 0, 1, "<u8")[0])
        centroids = _at(f, 16, kc * dim, "<f4").reshape(kc, dim)
        ends = _at(f, 16 + 4 * kc * dim, kc, "<u8").astype(np.int64)
    start = np.concatenate(([0], ends))

    def read(f, part):
        a, b = part
        lo, hi = int(start[a]), int(start[b])
        ids = _at(f, 16 + 4 * kc * dim + 8 * kc + 4 * lo, hi - lo, "<i4")
        return [pa.array(ids.astype(np.int64)), pa.array(np.repeat(np.arange(a, b), np.diff(start[a : b + 1])))]

    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cid long, embedding array<float>")
    return table, _rows(spark, path, _ranges(kc, max(1, kc // 64)), "vec_id long, cid long", read)


#: A node of a trace file (fixed format); each tree is led by its number of nodes (i32). A root's parent is 0.
TREE_NODE = np.dtype([("node", "<i4"), ("parent", "<i4"), ("depth", "<i4"), ("chosen", "<i4"), ("dist", "<f4")])


def _trees(column: pa.Array) -> bytes:
    out = []
    for tree in column.to_pylist():
        rows = [(n["node"], n["parent"] or 0, n["depth"], n["chosen"], np.nan if n["dist"] is None else n["dist"]) for n in tree]
        out += [np.array([len(rows)], "<i4").tobytes(), np.array(rows, TREE_NODE).tobytes()]
    return b"".join(out)


def write_trees(preorder: DataFrame, path: str) -> None:
    """traces.preorder as one file, trees by query and shard. A tree is one search's, so its list is small.

    Distances that are null (those of roots) are written as NaN. A table without trees gives an empty file.
    """
    node = F.struct("at", "node", "parent", "depth", "chosen", "dist")
    trees = preorder.groupBy("q_id", "shard").agg(F.array_sort(F.collect_list(node)).alias("tree")).orderBy("q_id", "shard")
    system, name = made(path)
    with system.open_output_stream(name) as f:
        for raw in _poured(trees, "tree", _trees):
            f.write(raw)


def read_trees(spark: SparkSession, path: str, step: int = 1000) -> DataFrame:
    """tree (its place in the file), at, node, parent, depth, chosen, dist; the driver reads the trees' sizes alone."""
    system, name = opened(path)
    places, at = [], 0
    with system.open_input_file(name) as f:
        while at < f.size():
            count = int(_at(f, at, 1, "<i4")[0])
            places.append((at + 4, count))
            at += 4 + count * TREE_NODE.itemsize

    def read(f, part):
        a, b = part
        nodes = np.concatenate([np.frombuffer(f.read_at(n * TREE_NODE.itemsize, start), TREE_NODE) for start, n in places[a:b]])
        size = [n for _, n in places[a:b]]
        depth = nodes["depth"]
        ints = [pa.array(nodes[c].astype(t)) for c, t in (("depth", np.int32), ("chosen", np.int32))]
        return [
            pa.array(np.repeat(np.arange(a, b), size)),
            pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in size])),
            pa.array(nodes["node"].astype(np.int64)),
            pa.array(nodes["parent"].astype(np.int64), mask=depth == 0),
            *ints,
            pa.array(nodes["dist"].astype(float), from_pandas=True),
        ]

    return _rows(spark, path, _ranges(len(places), step), "tree long, at int, node long, parent long, depth int, chosen int, dist double", read)

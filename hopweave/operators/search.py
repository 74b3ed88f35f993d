"""Best-first graph search with traces.

A graph is a table of edges (level, src, pos, dst); pos keeps the order of a node's list, on which traces depend.
Searches run over batches of queries in tasks that hold one shard of the graph: its adjacency (CSR) and vectors. A
graph of up to SHARD_ROWS nodes is one shard, broadcast after a check of its size; larger ones are built and searched in
shards (see build.py), and the shards' answers are merged. opened() gives the one or the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush, heappushpop

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..plans.iterate import checkpointed
from .knn import matrix, ranked

#: Bytes of vectors and adjacency that are broadcast at most.
SHARD_BYTES = 256 << 20
#: Cells that a query is searched in, where shards are cells around centres.
PROBES = 6
#: Queries that a task searches in its shard at most.
CHUNK_ROWS = 50_000
#: The same where a search gives hundreds of rows, as a trace does.
TRACED_ROWS = 4_000
#: A search measures all nodes of its shard at once where they are at most so many times ef: it would meet most of them.
WHOLE = 20
#: The same where that may end it early.
AIMED = 100
FOUND = "q_id long, rank int, b_id long, dist double, evaluations long, shard int"
TRACE = "q_id long, seq int, level int, src long, dst long, dist double, adopted int, shard int"
TREE = "q_id long, shard int, seq int, node long, parent long, dist double, place int, evaluations long"


class Lists(Sequence):
    """Neighbour lists in one array: those of node i are dst[cut[i] : cut[i + 1]]. A broadcast of an array for each node
    would take each worker several times their bytes."""

    def __init__(self, cut: np.ndarray, dst: np.ndarray):
        self.cut, self.dst = cut, dst

    def __len__(self) -> int:
        return len(self.cut) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.dst[self.cut[i] : self.cut[i + 1]]


@dataclass
class Graph:
    """One shard. Nodes are numbered 0..n-1 in ascending id order; lists[level][node] are the neighbours in order.

    x may be floats, if that is what the table holds; distances are worked out in doubles.
    """

    ids: np.ndarray
    x: np.ndarray
    lists: Sequence[Sequence[np.ndarray]]
    entry: int
    #: Entry from a hash of the query's id instead.
    random_entry: bool = False
    seed: int = 1
    shard: int = 0
    #: The highest level of each node.
    tops: np.ndarray | None = None
    #: The broadcast of this graph, which its searches share.
    _shared: Broadcast | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_shared": None}

    def shared(self, spark: SparkSession) -> Broadcast:
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = np.subtract(self.x.take(nodes, axis=0), q, dtype=np.float64)
        d *= d
        return np.add.reduce(d, axis=1)

    def all_distances(self, q: np.ndarray) -> np.ndarray:
        """distances() to every node, a few thousand at a time."""
        out = np.empty(len(self.x))
        for at in range(0, len(self.x), 2048):
            d = np.subtract(self.x[at : at + 2048], q, dtype=np.float64)
            d *= d
            out[at : at + 2048] = np.add.reduce(d, axis=1)
        return out

    def start(self, q_id: int) -> int:
        return mixed(self.seed, q_id) % len(self.ids) if self.random_entry else self.entry


@dataclass
class Shards:
    """Several shards, which stay where they lie. nodes: a row for each node with its vector and out-lists."""

    nodes: DataFrame
    count: int
    random_entry: bool = False
    #: Centres of overlapping cells by shard: a query goes to its PROBES nearest shards alone, a node to its own.
    centres: dict[int, np.ndarray] | None = None


def mixed(seed: int, key: int) -> int:
    """A 64-bit hash of two integers."""
    z = (key * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (1 << 64) - 1
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return z ^ z >> 31


Event = Callable[[int, int, int, float, int], None]


def beam(g: Graph, q: np.ndarray, start: int, ef: int, level: int = 0, event: Event | None = None, disabled: frozenset = frozenset(), start_dist: float | None = None) -> tuple[list[tuple[float, int]], int, list[int]]:
    """(the ef nearest found as ascending (dist, node), distances evaluated, nodes expanded in order).

    A node is adopted if it is nearer than the worst held or fewer than ef are held; of equal distances the larger
    node is expanded first and dropped first. event(level, src, node, dist, adopted) hears of each node first met.
    """
    if level == 0 and len(g.ids) <= WHOLE * ef and np.isfinite(dist := g.all_distances(q)).all():
        return _measured_beam(g.lists[0], dist, start, ef, event, disabled, int(start_dist is not None))
    first = float(g.distances(q, np.array([start]))[0]) if start_dist is None else start_dist
    worst = [(-first, -start)]  # the root is the worst held: largest distance, then largest node
    cand = [(first, -start)]  # the root is the nearest: least distance, then largest node
    seen = {start}
    expanded = []
    lists = g.lists[level]
    bound, full = first, ef <= 1
    while cand:
        d, minus = cand[0]
        if full and d > bound:
            break
        heappop(cand)
        node = -minus
        expanded.append(node)
        fresh = [v for v in lists[node].tolist() if v not in seen and (node, v) not in disabled] if disabled else [v for v in lists[node].tolist() if v not in seen]
        if not fresh:
            continue
        dist = g.distances(q, np.array(fresh)).tolist()
        for v, dv in zip(fresh, dist, strict=True):
            if v in seen:
                continue
            seen.add(v)
            adopted = not full or dv < bound
            if adopted:
                heappush(cand, (dv, -v))
                if full:
                    heappushpop(worst, (-dv, -v))
                else:
                    heappush(worst, (-dv, -v))
                    full = len(worst) == ef
                bound = -worst[0][0]
            if event:
                event(level, node, v, dv, int(adopted))
    return sorted((-d, -v) for d, v in worst), len(seen) - int(start_dist is not None), expanded


def _measured_beam(lists: list[np.ndarray], dist: np.ndarray, start: int, ef: int, event: Event | None, disabled: frozenset, known: int) -> tuple[list[tuple[float, int]], int, list[int]]:
    """beam() on level 0 where all distances are at hand: nodes stand in the heaps as their places in the heaps' orders."""
    minus = -np.arange(len(dist))
    order = np.lexsort((minus, dist))
    outer = np.lexsort((minus, -dist))
    near, away = np.empty((2, len(dist)), np.int64)
    near[order] = away[outer] = np.arange(len(dist))
    order, outer, near, away, dist = order.tolist(), outer.tolist(), near.tolist(), away.tolist(), dist.tolist()
    worst, cand, seen, met, expanded = [away[start]], [near[start]], bytearray(len(dist)), 1, []
    seen[start] = 1
    bound, full = dist[start], ef <= 1
    while cand:
        node = order[cand[0]]
        if full and dist[node] > bound:
            break
        heappop(cand)
        expanded.append(node)
        for v in lists[node].tolist():
            if seen[v] or disabled and (node, v) in disabled:
                continue
            seen[v] = adopted = 1
            met += 1
            if not full:
                heappush(cand, near[v])
                worst.append(away[v])
                if len(worst) == ef:
                    heapify(worst)
                    bound, full = dist[outer[worst[0]]], True
            elif dist[v] < bound:
                heappush(cand, near[v])
                heappushpop(worst, away[v])
                bound = dist[outer[worst[0]]]
            else:
                adopted = 0
            if event:
                event(0, node, v, dist[v], adopted)
    return sorted((dist[v], v) for v in map(outer.__getitem__, worst)), met - known, expanded


def descend(g: Graph, q: np.ndarray, start: int, event: Event | None = None, disabled: frozenset = frozenset(), down_to: int = 0) -> tuple[int, float, int]:
    """Greedy walk through the levels above down_to: (node, dist, distances evaluated). Every scan reads a whole list."""
    node, dist = start, float(g.distances(q, np.array([start]))[0])
    count = 1
    for level in range(len(g.lists) - 1, down_to, -1):
        moved = True
        while moved:
            moved = False
            around = g.lists[level][node]
            if not len(around):
                break
            scanned = node
            count += len(around)
            for v, dv in zip(around.tolist(), g.distances(q, around).tolist(), strict=True):
                better = dv < dist and (scanned, v) not in disabled
                if better:
                    node, dist, moved = v, dv, True
                if event:
                    event(level, scanned, v, dv, int(better))
    return node, dist, count


def search(g: Graph, q: np.ndarray, q_id: int, k: int, ef: int, event: Event | None = None, disabled: frozenset = frozenset()) -> tuple[list[tuple[float, int]], int, list[int]]:
    """Up to k nearest as (dist, node), distances evaluated, nodes expanded: descent through upper levels, then a beam."""
    if len(g.lists) > 1:
        node, dist, count = descend(g, q, g.entry, event, disabled)
        found, more, expanded = beam(g, q, node, ef, 0, event, disabled, start_dist=dist)
        return found[:k], count + more, expanded
    found, count, expanded = beam(g, q, g.start(q_id), ef, 0, event, disabled)
    return found[:k], count, expanded


def _entered(g: Graph, q: np.ndarray, q_id: int) -> tuple[int, int]:
    """(the node at which search() enters level 0, distances evaluated before its beam counts)."""
    if len(g.lists) > 1:
        node, _, count = descend(g, q, g.entry)
        return node, count - 1  # a beam that is given its start's distance does not count it
    return g.start(q_id), 0


def nearest_held(g: Graph, q: np.ndarray, q_id: int, k: int, ef: int) -> list[tuple[float, int]]:
    """search()'s answer alone. All nodes are measured first, and once the k nearest of all are held no later step can change it."""
    if k > ef or len(g.ids) > AIMED * ef or not np.isfinite(all_ := g.all_distances(q)).all():
        return search(g, q, q_id, k, ef)[0]
    bar = np.partition(all_, k - 1)[k - 1] if k < len(all_) else np.inf
    aim = sorted((float(all_[v]), int(v)) for v in np.flatnonzero(all_ <= bar))[:k]
    start, lists, dist, wanted, seen = _entered(g, q, q_id)[0], g.lists[0], all_.tolist(), bytearray(len(all_)), bytearray(len(all_))
    for _, v in aim:
        wanted[v] = 1
    seen[start], left, bound, full = 1, len(aim) - wanted[start], dist[start], ef <= 1
    worst, cand = [(-bound, -start)], [(bound, -start)]
    while cand and left:
        d, minus = cand[0]
        if full and d > bound:
            break
        heappop(cand)
        for v in lists[-minus].tolist():
            if seen[v]:
                continue
            seen[v] = 1
            dv = dist[v]
            if not full or dv < bound:
                heappush(cand, (dv, -v))
                left -= wanted[v]
                if full:
                    heappushpop(worst, (-dv, -v))
                else:
                    heappush(worst, (-dv, -v))
                    full = len(worst) == ef
                bound = -worst[0][0]
    return aim if not left else sorted((-d, -v) for d, v in worst)[:k]


def searches(g: Graph, q: np.ndarray, q_id: int, k: int, efs: Sequence[int]) -> Iterator[tuple[list[tuple[float, int]], int]]:
    """search()'s answer and distances evaluated for each of ascending efs, in one search where no distances are equal.

    What a search refuses is farther than all it holds, so a larger ef starts with the same steps: it goes on where the
    smaller one ends. Nodes stand in the heaps as their places by distance.
    """
    dist = g.all_distances(q) if len(efs) > 1 and len(g.ids) <= AIMED * efs[-1] else np.zeros(0)
    order = np.argsort(dist)
    if not len(dist) or not np.isfinite(dist).all() or (np.diff(dist[order]) == 0).any():
        yield from (search(g, q, q_id, k, ef)[:2] for ef in efs)
        return
    near = np.empty(len(dist), np.int64)
    near[order] = np.arange(len(dist))
    start, before = _entered(g, q, q_id)
    near, order, seen, lists = near.tolist(), order.tolist(), bytearray(len(dist)), g.lists[0]
    seen[start], met = 1, 1
    held, rest, cand = [-near[start]], [], [near[start]]  # the ef nearest met, farthest first; the others met; those not expanded
    for ef in efs:
        while rest and len(held) < ef:
            heappush(held, -heappop(rest))
        while cand and (len(held) < ef or cand[0] <= -held[0]):
            for v in lists[order[heappop(cand)]].tolist():
                if not seen[v]:
                    seen[v], place = 1, near[v]
                    met += 1
                    heappush(cand, place)
                    if len(held) < ef:
                        heappush(held, -place)
                    else:
                        heappush(rest, -heappushpop(held, -place))
        yield [(float(dist[order[-p]]), order[-p]) for p in sorted(held, reverse=True)[:k]], met + before


def load(edges: DataFrame, nodes: DataFrame, vectors: DataFrame, random_entry: bool = False) -> Graph:
    """A one-shard graph on the driver, after a check that it is one shard and small enough to broadcast."""
    if (shards := _shards(nodes)) > 1:
        raise ValueError(f"{shards} shards have no edges between them; open them with opened()")
    if (size := loaded_bytes(edges, vectors)) > SHARD_BYTES:
        raise ValueError(f"{size} bytes of vectors and edges are more than one shard; build and search in shards")
    v = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # Arrow columns: a row of Python objects for each edge would take some hundred bytes of the driver
    rows = v.orderBy("vec_id").toArrow()
    ids, x = rows.column(0).to_numpy(), matrix(rows.column(1), np.float32 if _single(vectors) else np.float64)
    del rows
    info = nodes.select("id", "level", "is_entry").toArrow().to_pandas()
    return assemble(ids, x, _links(edges), info, random_entry)


def _links(edges: DataFrame) -> pd.DataFrame:
    return edges.select(F.col("level").cast("int").alias("level"), "src", "pos", "dst").orderBy("level", "src", "pos").select("level", "src", "dst").toArrow().to_pandas()


def relinked(g: Graph, edges: DataFrame, count: int) -> Graph:
    """load() of other edges (count of them) between a loaded graph's nodes."""
    if (size := g.x.nbytes + 8 * count) > SHARD_BYTES:
        raise ValueError(f"{size} bytes of vectors and edges are more than one shard; build and search in shards")
    info = pd.DataFrame({"id": g.ids, "level": g.tops, "is_entry": np.arange(len(g.ids)) == g.entry})
    return assemble(g.ids, g.x, _links(edges), info, g.random_entry)


def loaded_bytes(edges: DataFrame, vectors: DataFrame) -> int:
    """Bytes of vectors and adjacency that load() would hold."""
    n, dim = vectors.where("embedding is not null").agg(F.count("*"), F.max(F.size("embedding"))).first()
    return n * (dim or 0) * (4 if _single(vectors) else 8) + edges.count() * 8


def _single(vectors: DataFrame) -> bool:
    """Whether the vectors are floats, which a loaded graph keeps."""
    return vectors.schema["embedding"].dataType.elementType == FloatType()


def _shards(nodes: DataFrame) -> int:
    return nodes.select("shard").distinct().count() if "shard" in nodes.columns else 1


def opened(edges: DataFrame, nodes: DataFrame, vectors: DataFrame, random_entry: bool = False) -> Graph | Shards:
    """What searches take: a graph of one shard on the driver, or the shards of nodes (shard, id, level, is_entry)."""
    if (shards := _shards(nodes)) <= 1:
        return load(edges, nodes, vectors, random_entry)
    v = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["id"])
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("level", "pos", "dst"))).alias("l"))  # bounded lists
    rows = nodes.select("shard", "id", F.col("level").alias("top"), "is_entry").join(v, "id").join(lists, "id", "left")
    rows = rows.select("shard", "id", "top", "is_entry", "embedding", F.transform("l", lambda e: e["level"]).alias("levels"), F.transform("l", lambda e: e["dst"]).alias("dsts"))
    return Shards(checkpointed(rows), shards, random_entry)


def _unpacked(pdf: pd.DataFrame, random_entry: bool) -> Graph:
    """The graph of one shard's rows of Shards.nodes."""
    pdf = pdf.sort_values("id", ignore_index=True)
    ids = pdf["id"].to_numpy(np.int64)
    none = np.zeros(0, np.int64)
    levels, dsts = ([none if x is None else np.asarray(x, np.int64) for x in pdf[c]] for c in ("levels", "dsts"))
    table = pd.DataFrame({"level": np.concatenate(levels), "src": np.repeat(ids, [len(x) for x in dsts]), "dst": np.concatenate(dsts)})
    table = table[np.isin(table["dst"], ids)]  # cells that overlap share nodes, and links lead out of them
    g = assemble(ids, np.stack(pdf["embedding"].to_numpy()), table, pdf[["id", "top", "is_entry"]].rename(columns={"top": "level"}), random_entry)
    g.shard = int(pdf["shard"].iloc[0])
    return g


def assemble(ids, x, table, info, random_entry: bool = False) -> Graph:
    levels = 1 + max(int(table["level"].max()) if len(table) else 0, int(info["level"].max()) if len(info) else 0)
    lists = []
    for level in range(levels):
        own = table[table["level"] == level]
        src = np.searchsorted(ids, own["src"].to_numpy(np.int64))
        dst = np.searchsorted(ids, own["dst"].to_numpy(np.int64))
        lists.append(Lists(np.searchsorted(src, np.arange(len(ids) + 1)), dst.astype(np.int32)))
    entry = info.loc[info["is_entry"].astype(bool), "id"]
    tops = np.zeros(len(ids), np.int64)
    tops[np.searchsorted(ids, info["id"].to_numpy(np.int64))] = info["level"].to_numpy(np.int64)
    return Graph(ids, x, lists, int(np.searchsorted(ids, entry.iloc[0])) if len(entry) else 0, random_entry, tops=tops)


def _dealt(s: Shards, queries: DataFrame, schema: str, each: Callable, home: bool, more: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """_over for shards: each task holds one of them and a chunk of the queries, at most `most`."""
    own = queries.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *more)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    chunks = max(-(-own.count() // (most or CHUNK_ROWS)), -(-cores // s.count))
    if "shard" in more:
        asked = own
    elif home:
        asked = own.join(s.nodes.select(F.col("id").alias("vec_id"), "shard"), "vec_id")
    elif s.centres is not None:
        asked = _probed(own, s.centres)
    else:
        asked = own.join(F.broadcast(s.nodes.select("shard").distinct()))  # a row for each shard
    asked = asked.withColumn("home", F.col("shard") + 0).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    held = s.nodes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    random_entry, names = s.random_entry, [c.split()[0] for c in schema.split(", ")]
    kinds = {c.split()[0]: {"long": "Int64", "int": "Int32", "double": "float64"}[c.split()[1]] for c in schema.split(", ")}
    extra = [c for c in more if c != "shard"]

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame([], columns=names).astype(kinds)]
        if len(q) and len(v):
            g = _unpacked(v, random_entry)
            q = q.sort_values("vec_id")
            for at in range(0, len(q), 64):  # rows of Python objects for a few queries at once, columns for the rest
                b = q.iloc[at : at + 64]
                rows = [r for i, x, *rest in zip(b["vec_id"], b["embedding"], *(b[c] for c in extra), strict=True) for r in each(g, int(i), np.asarray(x), *rest)]
                if rows:
                    out.append(pd.DataFrame(rows, columns=names).astype(kinds))
        return pd.concat(out, ignore_index=True, copy=False) if len(out) > 1 else out[0]

    return asked.drop("shard").groupBy("home", "chunk").cogroup(held.groupBy("shard", "chunk")).applyInPandas(run, schema)


def _probed(queries: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """queries (vec_id, embedding) with the shard of each of their PROBES nearest centres."""
    names, c = np.array(sorted(centres)), np.array([centres[i] for i in sorted(centres)])
    shared = queries.sparkSession.sparkContext.broadcast((names, c))  # their size was checked when cells were dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = shared.value
        for b in batches:
            x = matrix(b.column(1))
            if len(names) <= PROBES:
                spot = np.broadcast_to(np.arange(len(names)), (len(x), len(names)))
            else:
                spot = np.argsort((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1, kind="stable")[:, :PROBES]
            for i in range(spot.shape[1]):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[spot[:, i]], pa.int32())], ["vec_id", "embedding", "shard"])

    return queries.mapInArrow(run, "vec_id long, embedding array<double>, shard int")


def _over(g: Graph | Shards, queries: DataFrame, schema: str, each: Callable, home: bool = False, most: int | None = None) -> DataFrame:
    """each(graph, q_id, vector) -> rows, for every query, in batches; the graph is broadcast.

    Of several shards, each sees every query, or with home=True (queries are nodes) those that are nodes of its own.
    """
    if isinstance(g, Shards):
        return _dealt(g, queries, schema, each, home, most=most)
    spark = queries.sparkSession
    shared = g.shared(spark)
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [r for q_id, q in zip(b.column(0).to_pylist(), matrix(b.column(1)), strict=True) for r in each(shared.value, q_id, q)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    own = queries.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # few queries come in few files: each is long work, so they are dealt to all cores
    return own.repartition(spark.sparkContext.defaultParallelism, "vec_id").mapInArrow(run, schema)


def answers(g: Graph | Shards, queries: DataFrame, k: int, ef: int, home: bool = False) -> DataFrame:
    """q_id, rank, b_id of knn_search, without its evaluations, so that a search of one shard may end early."""
    if isinstance(g, Shards):
        return knn_search(g, queries, k, ef, home=home).select("q_id", "rank", "b_id")
    return _over(g, queries, "q_id long, rank int, b_id long", lambda g, q_id, q: [(q_id, i, int(g.ids[v])) for i, (_, v) in enumerate(nearest_held(g, q, q_id, k, ef), 1)])


def knn_search(g: Graph | Shards, queries: DataFrame, k: int, ef: int, exclude_self: bool = False, disabled: frozenset = frozenset(), home: bool = False) -> DataFrame:
    """q_id, rank (1: nearest), b_id, dist, evaluations. Fewer than k rows if ef < k or the graph does not reach more.

    exclude_self drops the query's own id from the answer. disabled: (src, dst) ids of edges that are not followed.
    Several shards are all searched with ef and their answers merged, of cells the nearest few; evaluations are then
    those of all shards searched. home: the queries are nodes, and are searched for in the shards they stand in.
    """
    found = shard_answers(g, queries, k, ef, exclude_self, disabled, home)
    return merged_answers(found, k) if isinstance(g, Shards) else found.drop("shard")


def shard_answers(g: Graph | Shards, queries: DataFrame, k: int, ef: int, exclude_self: bool = False, disabled: frozenset = frozenset(), home: bool = False) -> DataFrame:
    """knn_search's rows of each shard before they are merged, with the shard. A shard without answer has a null b_id."""
    placed: dict[int, frozenset] = {}
    several = isinstance(g, Shards)

    def each(g: Graph, q_id: int, q: np.ndarray):
        if g.shard not in placed:
            placed[g.shard] = frozenset((at[a], at[b]) for a, b in disabled if a in at and b in at) if disabled and (at := {int(x): i for i, x in enumerate(g.ids)}) else frozenset()
        found, count, _ = search(g, q, q_id, ef if exclude_self else k, ef, disabled=placed[g.shard])
        rows = [(d, int(g.ids[v])) for d, v in found if not exclude_self or g.ids[v] != q_id][:k]
        return [(q_id, i + 1, b, d, count, g.shard) for i, (d, b) in enumerate(rows)] or ([(q_id, 0, None, None, count, g.shard)] if several else [])

    return _over(g, queries, FOUND, each, home)


def merged_answers(parts: DataFrame, k: int) -> DataFrame:
    """q_id, rank, b_id, dist, evaluations (of all shards) of shard_answers; parts are computed once."""
    parts = checkpointed(parts)
    cost = parts.groupBy("q_id", "shard").agg(F.max("evaluations").alias("e")).groupBy("q_id").agg(F.sum("e").alias("evaluations"))
    return merged(parts.where("b_id is not null").select("q_id", "b_id", "dist"), k).join(cost, "q_id").select("q_id", "rank", "b_id", "dist", "evaluations")


def traces(g: Graph | Shards, queries: DataFrame, ef: int) -> DataFrame:
    """q_id, seq, level, src, dst, dist, adopted, shard: the edge by which each node was first met, in order.

    Level-0 rows of a query number its evaluations less the entry's. On upper levels every scanned neighbour is a row.
    A query has a trace in every shard, and seq counts in each.
    """

    def each(g: Graph, q_id: int, q: np.ndarray):
        rows = []
        search(g, q, q_id, ef, ef, lambda level, src, v, d, adopted: rows.append((q_id, len(rows), level, int(g.ids[src]), int(g.ids[v]), d, adopted, g.shard)))
        return rows

    return _over(g, queries, TRACE, each, most=TRACED_ROWS)


def trees(g: Graph | Shards, queries: DataFrame, ef: int) -> DataFrame:
    """q_id, shard, seq, node, parent, dist, place, evaluations: level 0 of each search as a tree of the nodes it adopted.

    The root (seq 0, no parent) is the node that the level is entered at, with its distance. place: a node's rank from 1
    among what the search held at its end, else null. evaluations, on each row, are those of level 0.
    """

    def each(g: Graph, q_id: int, q: np.ndarray):
        start = descend(g, q, g.entry)[0] if len(g.lists) > 1 else g.start(q_id)
        rows: list[tuple] = [(start, None, float(g.distances(q, np.array([start]))[0]))]
        found, count, _ = beam(g, q, start, ef, 0, lambda level, src, v, d, adopted: rows.append((v, src, d)) if adopted else None)
        place = {v: i for i, (_, v) in enumerate(found, 1)}
        return [(q_id, g.shard, i, int(g.ids[v]), None if src is None else int(g.ids[src]), d, place.get(v), count) for i, (v, src, d) in enumerate(rows)]

    return _over(g, queries, TREE, each, most=TRACED_ROWS)


def edge_statistics(trace: DataFrame, level_scope: int | None = None) -> DataFrame:
    """level, src, dst, adopted, discarded."""
    rows = trace if level_scope is None else trace.where(F.col("level") < level_scope)
    return rows.groupBy("level", "src", "dst").agg(F.sum("adopted").alias("adopted"), F.sum(1 - F.col("adopted")).alias("discarded"))


#: Different edges whose counts a task holds before it sends them on.
COUNTED = 1 << 20


def edge_counts(g: Graph | Shards, queries: DataFrame, ef: int, level_scope: int | None = None) -> DataFrame:
    """edge_statistics of traces(); of one shard, tasks add up their searches' events and send a row for each edge."""
    if isinstance(g, Shards):
        return edge_statistics(traces(g, queries, ef), level_scope)
    shared, names, most = g.shared(queries.sparkSession), ["level", "src", "dst", "adopted", "discarded"], COUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, events = shared.value, []
        n, keys, times = len(g.ids), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def met(level: int, src: int, v: int, d: float, adopted: int) -> None:
            if level_scope is None or level < level_scope:
                events.append(((level * n + src) * n + v) * 2 + adopted)

        def added() -> tuple[np.ndarray, np.ndarray]:
            own, back = np.unique(np.concatenate((keys, np.array(events, np.int64))), return_inverse=True)
            events.clear()
            return own, np.bincount(back, np.concatenate((times, np.ones(len(back) - len(times))))).astype(np.int64)

        def rows() -> pa.RecordBatch:
            edge, adopted = keys >> 1, keys & 1
            ids = (edge // (n * n), g.ids[edge // n % n], g.ids[edge % n], times * adopted, times * (1 - adopted))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ids, [pa.int32()] + [pa.int64()] * 4, strict=True)], names)

        for b in batches:
            for q_id, q in zip(b.column(0).to_pylist(), matrix(b.column(1)), strict=True):
                search(g, q, q_id, ef, ef, met)
                if len(events) > most:
                    keys, times = added()
                    if len(keys) > most:
                        yield rows()
                        keys = times = np.zeros(0, np.int64)
        keys, times = added()
        yield rows()

    own = queries.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    parts = own.repartition(queries.sparkSession.sparkContext.defaultParallelism, "vec_id").mapInArrow(run, "level int, src long, dst long, adopted long, discarded long")
    return parts.groupBy("level", "src", "dst").agg(F.sum("adopted").alias("adopted"), F.sum("discarded").alias("discarded"))


def aligned(edges: DataFrame, statistics: DataFrame) -> DataFrame:
    """edges with their adopted and discarded counts, 0 where the traces never met them."""
    return edges.join(statistics, ["level", "src", "dst"], "left").fillna(0, ["adopted", "discarded"])


def edge_seeds(trace: DataFrame) -> DataFrame:
    """level, src, dst, seed: distinct queries that adopted an edge, a row each (no list that grows with the seeds)."""
    return trace.where("adopted = 1").select("level", "src", "dst", F.col("q_id").alias("seed")).distinct()


def cost(trace: DataFrame) -> DataFrame:
    """One row: evaluations (mean), acer (mean of adopted / evaluated), acer_hcnng (sum of adopted / evaluated^2).

    In the last, the entry of each shard counts as adopted and evaluated.
    """
    each = trace.groupBy("q_id").agg(F.sum("adopted").alias("a"), F.count("*").alias("n"), F.count_distinct("shard").alias("s"))
    n = F.col("n") + F.col("s")
    return each.agg(F.avg("n").alias("evaluations"), F.avg(F.col("a") / F.col("n")).alias("acer"), F.sum((F.col("a") + F.col("s")) / (n * n)).alias("acer_hcnng"))


def merged(parts: DataFrame, k: int) -> DataFrame:
    """The k nearest over shards of (q_id, b_id, dist, ...) rows."""
    return ranked(parts.repartition("q_id").dropDuplicates(["q_id", "b_id"]), k)  # dealt once for both

"""Index construction: vector table -> edges (shard, level, src, pos, dst) and nodes (shard, id, level, is_entry).

Vectors are dealt to shards of bounded size by a hash of their id, and every shard is built alone in its task, in
ascending id order and with keyed hashes for every random choice, so the same table always gives the same graph. One
shard is the plain index; many are searched each and merged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import Graph, beam, descend, mixed

#: Vectors of a shard, about.
SHARD_ROWS = 50_000
EDGES = "shard int, level int, src long, pos int, dst long"
NODES = "shard int, id long, level int, is_entry boolean"


def diverse(g: Graph, node: int, candidates: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
    """HNSW's rule: of ascending candidates, keep one if it is no nearer to any kept than to the node; at most `most`.

    Fewer candidates than `most` all stay.
    """
    if len(candidates) < most:
        return candidates
    kept: list[tuple[float, int]] = []
    far, pool = np.array([d for d, _ in candidates]), np.array([v for _, v in candidates])
    near = np.zeros(len(pool), bool)  # nearer to one that is kept
    for i, (d, v) in enumerate(candidates):
        if len(kept) >= most:
            break
        if not near[i]:
            kept.append((d, v))
            near |= ~(g.distances(g.x[v], pool) >= far)
    return kept


#: Pools of at most so many are compared all with all at once.
SMALL_POOL = 40


def robust(g: Graph, node: int, candidates: list[int], alpha: float, most: int) -> list[int]:
    """Vamana's rule: the nearest candidate p stays, and those with alpha * d(p, c) <= d(node, c) go; again until `most`."""
    pool = np.array(sorted({c for c in candidates if c != node}), np.int64)
    if not len(pool):
        return []
    d = g.distances(g.x[node], pool)
    order = np.lexsort((pool, d))
    pool, d, kept = pool[order], d[order], []
    if len(pool) <= SMALL_POOL:
        x = g.x[pool]
        apart = x[None] - x[:, None]
        apart *= apart
        rows = np.packbits(alpha * np.add.reduce(apart, axis=2) > d, axis=1, bitorder="little")  # what stays beside each
        left, wide, rows = (1 << len(pool)) - 1, rows.shape[1], rows.tobytes()
        while left and len(kept) < most:
            p = (left & -left).bit_length() - 1
            kept.append(int(pool[p]))
            left &= int.from_bytes(rows[p * wide : (p + 1) * wide], "little") & ~(1 << p)
        return kept
    while len(pool) and len(kept) < most:
        p = int(pool[0])
        kept.append(p)
        far = alpha * g.distances(g.x[p], pool) > d
        far[0] = False
        pool, d = pool[far], d[far]
    return kept


def _nearest_row(x: np.ndarray) -> int:
    d = x - x.mean(axis=0)
    return int((d * d).sum(axis=1).argmin())


def hnsw(ids: np.ndarray, x: np.ndarray, m: int = 16, efc: int = 96, seed: int = 100) -> tuple[Graph, np.ndarray]:
    """Hierarchical graph by inserts in id order: level floor(-ln U / ln m), m links a level and 2m on level 0."""
    n = len(ids)
    u = np.array([(mixed(seed, int(i)) % (1 << 30) + 1) / (1 << 30) for i in ids])
    level = np.floor(-np.log(u) / np.log(m)).astype(int) if n else np.zeros(0, int)
    none = np.zeros(0, np.int64)
    g = Graph(ids, x, [[none] * n for _ in range(int(level.max(initial=0)) + 1)], 0)
    lists, top = g.lists, int(level[0]) if n else 0
    for node in range(1, n):
        own, q = int(level[node]), x[node]
        g.lists = lists[: top + 1]
        at, dist, _ = descend(g, q, g.entry, down_to=own)
        for lv in range(min(own, top), -1, -1):
            cap = m if lv else 2 * m
            found, _, _ = beam(g, q, at, efc, lv)
            kept = diverse(g, node, found, cap)
            at = kept[0][1]
            lists[lv][node] = np.array([v for _, v in reversed(kept)], np.int64)  # farthest first
            for d, v in kept:
                around = lists[lv][v]
                if len(around) < cap:
                    lists[lv][v] = np.append(around, node)
                else:
                    pool = np.append(around, node)
                    ranked = sorted(zip(g.distances(x[v], pool).tolist(), pool.tolist(), strict=True))
                    lists[lv][v] = np.array([w for _, w in reversed(diverse(g, v, ranked, cap))], np.int64)
        if own > top:
            top, g.entry = own, node
    g.lists = lists[: top + 1]
    return g, level


def vamana(ids: np.ndarray, x: np.ndarray, r: int = 64, lc: int = 256, alphas: tuple[float, ...] = (1.0,), seed: int = 1) -> Graph:
    """Random r-regular start, then for each alpha a pass of search from the medoid, robust pruning and reverse edges.

    One pass with alpha 1 is the "NSG" family, two passes (1, alpha) the Vamana family.
    """
    n = len(ids)
    lists: list[np.ndarray] = []
    for i in range(n):
        others = dict.fromkeys(mixed(seed, int(ids[i]) * 65537 + t) % n for t in range(2 * r))
        lists.append(np.array([o for o in others if o != i][:r], np.int64))
    g = Graph(ids, x, [lists], _nearest_row(x) if n else 0)
    for turn, alpha in enumerate(alphas):
        for node in sorted(range(n), key=lambda i: mixed(seed + turn + 1, int(ids[i]))):
            found, _, expanded = beam(g, x[node], g.entry, lc)
            pool = [v for _, v in found] + expanded + lists[node].tolist()
            lists[node] = np.array(robust(g, node, pool, alpha, r), np.int64)
            for v in lists[node].tolist():
                if node in lists[v]:
                    continue
                if len(lists[v]) < r:
                    lists[v] = np.append(lists[v], node)
                else:
                    lists[v] = np.array(robust(g, v, [*lists[v].tolist(), node], alpha, r), np.int64)
    return g


def capped_tree(x: np.ndarray, cap: int) -> list[tuple[int, int]]:
    """Kruskal over all pairs by (distance, pair), where both ends have fewer than cap links: (a, b), maybe a forest."""
    n = len(x)
    a, b = np.triu_indices(n, 1)
    d = x[a] - x[b]
    d = (d * d).sum(axis=1)
    parent, degree, out = list(range(n)), [0] * n, []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.lexsort((b, a, d)).tolist():
        u, v = int(a[i]), int(b[i])
        if degree[u] < cap and degree[v] < cap and (ru := find(u)) != (rv := find(v)):
            parent[ru] = rv
            degree[u] += 1
            degree[v] += 1
            out.append((u, v))
            if len(out) == n - 1:
                break
    return out


def hcnng(ids: np.ndarray, x: np.ndarray, s: int = 7, trees: int = 15, leaf: int = 1250, seed: int = 1) -> Graph:
    """Union over trees of degree-capped spanning trees in the leaves of random bisections.

    Two random pivots split a set; nearer to the first goes left. A split that leaves a side empty halves the set.
    """
    n = len(ids)
    lists: list[dict[int, None]] = [{} for _ in range(n)]
    for t in range(trees):
        stack = [(np.arange(n), 1)]
        while stack:
            own, path = stack.pop()
            if len(own) <= leaf:
                for u, v in capped_tree(x[own], s):
                    a, b = int(own[u]), int(own[v])
                    lists[a][b] = lists[b][a] = None
                continue
            i = mixed(seed + t, path) % len(own)
            j = (i + 1 + mixed(seed + t, ~path & (1 << 62) - 1) % (len(own) - 1)) % len(own)
            p, q = x[own[i]], x[own[j]]
            left = ((x[own] - p) ** 2).sum(axis=1) < ((x[own] - q) ** 2).sum(axis=1)
            if left.all() or not left.any():
                left = np.arange(len(own)) < len(own) // 2
            stack += [(own[left], 2 * path % (1 << 61)), (own[~left], (2 * path + 1) % (1 << 61))]
    return Graph(ids, x, [[np.array(list(v), np.int64) for v in lists]], 0, random_entry=True)


def _tables(g: Graph, shard: int, level: np.ndarray | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    rows = [(shard, lv, int(g.ids[i]), pos, int(g.ids[v])) for lv, lists in enumerate(g.lists) for i, around in enumerate(lists) for pos, v in enumerate(around.tolist())]
    edges = pd.DataFrame(rows, columns=["shard", "level", "src", "pos", "dst"])
    nodes = pd.DataFrame({"shard": shard, "id": g.ids, "level": np.zeros(len(g.ids), int) if level is None else np.minimum(level, len(g.lists) - 1)})
    nodes["is_entry"] = (np.arange(len(g.ids)) == g.entry) & (not g.random_entry)
    return edges, nodes


FAMILIES: dict[str, Callable[..., Graph | tuple[Graph, np.ndarray]]] = {"hnsw": hnsw, "nsg": vamana, "vamana": lambda ids, x, alpha=1.2, **p: vamana(ids, x, alphas=(1.0, alpha), **p), "hcnng": hcnng}


def sharded(vectors: DataFrame) -> DataFrame:
    """vectors with their shard: as many shards as SHARD_ROWS asks for, by a hash of the id."""
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    own = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))


def _columns(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.drop_duplicates("vec_id").sort_values("vec_id")
    return pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy())


def build(vectors: DataFrame, family: str, **params) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a family: hnsw(m, efc, seed), nsg(r, lc), vamana(r, lc, alpha), hcnng(s, trees, leaf).

    Null embeddings take no part; of rows with one id the first counts. Each shard is built once: edges and nodes are
    read from one written result.
    """
    from ..plans.iterate import checkpointed

    make = FAMILIES[family]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = make(*_columns(pdf), **params)
        g, level = made if isinstance(made, tuple) else (made, None)
        edges, nodes = _tables(g, int(pdf["shard"].iloc[0]), level)
        both = pd.concat([edges.assign(is_entry=None), nodes.rename(columns={"id": "src"}).assign(pos=None, dst=None)])
        return both[["shard", "level", "src", "pos", "dst", "is_entry"]].astype({"pos": "Int32", "dst": "Int64", "is_entry": "boolean"})

    rows = checkpointed(sharded(vectors).groupBy("shard").applyInPandas(run, "shard int, level int, src long, pos int, dst long, is_entry boolean"))
    edges = rows.where("is_entry is null").drop("is_entry")
    return edges, rows.where("is_entry is not null").select("shard", F.col("src").alias("id"), "level", "is_entry")


def sharded_search(edges: DataFrame, nodes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, ef: int, random_entry: bool = False) -> DataFrame:
    """Every query against every shard, in the task that holds the shard; the k nearest overall, with evaluations a shard."""
    from .search import merged, opened, shard_answers

    g = opened(edges, nodes, vectors, random_entry)
    return merged(shard_answers(g, queries, k, ef).where("b_id is not null").select("q_id", "b_id", "dist", "evaluations"), k)


def index_size(edges: DataFrame) -> DataFrame:
    """bytes: 4 for each stored edge."""
    return edges.agg((F.count("*") * 4).alias("bytes"))

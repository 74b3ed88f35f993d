"""Density clustering and indices of cluster quality, over (vec_id, embedding[, label])."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..plans.iterate import checkpointed
from . import knn
from .grid import met
from .network import components
from .vectors import dimensions

NOISE = -1


def dbscan(vectors: DataFrame, eps: float, min_points: int) -> DataFrame:
    """vec_id, cluster: the smallest core id of the cluster, or -1 for noise.

    Core: min_points within distance eps, itself included. A border point joins the cluster of its smallest core
    neighbour's cluster. Distances are Euclidean.
    """
    below = eps * eps * (1 + 1e-12)
    own = vectors.select("vec_id", "embedding")
    core = _near_counts(own, below).where(F.col("n") >= min_points).select(F.col("vec_id").alias("id"))
    core = checkpointed(core)
    kernel = checkpointed(own.join(core.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi"))
    named = checkpointed(components(_forest(kernel, below), core))
    rest = own.join(core.withColumnRenamed("id", "vec_id"), "vec_id", "left_anti")
    border = _least_near(kernel.join(named.withColumnRenamed("id", "vec_id"), "vec_id"), rest, below)
    out = vectors.select("vec_id").join(named.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(border, "vec_id", "left")
    return out.select("vec_id", F.coalesce("component", "near", F.lit(NOISE)).cast("long").alias("cluster"))


def close(q: np.ndarray, x: np.ndarray, below: float) -> np.ndarray:
    """Which squared distances of rows of q and x are under `below`; those that a product of floats can't tell are worked out
    from differences."""
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    scale = max(qq.max(initial=0), xx.max(initial=0))
    kind, error = (np.float32, 2e-5) if scale < 1e30 else (np.float64, 1e-13)
    left = np.concatenate((q, qq[:, None] / -2, np.ones((len(q), 1))), axis=1).astype(kind)
    right = np.concatenate((x, np.ones((len(x), 1)), xx[:, None] / -2), axis=1).astype(kind)
    s = left @ right.T  # half the distances, negated
    near, maybe = s > kind(error * scale - below / 2), s > kind(-error * scale - below / 2)
    if maybe.any() and (np.count_nonzero(maybe) > np.count_nonzero(near)):
        i, j = np.nonzero(maybe & ~near)
        for k in range(0, len(i), 1 << 14):
            a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            apart = q[a] - x[b]
            near[a, b] = (apart * apart).sum(axis=1) < below
    return near


def _near_counts(own: DataFrame, below: float) -> DataFrame:
    """vec_id, n: rows nearer than that, itself included; counted a block at a time, so that no pair leaves a task."""

    def each(ids: np.ndarray, q: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.count_nonzero(close(q, knn.matrix(b.column("embedding")), below), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["vec_id", "n"])

    def added(t: pa.Table) -> pa.Table:
        return t.group_by("vec_id").aggregate([("n", "sum")]).rename_columns(["vec_id", "n"])

    return met(own, own, each, "vec_id long, n long", added).groupBy("vec_id").agg(F.sum("n").alias("n"))


def _forest(own: DataFrame, below: float) -> DataFrame:
    """src, dst: links that join what pairs under `below` join, at most one for each row of a cell of the grid."""

    def whole(ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> pa.Table:
        n, out = len(ids), []
        place = np.arange(n)  # a group's least row
        for b in batches:
            other = b.column("vec_id").to_numpy()
            x = knn.matrix(b.column("embedding"))
            group = np.concatenate((place, n + np.arange(len(x))))
            for i, j in ((i, j) for i in range(0, n, 1024) for j in range(0, len(x), 1024)):
                u, v = np.nonzero(close(q[i : i + 1024], x[j : j + 1024], below))
                apart = group[i + u] != group[n + j + v]
                if apart.any():
                    u, v = i + u[apart], j + v[apart]
                    _, first = np.unique(group[u] * (n + len(x)) + group[n + v], return_index=True)
                    u, v = u[first], v[first]
                    links, group = united(group, u, n + v)
                    out.append((ids[u[links]], other[v[links]]))
            place = group[:n]
        src, dst = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return met(own, own, None, "src long, dst long", whole=whole).where("src <> dst").distinct()


def united(group: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the links u, v join two groups, the groups after them); a group is named by its least row."""
    above: dict[int, int] = {}

    def top(g: int) -> int:
        while (t := above.get(g, g)) != g:
            above[g] = above.get(t, t)
            g = t
        return g

    links = []
    for k, (a, b) in enumerate(zip(group[u].tolist(), group[v].tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            links.append(k)
    now = np.arange(len(group))
    old = np.fromiter(above, np.int64, len(above))
    now[old] = [top(g) for g in old.tolist()]
    return np.array(links, np.int64), now[group]


def _least_near(kernel: DataFrame, rest: DataFrame, below: float) -> DataFrame:
    """vec_id, near: the least component of the kernel's rows nearer than that, for the rest that have one."""

    def each(ids: np.ndarray, q: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        near = close(q, knn.matrix(b.column("embedding")), below)
        some = near.any(axis=1)
        of = np.where(near[some], b.column("component").to_numpy(), np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(of)], ["vec_id", "near"])

    def least(t: pa.Table) -> pa.Table:
        return t.group_by("vec_id").aggregate([("near", "min")]).rename_columns(["vec_id", "near"])

    return met(kernel.select("vec_id", "embedding", F.col("component").cast("long").alias("component")), rest, each, "vec_id long, near long", least).groupBy("vec_id").agg(F.min("near").alias("near"))


def silhouette(vectors: DataFrame) -> DataFrame:
    """One row: silhouette, the mean over all rows; rows of negative label are skipped but counted in the mean.

    Mean distances to each cluster come from all pairs, made a bounded block of rows at a time and summed by cluster
    before they leave a task. A row alone in its cluster, or without another cluster, counts 0.
    """
    labelled = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    sums = _sums_to_clusters(labelled.where("label >= 0"))
    size = labelled.where("label >= 0").groupBy("label").agg(F.count("*").alias("size"))
    own = labelled.where("label >= 0").select("vec_id", F.col("label").alias("own"))
    means = sums.join(own, "vec_id").join(size, "label").select("vec_id", "own", "label", "size", F.when(F.col("label") == F.col("own"), F.col("total") / F.greatest(F.col("size") - 1, F.lit(1))).otherwise(F.col("total") / F.col("size")).alias("mean"))
    each = means.groupBy("vec_id").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("mean"))).alias("a"), F.max(F.when(F.col("label") == F.col("own"), F.col("size"))).alias("s"), F.min(F.when(F.col("label") != F.col("own"), F.col("mean"))).alias("b"))
    score = F.when((F.col("s") > 1) & F.col("b").isNotNull() & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    n = labelled.agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum(score), F.lit(0.0)).alias("t")).join(F.broadcast(n)).select((F.col("t") / F.col("n")).alias("silhouette"))


#: A squared distance under this share of the norms is worked out again from differences: a product has lost its digits.
CLOSE = 1e-6


def distance_sums(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row of q the sum of its distances to the rows of x, by products, a million distances at a time; of rows
    that are close for their norms, from differences."""
    out, step = np.zeros(len(q)), max(1, (1 << 20) // max(1, len(q)))
    own = (q * q).sum(axis=1)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        norms = own[:, None] + (part * part).sum(axis=1)
        d = q @ part.T
        d *= -2
        d += norms
        i, j = np.nonzero(d <= CLOSE * norms)
        d[i, j] = 0
        np.sqrt(d, out=d)
        out += d.sum(axis=1)
        for k in range(0, len(i), 1 << 14):
            apart = q[i[k : k + (1 << 14)]] - part[j[k : k + (1 << 14)]]
            out += np.bincount(i[k : k + (1 << 14)], np.sqrt((apart * apart).sum(axis=1)), minlength=len(q))
    return out


def _sums_to_clusters(labelled: DataFrame) -> DataFrame:
    """vec_id, label, total: the sum of distances from each row to the rows of each label."""

    def each(ids: np.ndarray, q: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        label, x = b.column("label").to_numpy(), knn.matrix(b.column("embedding"))
        found = np.unique(label)
        sums = np.concatenate([distance_sums(q, x[label == c]) for c in found])
        return pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(found))), pa.array(np.repeat(found, len(ids))), pa.array(sums)], ["vec_id", "label", "part"])

    def added(t: pa.Table) -> pa.Table:
        """Sums by row and label, so that a task or cell sends one for each."""
        return t.group_by(["vec_id", "label"]).aggregate([("part", "sum")]).rename_columns(["vec_id", "label", "part"])

    out = met(labelled.select("vec_id", "embedding", "label"), labelled, each, "vec_id long, label long, part double", added)
    return out.groupBy("vec_id", "label").agg(F.sum("part").alias("total"))


def _centres(vectors: DataFrame) -> DataFrame:
    """label, dim, mean, size."""
    d = dimensions(vectors).join(vectors.select("vec_id", F.col("label").cast("long").alias("label")), "vec_id")
    return d.groupBy("label", "dim").agg(F.avg("value").alias("mean"), F.count("*").alias("size"))


def _to_centres(vectors: DataFrame) -> DataFrame:
    """vec_id, label, sq: squared distance of each row to its cluster's centre."""
    c = _centres(vectors).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("_c"))
    own = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return own.join(c, "label").select("vec_id", "label", metrics.squared_l2(F.col("embedding"), F.col("_c")).alias("sq"))


def calinski_harabasz(vectors: DataFrame) -> DataFrame:
    """One row: textbook score, and total_over_plain: (total squares / (k - 1)) / (unsquared distances / (n - k))."""
    c = _centres(vectors)
    total = dimensions(vectors).groupBy("dim").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("*").alias("n"))
    between = c.join(total, "dim").agg(F.sum(F.col("size") * (F.col("mean") - F.col("m")) * (F.col("mean") - F.col("m"))).alias("b"), F.count_distinct("label").alias("k"))
    whole = total.agg(F.sum(F.col("v") * F.col("n")).alias("t"), F.max("n").alias("n"))
    inside = _to_centres(vectors).agg(F.sum("sq").alias("w"), F.sum(F.sqrt("sq")).alias("u"))
    row = F.broadcast(between).join(whole).join(inside)
    k, n = F.col("k"), F.col("n")
    return row.select((F.col("b") / (k - 1) / (F.col("w") / (n - k))).alias("calinski_harabasz"), (F.col("t") / (k - 1) / (F.col("u") / (n - k))).alias("total_over_plain"))


def davies_bouldin(vectors: DataFrame) -> DataFrame:
    """One row: the mean over clusters of the greatest (s_i + s_j) / distance of centres; pairs of clusters, not rows."""
    s = _to_centres(vectors).groupBy("label").agg(F.avg(F.sqrt("sq")).alias("s"))
    c = _centres(vectors)
    d = c.alias("a").join(c.alias("b"), "dim").where("a.label <> b.label").groupBy(F.col("a.label").alias("i"), F.col("b.label").alias("j")).agg(F.sqrt(F.sum((F.col("a.mean") - F.col("b.mean")) * (F.col("a.mean") - F.col("b.mean")))).alias("d"))
    r = d.join(s.select(F.col("label").alias("i"), F.col("s").alias("si")), "i").join(s.select(F.col("label").alias("j"), F.col("s").alias("sj")), "j")
    return r.groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("d")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))

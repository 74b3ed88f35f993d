"""Embedding near-duplicates by a random-projection tree forest.

Every tree splits recursively at the median of a random projection, and vectors near a split go to both sides (spill).
The splits' medians are fitted on a bounded sample (SAMPLE); every vector is routed. Pairs are compared within leaves
only; a large leaf is a grid of bounded cells. A pair that shares several leaves counts in the first of them, so links
are counted without listing pairs. Equal vectors are one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written
from .simhash_bk import roots_after

THRESHOLD = 0.9
TREES = 5
#: Distinct vectors that the splits are fitted on at most, chosen by a hash of their id.
SAMPLE = 16384
#: A node with fewer sampled vectors is not split.
LEAST_FIT = 16
#: Vectors that a leaf should hold.
LEAF = 256
#: Spill to each side of a split, in standard deviations of a projected pair at the threshold.
SPILL = 0.6
#: Rows of a cell's side.
CELL = 1024
SEED = 7


class Forest:
    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, threshold: float = THRESHOLD, seed: int = SEED):
        """sample: unit rows; total: how many vectors will be routed."""
        rng = np.random.default_rng(seed)
        dim = sample.shape[1] if len(sample) else 1
        self.depth = max(0, int(np.ceil(np.log2(max(1, total) / leaf))))
        self.depth = min(self.depth, int(np.log2(max(1, len(sample) / LEAST_FIT))))
        self.trees, self.width = trees, 1 << self.depth
        self.margin = SPILL * np.sqrt(2 - 2 * threshold) / np.sqrt(dim)
        self.planes = rng.normal(size=(trees, self.width, dim))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, self.width))
        for t in range(trees):
            at = np.ones(len(sample), np.int64)  # nodes as in a heap: 1 is the root, 2n and 2n + 1 its children
            for _ in range(self.depth):
                p = (sample * self.planes[t][at]).sum(axis=1)
                for node in np.unique(at):
                    self.cuts[t, node] = np.median(p[at == node])
                at = 2 * at + (p > self.cuts[t][at])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit rows x: all leaves of all trees, ascending by row and leaf."""
        dim = self.planes.shape[2]
        x = np.pad(x, ((0, 0), (0, max(0, dim - x.shape[1]))))[:, :dim]
        rows, found = [], []
        for t in range(self.trees):
            row, at = np.arange(len(x)), np.ones(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", x[row], self.planes[t][at]) - self.cuts[t][at]
                left, right = p <= self.margin, p > -self.margin
                row, at = np.concatenate((row[left], row[right])), np.concatenate((2 * at[left], 2 * at[right] + 1))
            rows.append(row), found.append(t * self.width + at - self.width)
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of each dimension, and their unit vectors (double)."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate(([0], np.cumsum(size)))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """A cell's rows -> rep, links (weighted by the partners' counts) and root: the smallest rep it is joined with here."""
    leaf, first, second = (int(pdf[c].iloc[0]) for c in ("leaf", "ci", "cj"))
    pdf = pdf.sort_values("rep", ignore_index=True)
    x = np.frombuffer(b"".join(pdf["unit"]), "<f8").reshape(len(pdf), -1)
    rep, n = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
    a, b = (np.flatnonzero(pdf["chunk"] == c) for c in (first, second))
    hit = x[a] @ x[b].T >= THRESHOLD
    if first == second:
        hit = np.triu(hit, 1)
    ra, rb = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    links, parent = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    if len(ra):
        hit, a, b = hit[np.ix_(ra, rb)], a[ra], b[rb]
        earlier = [np.asarray(v)[np.asarray(v) < leaf] for v in pdf["leaves"]]
        names, index = np.unique(np.concatenate(earlier), return_inverse=True)
        member = np.zeros((len(pdf), len(names)), np.float32)
        member[np.repeat(np.arange(len(pdf)), [len(e) for e in earlier]), index] = 1
        hit &= member[a] @ member[b].T == 0  # else it counts in an earlier leaf
        links[a] += hit @ n[b]
        np.add.at(links, b, n[a] @ hit)
        i, j = np.nonzero(hit)
        parent = roots_after(parent, a[i], b[j])
    keep = links > 0
    return pd.DataFrame({"rep": rep[keep], "links": links[keep], "root": rep[parent[keep]]})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept: a row for each row.

    Linked: cosine >= THRESHOLD, in double precision. Vectors that are null, empty or zero, hold null or non-finite
    components, differ in length, or have no vec_id link with nothing (without a vec_id: component null, kept).
    Repeated rows and equal vectors link with each other. An empty table gives an empty one; other columns, whatever their
    names, play no part.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    own = own.withColumn("fine", F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False))).withColumn("h", F.xxhash64("embedding"))
    good = own.where("fine").select("vec_id", "embedding", "h")
    classes = written(good.groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "embedding-classes")
    total = classes.count()
    picked = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    sampled = max((x for _, x in _units(picked)), key=len) if len(picked) else np.zeros((0, 1))
    forest = spark.sparkContext.broadcast(Forest(sampled, total))  # bounded by the sample

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        for b in batches:
            for _, x in _units(b.column("embedding")):
                for leaf, k in zip(*np.unique(forest.value.leaves(x)[1], return_counts=True), strict=True):
                    count[x.shape[1], int(leaf)] = count.get((x.shape[1], int(leaf)), 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array([f(k, v) for k, v in count.items()], pa.int64()) for f in (lambda k, v: k[0], lambda k, v: k[1], lambda k, v: v)], ["dim", "leaf", "k"])

    held = classes.select("embedding").mapInArrow(sizes, "dim long, leaf long, k long").groupBy("dim", "leaf").agg(F.sum("k").alias("k")).collect()
    chunks = spark.sparkContext.broadcast({(r.dim, r.leaf): -(-r.k // CELL) for r in held if r.k > CELL})  # leaves are bounded by the sample

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                reps, counts = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
                for rows, x in _units(batch.column("embedding")):
                    row, leaf = forest.value.leaves(x)
                    every = np.split(leaf, np.flatnonzero(np.diff(row)) + 1)
                    raw = [v.astype("<f8").tobytes() for v in x]
                    out = []
                    for r, lf in zip(row.tolist(), leaf.tolist(), strict=True):
                        k = chunks.value.get((x.shape[1], lf), 1)
                        c = int(reps[rows[r]] * 0x9E3779B1 >> 7) % k
                        out += [(lf, min(c, o), max(c, o), c, r) for o in range(k)]
                    lf, ci, cj, c, r = (np.array(v) for v in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r), x.shape[1])), pa.array(lf), pa.array(ci), pa.array(cj), pa.array(c), pa.array(reps[rows[r]]), pa.array(counts[rows[r]]), pa.array([raw[i] for i in r.tolist()], pa.binary()), pa.array([every[i] for i in r.tolist()], pa.list_(pa.int64()))],
                        ["dim", "leaf", "ci", "cj", "chunk", "rep", "n", "unit", "leaves"],
                    )

    cells = classes.mapInArrow(routed, "dim long, leaf long, ci long, cj long, chunk long, rep long, n long, unit binary, leaves array<long>")
    found = written(cells.groupBy("dim", "leaf", "ci", "cj").applyInPandas(_cell, "rep long, links long, root long"), "embedding-links")
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(named, ["h", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = own.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Inverted-file index: centroids (cid, embedding), assignments (vec_id, cid, dist), probe search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.iterate import checkpointed
from . import knn, vectors


def first_centroids(base: DataFrame, cells: int) -> DataFrame:
    """The vectors of least id, numbered from 0."""
    first = base.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).orderBy("vec_id").limit(cells)
    return first.select((F.row_number().over(Window.orderBy("vec_id")) - 1).cast("long").alias("cid"), "embedding")  # `cells` rows


def train(base: DataFrame, cells: int, rounds: int) -> DataFrame:
    """Centroids after so many k-means rounds; a cell without vectors keeps its centroid."""
    centroids = checkpointed(first_centroids(base, cells))
    for _ in range(rounds):
        centroids = checkpointed(vectors.inverted_file_step(base, centroids)[1])
    return centroids


def assign(base: DataFrame, centroids: DataFrame) -> DataFrame:
    return vectors.nearest_centroid(base, centroids)


def list_sizes(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """cid, size, ends: rows of each list, and their running sum in cid order (a window over `cells` rows)."""
    size = assigned.groupBy("cid").agg(F.count("*").alias("size"))
    all_ = centroids.select("cid").join(size, "cid", "left").fillna(0, ["size"])
    return all_.withColumn("ends", F.sum("size").over(Window.orderBy("cid")))


def probe(base: DataFrame, assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """q_id, rank, b_id, dist among the lists of each query's nearest centroids; ids are the rows' own."""
    asked = vectors._nearest(queries, centroids, probes).select("vec_id", "cid")
    return knn.exact_by_key(base.join(assigned.select("vec_id", "cid"), "vec_id"), queries.join(asked, "vec_id"), "cid", k)


def index_size(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """bytes: 4 for each centroid component, 8 for each list's end, 4 for each entry."""
    c = centroids.agg(F.sum(F.size("embedding") * 4 + 8).alias("c"))
    return assigned.agg((F.count("*") * 4).alias("a")).join(F.broadcast(c)).select((F.col("a") + F.col("c")).alias("bytes"))

"""Statistics and preparation of vector tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics
from . import knn


def dimensions(vectors: DataFrame) -> DataFrame:
    """vec_id, dim (from 0), value: a row for each component."""
    return vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select("vec_id", "dim", F.col("x").cast("double").alias("value"))


def moments(vectors: DataFrame) -> DataFrame:
    """dim, mean, var_pop, skewness, kurtosis (excess), all of the population."""
    x = F.col("value")
    own = dimensions(vectors).groupBy("dim")
    return own.agg(F.avg(x).alias("mean"), F.var_pop(x).alias("var_pop"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))


def centre(vectors: DataFrame) -> DataFrame:
    """One row: embedding, the mean of each component."""
    means = dimensions(vectors).groupBy("dim").agg(F.avg("value").alias("mean"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("embedding"))  # as many rows as dimensions


def medoid(vectors: DataFrame) -> DataFrame:
    """One row: vec_id and dist of the vector nearest to the centre, ties to the smaller id."""
    c = F.broadcast(centre(vectors).withColumnRenamed("embedding", "_c"))  # one row
    d = vectors.join(c).select("vec_id", metrics.squared_l2(F.col("embedding"), F.col("_c")).alias("dist"))
    return d.agg(F.min(F.struct("dist", "vec_id")).alias("m")).select("m.vec_id", "m.dist")


def bounds(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.min(F.array_min("embedding")).cast("double").alias("low"), F.max(F.array_max("embedding")).cast("double").alias("high"))


def minmax_scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding with every dimension scaled to [0, 1]; constant dimensions give 0."""
    span = dimensions(vectors).groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    arrays = span.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("_s"))  # as many as dimensions
    scaled = F.zip_with("embedding", "_s", lambda x, s: F.when(s["hi"] > s["lo"], (x.cast("double") - s["lo"]) / (s["hi"] - s["lo"])).otherwise(0.0))
    return vectors.join(F.broadcast(arrays)).select("vec_id", scaled.alias("embedding"))


def projected(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """vec_id, embedding times a (dimensions, n) matrix of literals."""
    columns = [F.array(*[F.lit(float(w)) for w in weights[:, j]]) for j in range(weights.shape[1])]
    return vectors.select("vec_id", F.array(*[metrics.dot(F.col("embedding"), c) for c in columns]).alias("embedding"))


def gaussian_projection(dim: int, n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, n)) / np.sqrt(n)


def mips_augmented(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding with sqrt(max norm^2 - norm^2) appended: nearest by cosine are then greatest by inner product."""
    squared = metrics.dot(F.col("embedding"), F.col("embedding"))
    top = F.broadcast(vectors.agg(F.max(squared).alias("_m")))
    extra = F.sqrt(F.greatest(F.lit(0.0), F.col("_m") - squared))
    return vectors.join(top).select("vec_id", F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(extra)).alias("embedding"))


def mips_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.lit(0.0))).alias("embedding"))


def keyed_hash(key: Column) -> Column:
    """A deterministic order of integer keys that any SQL engine can compute (Knuth's multiplier, fixed value)."""
    return F.pmod(key.cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(38,0)"), F.lit(4294967296).cast("decimal(38,0)")).cast("long")


def split(vectors: DataFrame, test_share: float) -> DataFrame:
    """vectors with is_test: rows whose hash falls below the share; a row's side depends on its id alone."""
    return vectors.withColumn("is_test", keyed_hash(F.col("vec_id")) < int(test_share * 4294967296))


def seeds(vectors: DataFrame, share: float) -> DataFrame:
    """vec_id of max(1, round(share * n)) rows, those of least hash."""
    n = vectors.count()
    return vectors.select("vec_id").orderBy(keyed_hash(F.col("vec_id")), "vec_id").limit(max(1, int(share * n + 0.5)))


def inverted_file_step(vectors: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cid, dist of the nearest centroid; cid, embedding of new centroids). Empty cells keep theirs."""
    spot = nearest_centroid(vectors, centroids)
    moved = vectors.join(spot.select("vec_id", "cid"), "vec_id").select("cid", F.posexplode("embedding").alias("dim", "x"))
    means = moved.groupBy("cid", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    new = means.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("_new"))
    kept = centroids.join(new, "cid", "left").select("cid", F.coalesce("_new", F.transform("embedding", lambda x: x.cast("double"))).alias("embedding"))
    return spot, kept


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, cid, dist; centroids are a small stated set, broadcast by knn in blocks."""
    return _nearest(vectors, centroids, 1).select("vec_id", "cid", "dist")


def _nearest(vectors: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """vec_id, cid, dist, rank: the nearest centroids of each vector. Every task holds the centroids."""
    found = knn._compared(vectors, centroids.select(F.col("cid").alias("vec_id"), "embedding"), _closest(probes))
    # here the centroids are what is broadcast: q_id is a centroid and b_id a vector
    order = Window.partitionBy("b_id").orderBy("dist", "q_id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= probes)
    return out.select(F.col("b_id").alias("vec_id"), F.col("q_id").alias("cid"), "dist", "rank")


def _closest(probes: int):
    def keep(ids, q, own, x):
        d = knn._ALL["squared_l2"](q, x)
        bound = np.partition(d, min(probes, len(q)) - 1, axis=0)[min(probes, len(q)) - 1]
        i, j = np.nonzero(d <= bound + 1e-9 * np.maximum(1, np.abs(bound)))
        return i, j, knn._PAIRED["squared_l2"](q[i], x[j])

    return keep

"""Deterministic synthetic tables: each row follows from its number and the seed, wherever it is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, n: int, schema: str, make) -> DataFrame:
    """make(ids) -> arrays, for stretches of row numbers."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(make(b.column(0).to_numpy()), names)

    return spark.range(n).mapInArrow(run, schema)


def _list(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), kind))


def blobs(spark: SparkSession, n: int, dims: int, centres: int = 100, spread: float = 1.0, seed: int = 1) -> DataFrame:
    """vec_id, embedding, label: points around centres drawn uniformly from [-10, 10]."""
    middle = np.random.default_rng(seed).uniform(-10, 10, (centres, dims))

    def make(ids: np.ndarray):
        label = ids % centres
        noise = np.stack([np.random.default_rng((seed, int(i))).normal(0, spread, dims) for i in ids]) if len(ids) else np.zeros((0, dims))
        return [pa.array(ids), _list((middle[label] + noise).astype(np.float32), pa.float32()), pa.array(label.astype(np.int32))]

    return _rows(spark, n, "vec_id long, embedding array<float>, label int", make)


def bits(spark: SparkSession, n: int, dims: int, centres: int = 100, seed: int = 1) -> DataFrame:
    """vec_id, bits: blobs, positive or not."""
    return blobs(spark, n, dims, centres, seed=seed).select("vec_id", F.transform("embedding", lambda x: x > 0).alias("bits"))


def sets(spark: SparkSession, n: int, size: int, universe: int, seed: int = 1) -> DataFrame:
    """id, items: `size` different items of the universe, ascending."""

    def make(ids: np.ndarray):
        x = np.stack([np.sort(np.random.default_rng((seed, int(i))).choice(universe, size, replace=False)) for i in ids]) if len(ids) else np.zeros((0, size), int)
        return [pa.array(ids), _list(x.astype(np.int32), pa.int32())]

    return _rows(spark, n, "id long, items array<int>", make)


def tagged(vectors: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(base, queries) of a two-tag filter task: the first half of the base has tags {1, 2}, the rest {3, 4}; queries the reverse."""
    first, second = F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))
    early = F.col("vec_id") < n // 2
    return vectors.withColumn("tags", F.when(early, first).otherwise(second)), vectors.withColumn("tags", F.when(early, second).otherwise(first))

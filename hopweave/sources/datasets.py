"""A dataset as one folder: train, test, and the exact neighbours of test in train."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knn, vectors as statistics
from . import vecfiles


def save_dense(train: DataFrame, test: DataFrame, path: str, metric: str = "squared_l2", count: int = 100, vec_layout: str | None = None) -> None:
    """(vec_id, embedding) tables; with a layout, the vector files and an ivecs of neighbours besides Parquet."""
    truth = knn.exact(train, test, count, metric).select("q_id", "rank", "b_id", "dist")
    for name, df in (("train", train), ("test", test), ("neighbours", truth)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if vec_layout:
        vecfiles.write(train, f"{path}/train.{vec_layout}", vec_layout)
        vecfiles.write(test, f"{path}/test.{vec_layout}", vec_layout)
        rows = truth.groupBy(F.col("q_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b_id"))), lambda s: s["b_id"]).alias("embedding"))  # `count` a query
        vecfiles.write(rows, f"{path}/gt.ivecs", "ivecs")
    _describe(train.sparkSession, path, {"metric": metric, "count": count, "type": "dense"})


def save_sets(train: DataFrame, test: DataFrame, path: str, count: int = 100) -> None:
    """(id, items) tables with exact Jaccard neighbours; pairs without a common item are no neighbours."""
    truth = knn.jaccard(train, test, count).select("q_id", "rank", "b_id", "dist")
    for name, df in (("train", train), ("test", test), ("neighbours", truth)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    _describe(train.sparkSession, path, {"metric": "jaccard", "count": count, "type": "sparse"})


def _describe(spark: SparkSession, path: str, what: dict) -> None:
    spark.createDataFrame([(json.dumps(what),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, description)."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("train", "test", "neighbours")}, meta


def prepare(vectors: DataFrame, path: str, test_share: float = 0.1, metric: str = "squared_l2", count: int = 100) -> None:
    """Split by a keyed hash of the id, then save_dense."""
    rows = statistics.split(vectors, test_share)
    save_dense(rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test"), path, metric, count)

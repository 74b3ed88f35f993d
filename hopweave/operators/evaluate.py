"""Recall/cost frontiers and logs of (iter, k, recall, cost) rows. Cost is whatever is given: evaluations or 1/QPS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import interpolated
from ..plans.iterate import checkpointed

#: Recalls that runs are compared at (fixed values).
LEVELS = (0.6, 0.7, 0.8, 0.9, 0.92, 0.94, 0.96, 0.97, 0.98, 0.99)


def frontier(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(recall, qps) points that no point of higher (or equal, earlier) recall matches or beats in qps; `by` has no nulls.

    Points are dealt by ranges of their order, so no task holds all of them: what goes before a range is the greatest qps
    of the ranges before, and within it a running maximum.
    """
    keys, order = by or [], [F.desc("recall"), F.desc("qps")]
    rows = checkpointed(points.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    tops = rows.groupBy(*keys, "_range").agg(F.max("qps").alias("_top")).withColumn("_ahead", F.max("_top").over(ahead)).drop("_top")
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.max("qps").over(own), F.col("_ahead"))  # null where nothing goes before
    met = rows.join(F.broadcast(tops), [*keys, "_range"]).withColumn("_best", best)
    return met.where(F.col("_best").isNull() | (F.col("qps") > F.col("_best"))).select(*points.columns)


def at_recalls(points: DataFrame, by: list[str], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """by..., level, qps: linear interpolation between neighbouring points; 0 outside the observed range."""
    order = Window.partitionBy(*by).orderBy("recall", "qps")
    pairs = points.withColumn("r1", F.lead("recall").over(order)).withColumn("q1", F.lead("qps").over(order))
    asked = pairs.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    inside = (F.col("level") >= F.col("recall")) & (F.col("level") <= F.coalesce("r1", "recall"))
    value = F.when(inside, interpolated(F.col("recall"), F.col("qps"), F.coalesce("r1", "recall"), F.coalesce("q1", "qps"), F.col("level")))
    # a level that is a point's own recall has two neighbouring stretches, with one value
    return asked.groupBy(*by, "level").agg(F.coalesce(F.max(value), F.lit(0.0)).alias("qps"))


def latest_and_previous(log: DataFrame, by: list[str]) -> DataFrame:
    """by..., age (1 latest, 2 previous) and the log's columns."""
    order = Window.partitionBy(*by).orderBy(F.desc("iter"))
    return log.withColumn("age", F.row_number().over(order)).where("age <= 2")


def improvement(log: DataFrame, by: list[str], least_recall: float = 0.9) -> DataFrame:
    """by..., ratio: mean of latest / previous qps over their common recall levels from least_recall up."""
    two = latest_and_previous(log.select(*by, "iter").distinct(), by)
    rows = log.join(two, [*by, "iter"]).where((F.col("level") >= least_recall) & (F.col("qps") > 0))
    now = rows.where("age = 1").select(*by, "level", F.col("qps").alias("now"))
    old = rows.where("age = 2").select(*by, "level", F.col("qps").alias("old"))
    return now.join(old, [*by, "level"]).groupBy(*by).agg(F.avg(F.col("now") / F.col("old")).alias("ratio"))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("header", True).csv(path)


def read_log(spark, path: str, schema: str) -> DataFrame:
    """Rows of CSV logs; a field that does not parse is null, and rows without a recall are left out."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path).where("recall is not null")

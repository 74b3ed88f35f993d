"""Help for iterative plans: lineage is cut by checkpoints in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder made here where that is unset on a local master, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_hopweave_dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.sparkContext._hopweave_dir = "file://" + tempfile.mkdtemp(prefix="hopweave-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hopweave/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with its row number (from 1) by a total order within each `by`, where no task holds a whole group.

    Rows are dealt by ranges of the order; a row's number is its place in its range and the sizes of the ranges before.
    """
    rows = checkpointed(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = rows.groupBy(*by, "_range").agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(sizes.drop("_size")), [*by, "_range"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_range", "_before")

"""Shared folder, written intermediate tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (on a local master, as in tests) one made here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_hopweave_dir", None) or "file://" + tempfile.mkdtemp(prefix="hopweave-")
        spark.sparkContext._hopweave_dir = base
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a written table; removed when the application ends."""
    path = f"{shared_dir(spark)}/hopweave/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone already
            _drop(spark, path)

    atexit.register(drop)
    return path


#: Spark deletes a statement's shuffle files when it ends, not when the driver's JVM comes to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors cost no recomputation.

    What led to it is needed no more: the shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    spark.sparkContext._jvm.System.gc()  # and those of counts and other statements
    out = spark.read.schema(df.schema).parquet(path)
    out._hopweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        _drop(t.sparkSession, t._hopweave_path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Batches for Python hold whole texts, however long: fewer rows than Spark's default, unless the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def keyed(docs: DataFrame) -> DataFrame:
    """documents as (doc_id, text) only: other columns, whatever their names, play no part."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (node, component): component is the smallest node reachable.

    Alternating large-star and small-star rounds, each round written by checkpoint(); nodes without links are
    absent. Rows with nulls and self links are ignored.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = e.checkpoint(), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(least.select("u", "m")).distinct().checkpoint()

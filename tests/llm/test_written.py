import time

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from hopweave.llm import common

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_a_write_leaves_no_shuffle_files(spark, monkeypatch):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if f.endswith(".data") and "shuffle_" in f}

    real, seen = DataFrameWriter.parquet, []

    def parquet(self, path):
        before = shuffled()
        real(self, path)
        wait = time.time() + 5  # files go a moment after the write
        while shuffled() - before and time.time() < wait:
            time.sleep(0.05)
        seen.append(shuffled() - before)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    held = spark.range(1000).withColumn("x", F.rand(1)).repartition(4, "id")
    assert held.count() == 1000  # this plan stays in use
    setting = spark.conf.get(SETTING)
    assert common.written(held.sortWithinPartitions("x"), "t").count() == 1000
    assert seen == [set()]
    assert spark.conf.get(SETTING) == setting and held.count() == 1000
    with pytest.raises(Exception, match="no such"):
        common.written(spark.range(3).select(F.raise_error(F.lit("no such row"))), "t")
    assert spark.conf.get(SETTING) == setting

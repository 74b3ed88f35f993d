"""Answers of shards are dealt once to be merged."""

from pyspark.sql import functions as F

from hopweave.operators import search


def test_answers_are_dealt_once(spark):
    rows = spark.range(4000).select((F.col("id") % 100).alias("q_id"), (F.col("id") * 7 % 61).alias("b_id"), (F.col("id") * 7 % 61 / 3).alias("dist"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = search.merged(rows, 5)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    want = {}
    for i in range(4000):
        want.setdefault(i % 100, set()).add(i * 7 % 61)
    assert {(r.q_id, r.rank, r.b_id) for r in got.collect()} == {(q, i + 1, b) for q, s in want.items() for i, b in enumerate(sorted(s)[:5])}

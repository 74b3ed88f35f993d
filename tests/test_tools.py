import numpy as np
import pytest

from hopweave.functions import metrics
from hopweave.operators import evaluate, index, ivf, knn, textsets
from hopweave.plans import cli
from hopweave.sources import datasets, generate, results, vecfiles


def frame(spark, n=120, dim=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def test_generated_tables_do_not_depend_on_partitions(spark):
    a = generate.blobs(spark, 50, 4, 5).repartition(7).orderBy("vec_id").collect()
    b = generate.blobs(spark, 50, 4, 5).coalesce(1).orderBy("vec_id").collect()
    assert a == b and {r.label for r in a} == set(range(5))
    assert len(generate.bits(spark, 5, 9, 3).first().bits) == 9
    assert all(len(set(r["items"])) == 6 == len(r["items"]) and r["items"] == sorted(r["items"]) for r in generate.sets(spark, 20, 6, 10).collect())
    base, queries = generate.tagged(generate.blobs(spark, 10, 2, 2), 10)
    assert base.where("vec_id = 0").first().tags == [1, 2] and queries.where("vec_id = 0").first().tags == [3, 4]


def test_dataset_folders(spark, tmp_path):
    v = frame(spark)
    datasets.prepare(v, str(tmp_path / "d"), 0.2, count=5)
    tables, meta = datasets.load(spark, str(tmp_path / "d"))
    assert meta["count"] == 5 and tables["train"].count() + tables["test"].count() == 120
    assert tables["neighbours"].count() == 5 * tables["test"].count()
    datasets.save_dense(v, v.where("vec_id < 3"), str(tmp_path / "e"), count=4, vec_layout="fvecs")
    gt = vecfiles.read(spark, str(tmp_path / "e/gt.ivecs"), "ivecs").orderBy("vec_id").collect()
    assert [r.embedding[0] for r in gt] == [0, 1, 2]
    s = generate.sets(spark, 40, 5, 12)
    datasets.save_sets(s, s.where("id < 4"), str(tmp_path / "s"), 3)
    assert datasets.load(spark, str(tmp_path / "s"))[1]["metric"] == "jaccard"


def test_index_handles(spark, tmp_path):
    v = frame(spark)
    q = v.where("vec_id < 10")
    truth = knn.exact(v, q, 5)
    for family, params in (("hnsw", {"m": 6, "efc": 30}), ("hcnng", {"s": 4, "trees": 5, "leaf": 40})):
        i = index.GraphIndex(family, **params).build(v)
        found = i.search(q, 5, 60)
        assert knn.recall(found, truth, 5).first()[0] > 0.9
        assert i.comparisons_and_clear() > 0 == i.comparisons_and_clear()
        assert i.index_size() == 4 * i.edges.count()
        i.save(str(tmp_path / family))
        again = index.GraphIndex.load(spark, str(tmp_path / family), v)
        assert sorted(map(tuple, again.search(q, 5, 60).collect())) == sorted(map(tuple, found.collect()))
    inverted = index.InvertedIndex(8, 2).build(v)
    assert knn.recall(inverted.search(q, 5, 8), truth, 5).first()[0] == 1.0
    assert inverted.index_size() == 4 * 120 + 8 * (6 * 4 + 8)
    with pytest.raises(ValueError, match="family"):
        index.GraphIndex("other")


def test_inverted_files_round_trip(spark, tmp_path):
    v = frame(spark)
    c = ivf.train(v, 5, 2)
    a = ivf.assign(v, c)
    results.write_ivf(c, a, str(tmp_path / "i"), 2)
    c2, a2 = results.read_ivf(spark, str(tmp_path / "i"), 6)
    assert sorted(map(tuple, a2.collect())) == sorted(map(tuple, a.select("vec_id", "cid").collect()))
    assert np.allclose([r.embedding for r in c2.orderBy("cid").collect()], [r.embedding for r in c.orderBy("cid").collect()], atol=1e-6)


def test_command_line(spark, tmp_path):
    v = frame(spark)
    v.write.parquet(str(tmp_path / "v"))
    v.where("vec_id < 12").write.parquet(str(tmp_path / "q"))
    assert cli.main(["build", "--base", str(tmp_path / "v"), "--out-root", str(tmp_path / "i"), "--hnsw-m", "4", "--hnsw-efc", "20", "--nsg-r", "8", "--nsg-efc", "24", "--hcnng-ls", "40", "--hcnng-t", "3"]) == 0
    assert cli.main(["groundtruth", str(tmp_path / "v"), str(tmp_path / "q"), str(tmp_path / "gt.ivecs"), "3"]) == 0
    assert vecfiles.read(spark, str(tmp_path / "gt.ivecs"), "ivecs").count() == 12
    assert cli.main(["dataset", "--vectors", str(tmp_path / "v"), "--out", str(tmp_path / "d"), "--count", "3"]) == 0
    assert cli.main(["build", "--base", str(tmp_path / "none"), "--out-root", "x"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["build", "--nope"])
    assert e.value.code == 2


def test_logs_frontiers_and_interpolation(spark, tmp_path):
    rows = [(1, 10, 0.5, 100.0), (1, 10, 0.9, 50.0), (1, 10, 0.95, 60.0), (2, 10, 0.9, 80.0)]
    log = spark.createDataFrame(rows, "iter int, k int, recall double, qps double")
    front = evaluate.frontier(log.where("iter = 1")).orderBy("recall").collect()
    assert [r.recall for r in front] == [0.5, 0.95]
    at = {r.level: r.qps for r in evaluate.at_recalls(log.where("iter = 1").where("recall <> 0.9"), ["k"], (0.4, 0.5, 0.725, 0.95, 0.99)).collect()}
    assert at == pytest.approx({0.4: 0, 0.5: 100, 0.725: 80, 0.95: 60, 0.99: 0})
    evaluate.append_log(log, str(tmp_path / "log"))
    evaluate.append_log(log, str(tmp_path / "log"))
    (tmp_path / "log/odd.csv").write_text("iter,k,recall,qps\n3,x,y,z\n")
    assert evaluate.read_log(spark, str(tmp_path / "log"), "iter int, k int, recall double, qps double").count() == 8


def test_draws_and_intervals(spark):
    rows = spark.range(4000)
    for kind, p, mean in (("uniform", {"low": 2.0, "high": 4.0}, 3.0), ("normal", {"mean": 5.0, "std": 2.0}, 5.0), ("poisson", {"lam": 3.0}, 3.0)):
        x = [r[0] for r in rows.select(textsets.drawn(rows["id"], 3, kind, **p)).collect()]
        assert abs(np.mean(x) - mean) < 0.15
    i = textsets.intervals(rows, rows["id"], "normal", mean=0.0, std=1.0)
    assert i.where("lo > hi").count() == 0
    assert textsets.intervals(rows, rows["id"], points=True, low=0.0, high=1.0).where("lo <> hi").count() == 0
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 4.0, 4.5)], "id long, lo double, hi double")
    points = spark.createDataFrame([(7, 4.2), (8, 9.9), (9, 11.0)], "p_id long, at double")
    assert sorted(map(tuple, textsets.stabbed(spans, points, 3.0).collect())) == [(1, 7), (1, 8), (2, 7)]


def test_column_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1, 2, 3], [2, 3, 4, 5])], "x array<double>, a array<int>, b array<int>")
    r = df.select(metrics.jaccard(F.col("a"), F.col("b")), metrics.nested(F.col("x"), 2), metrics.flattened(metrics.nested(F.col("x"), 2)), metrics.jaccard(F.col("a"), F.array().cast("array<int>"))).first()
    assert r[0] == pytest.approx(0.6) and r[1] == [[1.0, 2.0], [3.0, 4.0]] and r[2] == [1.0, 2.0, 3.0, 4.0] and r[3] == 1.0
    levels = [r[0] for r in spark.range(3000).select(metrics.random_level(F.col("id"), 8)).collect()]
    assert min(levels) == 0 and 0.08 < np.mean([x > 0 for x in levels]) < 0.18
    with pytest.raises(ValueError, match="metric"):
        metrics.metric("nope")


def test_factors_and_weights(spark):
    counts = spark.createDataFrame([(u, i, float(1 + (u * i) % 3)) for u in range(12) for i in range(10) if (u + i) % 3], "id long, term long, tf double")
    w = textsets.bm25(counts)
    assert w.count() == counts.count()
    users, items = textsets.implicit_factors(w.selectExpr("cast(id as int) user", "cast(term as int) item", "cast(weight + 10 as float) weight"), rank=3, rounds=2)
    assert users.count() == 12 and items.count() == 10


def test_stabs_are_counted_without_pairs(spark):
    rng = np.random.default_rng(3)
    ends = np.sort(rng.integers(0, 40, size=(60, 2)) / 2, axis=1)
    spans = spark.createDataFrame([(i % 50, *map(float, e)) for i, e in enumerate(ends)] + [(77, None, 3.0), (78, 90.0, 95.0)], "id long, lo double, hi double")
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.integers(-5, 25, size=400) / 2)] + [(500, None), (501, float("nan"))], "p_id long, at double")
    got = textsets.stab_counts(spans, points)
    want = textsets.stabbed(spans.where("lo is not null"), points.where("not isnan(at)"), 3.0).groupBy("id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "p_id" not in plan and plan.count("Join") == 1  # with the sums of ranges alone

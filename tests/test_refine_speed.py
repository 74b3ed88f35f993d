"""Refinement loops: what makes them fast must not change what they find."""

import numpy as np
import pytest

from hopweave.operators import build, knn, refine, search


def graph(family="nsg", n=300, dim=8, seed=3, whole=True):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    x[1::7] = x[0]  # equal vectors, equal distances
    made = build.FAMILIES[family](np.arange(n) * 3, x, **({"m": 6, "efc": 24} if family == "hnsw" else {"r": 8, "lc": 24} if family == "nsg" else {"s": 4, "trees": 4, "leaf": 40}))
    g, level = made if isinstance(made, tuple) else (made, np.zeros(n, int))
    g.tops = level
    return g


@pytest.mark.parametrize("family", ["nsg", "hnsw", "hcnng"])
@pytest.mark.parametrize("ef", [1, 7, 60, 400])
def test_measured_searches_are_the_same(monkeypatch, family, ef):
    g = graph(family)
    off = frozenset((int(v), int(w)) for v in range(0, 300, 11) for w in g.lists[0][v][:1])

    def all_(whole):
        monkeypatch.setattr(search, "WHOLE", whole)
        out = []
        for i in range(0, 300, 13):
            events = []
            out += [search.search(g, g.x[i] + 0.01, 3 * i, 10, ef, lambda *e: events.append(e), disabled=d) for d in (frozenset(), off)] + [events]
        return out

    assert all_(0) == all_(1000)


def test_small_pools_are_pruned_alike(monkeypatch):
    g = graph()
    pools = [list(range(i, i + 33)) for i in range(0, 260, 9)]
    for alpha in (1.0, 1.2):
        small = [build.robust(g, i, p, alpha, 8) for i, p in enumerate(pools)]
        monkeypatch.setattr(build, "SMALL_POOL", 0)
        assert small == [build.robust(g, i, p, alpha, 8) for i, p in enumerate(pools)]
        monkeypatch.undo()


def test_tuning_takes_one_job_for_several_efs(spark, monkeypatch):
    g = graph()
    v = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(g.ids, g.x, strict=True)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 15 = 0")
    truth = knn.exact(v, q, 10).localCheckpoint()
    efs = [10, 20, 40, 80]
    one = [refine.recall_at(g, q, truth, 10, ef) for ef in efs]
    assert np.array(list(refine.recalls_at(g, q, truth, 10, efs))) == pytest.approx(np.array(one))
    jobs, before = [], search._over
    monkeypatch.setattr(search, "_over", lambda *a, **k: jobs.append(1) or before(*a, **k))
    for target in (0.0, 0.9, 2.0):
        slow = next((ef for ef in range(10, 101, 30) if refine.recall_at(g, q, truth, 10, ef)[0] >= target), None)
        if slow not in (None, 10):
            slow = next((ef for ef in range(slow - 20, slow, 10) if refine.recall_at(g, q, truth, 10, ef)[0] >= target), slow)
        jobs.clear()
        assert refine.tuned_ef(g, q, truth, 10, target, 10, 30, 10, 100) == (slow or 100)
        assert len(jobs) <= 2


@pytest.mark.parametrize("most", [1 << 20, 50])
@pytest.mark.parametrize("family", ["nsg", "hnsw"])
def test_counts_of_edges_are_those_of_traces(spark, monkeypatch, family, most):
    monkeypatch.setattr(search, "COUNTED", most)
    g = graph(family)
    v = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(g.ids, g.x, strict=True)], "vec_id long, embedding array<double>")
    for scope in (None, 1):
        rows = [sorted(map(tuple, df.select("level", "src", "dst", "adopted", "discarded").collect())) for df in (search.edge_counts(g, v, 20, scope), search.edge_statistics(search.traces(g, v, 20), scope))]
        assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("family", ["nsg", "hnsw", "hcnng"])
def test_searches_that_end_early_or_go_on_answer_alike(monkeypatch, family, equal):
    g = graph(family)
    if not equal:
        g.x = np.random.default_rng(9).standard_normal(g.x.shape)
    g.lists[0] = [np.zeros(0, np.int64) if i % 17 == 3 else around for i, around in enumerate(g.lists[0])]
    efs = [1, 5, 20, 21, 60, 299, 400]
    for i in range(0, 300, 13):
        q = g.x[i] + (i % 2) * 0.01
        slow = [search.search(g, q, 3 * i, 10, ef)[:2] for ef in efs]
        assert list(search.searches(g, q, 3 * i, 10, efs)) == slow
        assert [search.nearest_held(g, q, 3 * i, 10, ef) for ef in efs] == [found for found, _ in slow]
    asked = []
    monkeypatch.setattr(search, "search", lambda *a, **k: asked.append(1))
    if not equal:
        list(search.searches(g, g.x[5], 15, 10, efs))
    search.nearest_held(g, g.x[5], 15, 10, 60)
    assert not asked


def test_a_round_counts_edges_once_and_measures_as_before(spark, monkeypatch):
    g = graph()
    v = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(g.ids, g.x, strict=True)], "vec_id long, embedding array<double>")
    edges, nodes = build.build(v, "nsg", r=8, lc=24)
    asked = v.where("vec_id % 45 = 0")
    truth = knn.exact(v, asked, 10).localCheckpoint()
    plans, before = [], refine.prune_selected
    monkeypatch.setattr(refine, "prune_selected", lambda stats, share: plans.append(stats._jdf.queryExecution().optimizedPlan().toString()) or before(stats, share))
    made, log = refine.refine(edges, nodes, v, asked, truth, refine.settings_for("nsg", rounds=1, coarse_step=30, ef_cap=60), k=10)
    assert len(plans) == 1 and "MapInArrow" not in plans[0]  # a plan with the searches would run them for each of its uses
    for r, e in zip(log.orderBy("round").collect(), (edges, made), strict=True):
        own = search.load(e, nodes, v)
        recall, evaluations = refine.recall_at(own, asked, truth, 10, r.ef)
        acer = search.cost(search.traces(own, asked, r.ef).where("level = 0")).first().acer
        assert (r.edges, r.recall, r.evaluations, r.acer) == (e.count(), recall, pytest.approx(evaluations), pytest.approx(acer))


def test_impact_searches_are_dealt_to_all_cores(spark):
    g = graph()
    v = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(g.ids, g.x, strict=True)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 15 = 0")
    seeds = search.edge_seeds(search.traces(g, q, 8)).select("src", "dst", "seed")
    plan = refine.edge_impact(g, seeds, v, knn.exact(v, q, 11), 10, 8)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan  # which would put small tables into one task
    assert f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan

"""Searches, traces and refinement over several shards see all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.operators import build, knn, refine, search, traces, walk

X = np.random.default_rng(2).normal(size=(300, 8))


@pytest.fixture
def v(spark, monkeypatch):
    monkeypatch.setattr(build, "SHARD_ROWS", 110)
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(X)], "vec_id long, embedding array<double>").cache()


FAMILIES = {"nsg": {"r": 12, "lc": 40}, "hnsw": {"m": 6, "efc": 40}, "hcnng": {"s": 4, "trees": 6, "leaf": 60}}


@pytest.mark.parametrize("family", FAMILIES)
def test_search_covers_all_shards(v, family):
    edges, nodes = build.build(v, family, **FAMILIES[family])
    assert nodes.select("shard").distinct().count() == 3
    with pytest.raises(ValueError):
        search.load(edges, nodes, v)
    g = search.opened(edges, nodes, v, family == "hcnng")
    q = v.where("vec_id < 20")
    found = search.knn_search(g, q, 5, 60)
    assert knn.recall(found, knn.exact(v, q, 5), 5).first()[0] > 0.95
    assert search.knn_search(g, q, 5, 60, exclude_self=True).where("q_id = b_id").count() == 0
    lone = search.knn_search(g, q, 1, 1, exclude_self=True).toPandas()
    assert (lone["q_id"] != lone["b_id"]).all()
    assert knn.recall(build.sharded_search(edges, nodes, v, q, 5, 60, family == "hcnng"), found, 5).first()[0] == 1


def test_traces_have_a_tree_in_each_shard(v):
    edges, nodes = build.build(v, "nsg", **FAMILIES["nsg"])
    g, q = search.opened(edges, nodes, v), v.where("vec_id % 30 = 0")
    t = search.traces(g, q, 12).cache()
    shard = {r.id: r.shard for r in nodes.collect()}
    assert all(shard[r.src] == shard[r.dst] == r.shard for r in t.collect())
    found = search.knn_search(g, q, 12, 12)
    evals = {r.q_id: r.evaluations for r in found.collect()}
    tree = search.trees(g, q, 12).cache()
    assert tree.where("parent is null").groupBy("q_id").count().where("count <> 3").count() == 0
    assert {r.q_id: r.nodes for r in traces.sizes(tree).collect()} == {r.q_id: r.n + 3 for r in t.where("adopted = 1").groupBy("q_id").agg(F.count("*").alias("n")).collect()}
    assert {r.q_id: r["count"] for r in t.groupBy("q_id").count().collect()} == {k: e - 3 for k, e in evals.items()}
    entries = {r.id for r in nodes.where("is_entry").collect()}
    best = found.where("rank = 1").selectExpr("q_id", "b_id as target")
    for _, p in traces.main_paths(traces.marked(tree, 1, best)).toPandas().groupby("q_id"):
        assert p.sort_values("up")["node"].iloc[-1] in entries
    assert all(shard[r.src] == shard[r.dst] for r in traces.local_links(tree, edges, jumps=2).collect())
    for r in walk.beam_rounds(edges, v, q, nodes.where("is_entry").selectExpr("id as vec_id"), 12).collect():
        assert [f.node for f in r.found] == [b.b_id for b in found.where(f"q_id = {r.q_id}").orderBy("rank").collect()] and r.evaluations == evals[r.q_id]


def test_refinement_stays_in_shards_and_keeps_recall(spark, v):
    q = v.where("vec_id % 15 = 0")
    truth = knn.exact(v, q, 10)
    edges, nodes = build.build(v, "hnsw", **FAMILIES["hnsw"])
    own = refine.settings_for("hnsw", rounds=2, train_ef=80, ef_max=60, ef_cap=120, target_recall=0.9, coarse_step=30, fine_step=15, repair_degree=10)
    refined, log = refine.refine(edges, nodes, v, q, truth, own, k=10)
    shard = {r.id: r.shard for r in nodes.collect()}
    assert all(shard[r.src] == shard[r.dst] for r in refined.collect())
    rows = log.orderBy("round").collect()
    assert rows[1].edges < rows[0].edges and rows[2].recall > 0.9


def test_edge_impact_counts_the_whole_search(v):
    edges, nodes = build.build(v, "nsg", **FAMILIES["nsg"])
    g, q = search.opened(edges, nodes, v), v.where("vec_id = 30")
    seeds = search.edge_seeds(search.traces(g, q, 12)).orderBy("src", "dst").limit(6).cache()
    got = refine.edge_impact(g, seeds, v, knn.exact(v, q, 11), 10, 12).collect()
    truth = {r.b_id for r in knn.exact(v, q, 10, exclude_self=True).collect()}

    def one(off=frozenset()):
        rows = search.knn_search(g, q, 10, 12, exclude_self=True, disabled=off).collect()
        return rows[0].evaluations, len(truth & {r.b_id for r in rows}) / 10

    base = one()
    assert len(got) == 6
    for r in got:
        now = one(frozenset([(r.src, r.dst)]))
        assert r.comparison_diff == base[0] - now[0] and abs(r.recall_diff - (base[1] - now[1])) < 1e-12


def test_traces_of_many_queries_go_in_small_chunks(v, monkeypatch):
    edges, nodes = build.build(v, "nsg", **FAMILIES["nsg"])
    g = search.opened(edges, nodes, v)
    rows = lambda df: sorted(map(str, df.collect()))
    whole, tree = rows(search.traces(g, v, 12)), rows(search.trees(g, v, 12))
    monkeypatch.setattr(search, "TRACED_ROWS", 20)
    most, dealt = [], search._dealt
    monkeypatch.setattr(search, "_dealt", lambda *a, **more: most.append(more["most"]) or dealt(*a, **more))
    assert rows(search.traces(g, v, 12)) == whole and rows(search.trees(g, v, 12)) == tree
    assert most == [20, 20]

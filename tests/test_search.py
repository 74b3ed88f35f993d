import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.operators import build, knn, refine, search, traces
from hopweave.sources import results


def graph(n=60, dim=6, k=5, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    both = [sorted({*near[i].tolist(), *(j for j in range(n) if i in near[j])}) for i in range(n)]
    return search.Graph(np.arange(n), x, [[np.array(b) for b in both]], 0)


def plain_beam(g, q, start, ef):
    """The search as its rules read, with lists instead of heaps."""
    d = lambda v: float(((g.x[v] - q) ** 2).sum())
    top, cand, seen, events = [(d(start), start)], [(d(start), start)], {start}, []
    while cand:
        c = min(cand, key=lambda t: (t[0], -t[1]))
        if c[0] > max(top)[0] and len(top) == ef:
            break
        cand.remove(c)
        for v in g.lists[0][c[1]].tolist():
            if v in seen:
                continue
            seen.add(v)
            take = len(top) < ef or d(v) < max(top)[0]
            if take:
                cand.append((d(v), v)), top.append((d(v), v))
                if len(top) > ef:
                    top.remove(max(top))
            events.append((c[1], v, int(take)))
    return sorted(top), events


@given(st.integers(0, 50), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_beam_follows_its_rules(seed, ef):
    g = graph(seed=seed)
    q = np.random.default_rng(seed + 1000).normal(size=6)
    events = []
    found, count, expanded = search.beam(g, q, seed % 60, ef, event=lambda lv, s, v, d, a: events.append((s, v, a)))
    want, plain = plain_beam(g, q, seed % 60, ef)
    assert [v for _, v in found] == [v for _, v in want] and events == plain
    assert count == len(events) + 1 and len(set(expanded)) == len(expanded)


def test_ties_expand_the_larger_node_first():
    x = np.array([[0.0], [1.0], [-1.0], [2.0]])
    g = search.Graph(np.arange(4), x, [[np.array([1, 2]), np.array([3]), np.array([3]), np.array([0])]], 0)
    _, _, expanded = search.beam(g, np.array([0.0]), 0, 10)
    assert expanded[:3] == [0, 2, 1]


def test_full_beam_is_exact():
    g = graph()
    q = np.random.default_rng(5).normal(size=6)
    reach = {0}
    while True:
        more = reach | {v for u in reach for v in g.lists[0][u].tolist()}
        if more == reach:
            break
        reach = more
    found, _, _ = search.beam(g, q, 0, 60)
    d = ((g.x - q) ** 2).sum(1)
    assert [v for _, v in found] == sorted(reach, key=lambda v: (d[v], v))


def test_disabled_edges_are_not_followed():
    x = np.arange(4.0)[:, None]
    line = search.Graph(np.arange(4), x, [[np.array([1]), np.array([0, 2]), np.array([1, 3]), np.array([2])]], 0)
    found, _, _ = search.beam(line, np.array([3.0]), 0, 4, disabled=frozenset([(1, 2)]))
    assert [v for _, v in found] == [1, 0]


X = np.random.default_rng(2).normal(size=(300, 8))


@pytest.mark.parametrize("family", ["hnsw", "nsg", "vamana", "hcnng"])
def test_builders_keep_their_caps_and_find_neighbours(family):
    params = {"hnsw": {"m": 6, "efc": 40}, "nsg": {"r": 12, "lc": 40}, "vamana": {"r": 12, "lc": 40}, "hcnng": {"s": 4, "trees": 6, "leaf": 60}}[family]
    made = build.FAMILIES[family](np.arange(300), X, **params)
    g = made[0] if isinstance(made, tuple) else made
    cap = {"hnsw": 12, "nsg": 12, "vamana": 12, "hcnng": 24}[family]
    for level, lists in enumerate(g.lists):
        for node, around in enumerate(lists):
            a = around.tolist()
            assert node not in a and len(set(a)) == len(a)
            assert len(a) <= (6 if family == "hnsw" and level else cap)
    hit = 0
    for q in range(0, 300, 10):
        found, _, _ = search.search(g, X[q], q, 10, 80)
        d = ((X - X[q]) ** 2).sum(1)
        hit += len({v for _, v in found} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit / 300 > 0.9
    again = build.FAMILIES[family](np.arange(300), X, **params)
    again = again[0] if isinstance(again, tuple) else again
    assert all(np.array_equal(a, b) for la, lb in zip(g.lists, again.lists) for a, b in zip(la, lb))


def test_identical_points_end():
    g = build.hcnng(np.arange(50), np.zeros((50, 3)), s=3, trees=2, leaf=8)
    assert sum(map(len, g.lists[0])) > 0


def test_capped_tree_is_a_capped_forest():
    edges = build.capped_tree(X[:80], 3)
    degree = np.zeros(80, int)
    for a, b in edges:
        degree[[a, b]] += 1
    assert degree.max() <= 3 and len(edges) <= 79
    full = build.capped_tree(X[:30], 99)
    assert len(full) == 29


@pytest.mark.parametrize("jumps", [1, 2, 4])
def test_reach_counts_steps(jumps):
    a = np.random.default_rng(jumps).random((12, 12)) < 0.12
    want, step = a.copy(), a.astype(int)
    for _ in range(jumps - 1):
        step = (step @ a.astype(int) > 0).astype(int)
        want |= step > 0
    assert np.array_equal(refine.reach(a, jumps), want)


def test_two_triangles_get_a_link():
    a = np.zeros((6, 6), bool)
    for t in ((0, 1, 2), (3, 4, 5)):
        for u in t:
            for v in t:
                a[u, v] = u != v
    added = refine.deficit_edges(a, 4)
    assert len(added) == 2 and {added[0][0] // 3, added[0][1] // 3} == {0, 1}


def test_pruning_limits(spark):
    rng = np.random.default_rng(0)
    rows = [(lv, s, p, 100 + p, int(rng.integers(0, 4)), int(rng.integers(0, 6))) for lv in (0, 1) for s in range(20) for p in range(6)]
    stats = spark.createDataFrame(rows, "level int, src long, pos int, dst long, adopted long, discarded long")
    cut = refine.prune_selected(stats, 0.1).toPandas()
    assert cut.groupby(["level", "src"]).size().max() <= 2
    met = {(r[0], r[1], r[3]): r[4:] for r in rows}
    assert all(sum(met[k]) > 0 for k in zip(cut["level"], cut["src"], cut["dst"]))
    left = refine.without(stats, refine.prune_selected(stats, 0.1)).toPandas()
    assert len(left) == len(rows) - len(cut)
    assert all(sorted(g["pos"]) == list(range(len(g))) for _, g in left.groupby(["level", "src"]))
    new = spark.createDataFrame([(0, 1, 100), (0, 1, 999), (0, 1, 999), (0, 5, 5)], "level int, src long, dst long")
    more = refine.extended(stats, new).toPandas()
    assert len(more) == len(rows) + 1 and more[more["dst"] == 999]["pos"].tolist() == [6]


def vectors(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def test_shards_answer_like_one(spark, monkeypatch):
    v = vectors(spark, X)
    truth = knn.exact(v, v.where("vec_id < 20"), 5)
    monkeypatch.setattr(build, "SHARD_ROWS", 80)
    edges, nodes = build.build(v, "nsg", r=12, lc=40)
    assert nodes.select("shard").distinct().count() == 4
    found = build.sharded_search(edges, nodes, v, v.where("vec_id < 20"), 5, 60)
    assert knn.recall(found, truth, 5).first()[0] > 0.95


def test_traces_and_trees(spark):
    v = vectors(spark, X[:120])
    edges, nodes = build.build(v, "nsg", r=8, lc=24)
    g = search.load(edges, nodes, v)
    q = v.where("vec_id % 12 = 0")
    t = search.traces(g, q, 12).cache()
    found = search.knn_search(g, q, 12, 12)
    evals = {r.q_id: r.evaluations for r in found.collect()}
    assert {r.q_id: r["count"] for r in t.groupBy("q_id").count().collect()} == {k: e - 1 for k, e in evals.items()}
    tree = search.trees(g, q, 12).cache()
    rows = tree.toPandas()
    want = [(r.q_id, r.dst, r.src, r.dist) for r in t.where("adopted = 1").collect()]
    assert sorted((r.q_id, r.node, int(r.parent), r.dist) for r in rows.itertuples() if r.parent == r.parent) == sorted(want)
    roots = rows[rows["parent"].isna()]
    near = {r.q_id: r.dist for r in roots.itertuples()}
    assert len(near) == q.count() and all(abs(d - ((X[i] - g.x[g.entry]) ** 2).sum()) < 1e-9 for i, d in near.items())
    assert {r.q_id: r.nodes for r in traces.sizes(tree).collect()} == rows.groupby("q_id").size().to_dict()
    found = {(r.q_id, r.b_id): r.rank for r in found.collect()}
    assert {(r.q_id, r.node): r.place for r in rows.itertuples() if r.place == r.place} == found
    assert all(r.held == 12 and r.evaluations == evals[r.q_id] and r.ecr == 12 / evals[r.q_id] for r in traces.ratios(tree).collect())
    top = traces.marked(tree, 5).toPandas()
    assert {(r.q_id, r.node) for r in top.itertuples() if r.chosen} == {k for k, rank in found.items() if rank <= 5} and set(top["chosen"]) == {0, 1}
    targets = spark.createDataFrame([(r, r if r else 999) for r in near], "q_id long, target long")  # a query's own vector; the first has none
    hit = traces.marked(tree, 5, targets).cache()
    assert {(r.q_id, r.node) for r in hit.where("chosen = 2").collect()} == {(i, i) for i in near if i} and hit.where("chosen = 1").count() == 0
    parent = {(r.q_id, r.node): r.parent for r in rows.itertuples()}
    paths = traces.main_paths(hit).toPandas()
    assert set(paths["q_id"]) == set(near) - {0}
    for q_id, p in paths.groupby("q_id"):
        p = p.sort_values("up")["node"].tolist()
        assert all(parent[q_id, a] == b for a, b in zip(p, p[1:])) and np.isnan(parent[q_id, p[-1]])
    inner, links = traces.inner_visits(tree)
    want = pd.Series([p for (q_id, p) in {(r.q_id, int(r.parent)) for r in rows.itertuples() if r.parent == r.parent}]).value_counts().to_dict()
    assert {r.node: r.visits for r in inner.collect()} == want
    assert links.count() <= len(rows)
    assert set(traces.shortcuts(traces.main_paths(hit), longest=2).columns) == {"src", "dst"}


def test_trees_in_depth_first_order(spark, tmp_path):
    rows = [(7, 0, 0, 5, None, 4.0, 0), (7, 0, 1, 3, 5, 2.0, 1), (7, 0, 2, 9, 5, 1.5, 1), (7, 0, 3, 4, 3, 2.5, 0), (7, 0, 4, 3, 9, 2.0, 1), (2, 0, 0, 1, None, 0.75, 1), (2, 0, 1, 0, 1, 0.5, 1)]
    t = spark.createDataFrame(rows, "q_id long, shard int, seq int, node long, parent long, dist double, chosen int")
    want = [(2, 0, 1, None, 0, 0.75, 1), (2, 1, 0, 1, 1, 0.5, 1), (7, 0, 5, None, 0, 4.0, 0), (7, 1, 3, 5, 1, 2.0, 1), (7, 2, 4, 3, 2, 2.5, 0), (7, 3, 9, 5, 1, 1.5, 1)]
    got = traces.preorder(t)
    assert [(r.q_id, r.at, r.node, r.parent, r.depth, r.dist, r.chosen) for r in got.orderBy("q_id", "at").collect()] == want
    results.write_trees(got, str(tmp_path / "t"))
    back = results.read_trees(spark, str(tmp_path / "t"), step=1).orderBy("tree", "at").collect()
    assert [((2, 7)[r.tree], r.at, r.node, r.parent, r.depth, r.dist, r.chosen) for r in back] == want
    lines = [r.line for r in traces.printed(t, 1).where("q_id = 7").orderBy("at").collect()]
    assert lines == ["Node ID: 5 (Depth: 0, Distance: 4,chosen0,count0)", "  Node ID: 3 (Depth: 1, Distance: 2,chosen1,count1)", "  Node ID: 9 (Depth: 1, Distance: 1.5,chosen1,count2)"]
    none = traces.preorder(t.where("q_id < 0"))
    results.write_trees(none, str(tmp_path / "e"))
    assert none.count() == 0 == results.read_trees(spark, str(tmp_path / "e")).count()


def test_refinement_keeps_recall(spark):
    v = vectors(spark, X)
    q = v.where("vec_id % 15 = 0")
    truth = knn.exact(v, q, 10)
    edges, nodes = build.build(v, "hnsw", m=6, efc=40)
    own = refine.settings_for("hnsw", rounds=2, train_ef=80, ef_max=60, ef_cap=120, target_recall=0.9, coarse_step=30, fine_step=15, repair_degree=10)
    refined, log = refine.refine(edges, nodes, v, q, truth, own, k=10)
    rows = log.orderBy("round").collect()
    assert [r.operation for r in rows] == ["start", "prune", "add"]
    assert rows[1].edges < rows[0].edges and rows[2].edges >= rows[1].edges
    assert rows[2].recall > 0.85 and all(0 <= r.acer <= 1 for r in rows)
    assert refined.where("src = dst").count() == 0


def test_rounds_of_joins_search_alike(spark):
    from hopweave.operators import walk

    v = vectors(spark, X[:50])
    edges, nodes = build.build(v, "nsg", r=5, lc=16)
    g = search.load(edges, nodes, v)
    q = v.where("vec_id % 9 = 4")
    entry = nodes.where("is_entry").selectExpr("id as vec_id")
    for r in walk.beam_rounds(edges, v, q, entry, 4).collect():
        found, count, _ = search.beam(g, g.x[r.q_id], g.entry, 4)
        assert [f.node for f in r.found] == [n for _, n in found] and r.evaluations == count

import numpy as np
import pytest

from hopweave.operators import clusters, network, vectors, walk


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ids(spark, n):
    return spark.range(n).toDF("id")


def test_star_and_line(spark):
    star = frame(spark, [(0, i) for i in range(1, 5)] + [(i, 0) for i in range(1, 5)])
    b = {r.id: r.betweenness for r in network.betweenness(star, ids(spark, 5)).collect()}
    assert b[0] == pytest.approx(1.0) and b[1] == 0
    assert network.clustering(star, ids(spark, 5), 1.0).first()[0] == 0
    line = frame(spark, [(0, 1), (1, 2), (2, 3)])
    hop = {(r.source, r.id): r.hop for r in network.hops(line, ids(spark, 4)).collect()}
    assert hop == {(a, b): b - a for a in range(4) for b in range(a, 4)}
    s = network.path_summary(line, ids(spark, 4), 4).first()
    assert s.diameter == 3 and s.average_path == pytest.approx(10 / 6)


def test_betweenness_by_all_paths(spark, monkeypatch):
    rng = np.random.default_rng(0)
    n = 12
    a = rng.random((n, n)) < 0.2
    np.fill_diagonal(a, False)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(a))]
    dist = np.full((n, n), 99)
    dist[a] = 1
    np.fill_diagonal(dist, 0)
    for k in range(n):
        dist = np.minimum(dist, dist[:, k : k + 1] + dist[k : k + 1])
    count = np.zeros((n, n))
    for s in range(n):
        count[s, s] = 1
        for t in sorted(range(n), key=lambda t: dist[s, t]):
            if t != s and dist[s, t] < 99:
                count[s, t] = sum(count[s, u] for u in range(n) if a[u, t] and dist[s, u] + 1 == dist[s, t])
    want = [sum(count[s, v] * count[v, t] / count[s, t] for s in range(n) for t in range(n) if len({s, t, v}) == 3 and count[s, t] and dist[s, v] + dist[v, t] == dist[s, t] < 99) / ((n - 1) * (n - 2)) for v in range(n)]
    got = {r.id: r.betweenness for r in network.betweenness(frame(spark, pairs), ids(spark, n)).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(want)
    monkeypatch.setattr(network, "STATES", 40)  # sources in several batches
    again = {r.id: r.betweenness for r in network.betweenness(frame(spark, pairs), ids(spark, n)).collect()}
    assert [again[i] for i in range(n)] == pytest.approx(want)
    part = network.betweenness(frame(spark, pairs), ids(spark, n), share=0.5).collect()
    assert len(part) == n and all(r.betweenness >= 0 for r in part)
    assert [r.betweenness for r in network.betweenness(frame(spark, pairs).limit(0), ids(spark, 3)).collect()] == [0, 0, 0]


def test_betweenness_of_broadcast_links_is_that_of_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    e = frame(spark, sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, size=(130, 2)) * 3}) + [(3, 6), (3, 6), (200, 201)])
    n = spark.range(0, 210).select("id")
    run = lambda **more: {r.id: r.betweenness for r in network.betweenness(e, n, **more).collect()}
    with monkeypatch.context() as m:
        m.setattr(network, "path_counts", None)  # no join a level where the links are few
        near, half = run(), run(share=0.5)
        m.setattr(network, "WALKED", 300)
        assert run() == pytest.approx(near)
    monkeypatch.setattr(network, "LINK_BYTES", 0)
    assert run() == pytest.approx(near) and run(share=0.5) == pytest.approx(half) and max(near.values()) > 0


def test_components_of_a_long_chain(spark):
    e = frame(spark, [(i, i + 1) for i in range(40)] + [(50, 51)])
    got = {r.id: r.component for r in network.components(e, ids(spark, 53)).collect()}
    assert got == {i: 0 if i <= 40 else i if i != 51 else 50 for i in range(53)}


def test_pagerank_converges_and_is_flat_on_regular_graphs(spark):
    ring = frame(spark, [(i, (i + 1) % 6) for i in range(6)])
    got = [r["rank"] for r in network.pagerank(ring, ids(spark, 6)).collect()]
    assert got == pytest.approx([1 / 6] * 6)


def test_density_clusters(spark):
    x = [[0.0], [0.1], [0.2], [5.0], [5.1], [5.2], [5.35], [20.0]]
    v = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = [r.cluster for r in clusters.dbscan(v, 0.16, 3).orderBy("vec_id").collect()]
    assert got == [1, 1, 1, 4, 4, 4, 4, -1]


def test_duplicates_tie_by_id(spark):
    from hopweave.operators import knn

    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 1.0]), (5, None)], "vec_id long, embedding array<double>")
    got = knn.exact(v, v.where("vec_id = 3"), 3).orderBy("rank").collect()
    assert [r.b_id for r in got] == [1, 2, 3]
    assert knn.exact(v.limit(0), v, 3).count() == 0 and knn.exact(v, v.limit(0), 3).count() == 0
    assert [r.b_id for r in knn.exact(v, v.where("vec_id = 3"), 9, exclude_self=True).orderBy("rank").collect()] == [1, 2, 9]


def test_scaling_and_pruned_lists(spark):
    v = spark.createDataFrame([(0, [0.0, 5.0]), (1, [2.0, 5.0]), (2, [4.0, 5.0])], "vec_id long, embedding array<double>")
    assert [r.embedding for r in vectors.minmax_scaled(v).orderBy("vec_id").collect()] == [[0.0, 0.0], [0.5, 0.0], [1.0, 0.0]]
    c = spark.createDataFrame([(0, 1, 4.0), (0, 2, 16.0)], "src long, dst long, dist double")
    assert [(r.pos, r.dst) for r in walk.pruned_lists(c, v, 5, 1.0).collect()] == [(0, 1)]


def test_links_are_broadcast_by_the_bytes_they_take(spark, monkeypatch):
    x = np.random.default_rng(2)
    rows = {(int(a), int(b)) for a, b in x.integers(0, 40, (400, 2)) if a != b}
    e, n = spark.createDataFrame(sorted(rows), "src long, dst long"), spark.range(40)
    joins, before = [], network.path_counts
    monkeypatch.setattr(network, "path_counts", lambda *a: joins.append(1) or before(*a))
    monkeypatch.setattr(network, "LINK_BYTES", 8 * len(rows))
    walked = {r.id: r.betweenness for r in network.betweenness(e, n).collect()}
    assert not joins
    monkeypatch.setattr(network, "LINK_BYTES", 0)
    joined = {r.id: r.betweenness for r in network.betweenness(e, n).collect()}
    assert joins and walked == pytest.approx(joined)

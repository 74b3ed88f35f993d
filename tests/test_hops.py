"""bfs_hops, path_lengths and wf_closeness on a chain that is longer than any table's graph."""

from hopweave.plans import catalog


def test_hops_have_no_limit_and_start_at_the_least_ids(spark, monkeypatch):
    edges = spark.createDataFrame([(100 + i, 0, 101 + i, 1.0) for i in range(14)], "src long, pos int, dst long, dist double")
    nodes = spark.createDataFrame([(100 + i,) for i in range(15)], "id long")
    monkeypatch.setattr(catalog, "_graph", lambda spark, sf: (None, edges, nodes))
    want = {(100 + a, 100 + b): b - a for a in range(10) for b in range(a, 15)}
    assert {(r.source, r.id): r.hop for r in catalog.QUERIES["bfs_hops"](spark, "").collect()} == want
    hops = [h for h in want.values() if h]
    row = catalog.QUERIES["path_lengths"](spark, "").first()
    assert row.diameter == 14 and row.average_path == round(sum(hops) / len(hops), 6)
    close = {r.id: r.closeness for r in catalog.QUERIES["wf_closeness"](spark, "").collect()}
    for a in range(10):
        h = list(range(1, 10 - a))
        assert close[100 + a] == (round(len(h) / 9 * len(h) / sum(h), 6) if h else 0)

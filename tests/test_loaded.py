import pickle

import numpy as np
import pytest

from hopweave.operators import search

N, WIDE, LINKS = 3000, 32, 12


def tables(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(N, WIDE)).astype(np.float32)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    links = [(0, i, j, int(k)) for i in range(N) for j, k in enumerate(rng.choice(N, LINKS, replace=False)) if k != i]
    return v, spark.createDataFrame(links, "level int, src long, pos int, dst long"), v.selectExpr("vec_id as id", "0 as level", "vec_id = 7 as is_entry")


def test_a_loaded_graph_is_flat_arrays_and_keeps_floats(spark):
    v, edges, nodes = tables(spark, "float")
    g = search.load(edges, nodes, v)
    held = N * WIDE * 4 + edges.count() * 8
    assert search.loaded_bytes(edges, v) == held and len(pickle.dumps(g, 5)) < 1.1 * held
    wide, _, _ = tables(spark, "double")
    h = search.load(edges, nodes, wide)
    assert g.x.dtype == np.float32 and h.x.dtype == np.float64 and len(g.lists[0]) == len(list(g.lists[0])) == N
    assert all(np.array_equal(a, b) for a, b in zip(g.lists[0], h.lists[0], strict=True))
    for ef in (8, 200):  # lists walked, and all measured
        for q in (5, 900):
            assert search.search(g, g.x[q], q, 10, ef) == search.search(h, h.x[q], q, 10, ef)


def test_floats_that_fit_are_not_refused(spark, monkeypatch):
    v, edges, nodes = tables(spark, "float")
    monkeypatch.setattr(search, "SHARD_BYTES", N * WIDE * 6 + N * LINKS * 8)
    assert len(search.load(edges, nodes, v).ids) == N
    with pytest.raises(ValueError, match="more than one shard"):
        search.load(edges, nodes, tables(spark, "double")[0])

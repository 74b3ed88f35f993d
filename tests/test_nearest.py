"""The k nearest in tiles: products of floats only shortlist, whatever the vectors are."""

import numpy as np
import pyarrow as pa
import pytest

from hopweave.operators import knn
from hopweave.plans import catalog, graph_queries

N = 700


def batch(ids, x):
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.tolist())], ["vec_id", "embedding"])


def found(x, k, exclude_self):
    ids = np.arange(N) * 2
    cuts = [0, 3, 400, N]
    t = knn._nearest(k, exclude_self)(ids, x, (batch(ids[a:b], x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)))
    return sorted(zip(*(t.column(c).to_pylist() for c in ("q_id", "dist", "b_id")), strict=True))


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("kind", ["plain", "equal", "near", "tiny", "huge", "outlier", "far"])
def test_tiles_give_what_all_distances_give(monkeypatch, kind, exclude_self):
    monkeypatch.setattr(knn, "TILE", 64), monkeypatch.setattr(knn, "DEPTH", 150), monkeypatch.setattr(knn, "FIRST", 40)
    x = np.random.default_rng(4).normal(size=(N, 7))
    if kind == "equal":
        x[::3] = x[0]
    if kind == "near":
        x[::2] = x[0] + x[::2] * 1e-6
    if kind == "outlier":
        x[5] *= 1e8
    if kind == "far":
        x += 1e4
    x *= {"tiny": 1e-12, "huge": 1e20}.get(kind, 1)
    x[7, 2], x[8, 1] = np.nan, np.inf
    for k in (1, 9, 128):
        want = []
        for i in range(N):
            d = ((x[i] - x) ** 2).sum(1)
            own = sorted((d[j], j) for j in np.flatnonzero(np.isfinite(d)) if not exclude_self or j != i)[:k]
            want += [(2 * i, d, 2 * j) for d, j in own]
        assert found(x, k, exclude_self) == sorted(want)


def test_only_the_first_rows_are_selected_by_sorting(monkeypatch):
    monkeypatch.setattr(knn, "FIRST", 64)
    sizes, before = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *r, **k: sizes.append(a.shape[1]) or before(a, *r, **k))
    found(np.random.default_rng(4).normal(size=(N, 7)), 9, True)
    assert sizes and max(sizes) <= 400 and sum(sizes) < N * 3  # of three tiles, each at first only


def test_graphs_are_searched_without_walks(spark, monkeypatch):
    monkeypatch.setattr(catalog.walk, "steps", None), monkeypatch.setattr(catalog.network, "edge_lengths", None)
    base, edges, g = graph_queries._opened(spark, "/root/testdata/sf0.001")
    x = {r.vec_id: np.array(r.embedding, float) for r in base.collect()}
    rows = edges.orderBy("src", "pos").collect()
    for a, b in zip(rows, rows[1:]):
        if a.src == b.src:
            d, e = (((x[r.src] - x[r.dst]) ** 2).sum() for r in (a, b))
            assert b.pos == a.pos + 1 and d <= e + 1e-12
    assert {(r.src, r.dst) for r in rows} == {(r.dst, r.src) for r in rows}

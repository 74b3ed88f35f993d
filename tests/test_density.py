"""Density clustering without rows of pairs."""

import numpy as np
import pytest

from hopweave.operators import clusters, grid


def plain(x, eps, least):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = d < eps * eps * (1 + 1e-12)
    core = near.sum(axis=1) >= least
    name = np.where(core, np.arange(len(x)), len(x))
    for _ in x:
        name = np.where(core, np.where(near & core[None], name[None], len(x)).min(axis=1), name)
    out = np.where(near & core[None], name[None], len(x)).min(axis=1)
    return np.where(core, name, np.where(out < len(x), out, -1)).tolist()


@pytest.mark.parametrize("block", [1 << 24, 40 * 3 * 8])
@pytest.mark.parametrize("scale", [1.0, 1e4, 1e18])
def test_clusters_are_those_of_all_pairs_and_few_links_leave_a_task(spark, monkeypatch, block, scale):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.25, (45, 3)) for c in (0, 2, 5)] + [rng.uniform(-3, 8, (60, 3)), np.zeros((5, 3))]) * scale
    monkeypatch.setattr(grid, "BLOCK_BYTES", block)
    made, forest = [], clusters._forest
    monkeypatch.setattr(clusters, "_forest", lambda *a: made.append(forest(*a)) or made[-1])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    rows = dict(clusters.dbscan(v, 0.6 * scale, 5).collect())
    assert [rows[i] for i in range(len(x))] == plain(x, 0.6 * scale, 5) and rows[999] == -1
    cells = 8 if block == 1 << 24 else (-(-len(x) * 24 // block)) ** 2
    assert len(set(rows.values())) > 3 and made[0].count() <= cells * (len(x) if cells == 8 else 2 * 60)


def test_distances_at_the_bound_are_told_exactly():
    q = np.array([[0.0, 0.0], [1e3, 1e3]])
    x = np.array([[1.0, 0.0], [1.0 - 1e-9, 0.0], [1e3 + 1, 1e3], [1e3 + 1 - 1e-9, 1e3]])
    assert clusters.close(q, x, 1.0).tolist() == [[False, True, False, False], [False, False, False, True]]

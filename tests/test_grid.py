"""Tables that meet themselves in a grid of blocks give what one broadcast gives."""

import numpy as np
import pytest

from hopweave.operators import clusters, grid, knn

X = np.random.default_rng(8).normal(size=(150, 6)).round(2)
X[:40] = X[0]


@pytest.fixture
def v(spark):
    rows = [(i, x.tolist(), int(i % 4) - (i % 9 == 0)) for i, x in enumerate(X)] + [(500, None, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").cache()


def rows(df):
    return sorted(tuple(round(c, 6) if isinstance(c, float) else c for c in r) for r in df.collect())


@pytest.mark.parametrize("block", [600, 7000])
def test_grid_gives_the_same_rows(v, monkeypatch, block):
    def all_():
        yield rows(knn.graph(v, 5))
        yield rows(knn.exact(v, v.where("vec_id % 10 = 0"), 7, "cosine"))
        yield rows(knn.within(v, v, 1.5, exclude_self=True))
        yield rows(clusters.dbscan(v.where("vec_id < 500"), 1.2, 4))
        yield rows(clusters.silhouette(v.where("vec_id < 500")))

    whole = list(all_())
    monkeypatch.setattr(grid, "BLOCK_BYTES", block), monkeypatch.setattr(grid, "PAIRS", 64)
    assert list(all_()) == whole
    d = ((X[:, None] - X[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    brute = [(i, p, int(j)) for i in range(150) for p, j in enumerate(sorted(range(150), key=lambda j: (d[i, j], j))[:5])]
    assert [r[:3] for r in whole[0]] == sorted(brute)


def test_plan_does_not_grow_with_the_cells(v, monkeypatch):
    def nodes(block):
        monkeypatch.setattr(grid, "BLOCK_BYTES", block)
        return knn.graph(v, 3)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert nodes(500) == nodes(3000)


def test_empty(v):
    assert knn.graph(v.limit(0), 3).count() == 0


def test_hot_keys_make_grids_of_their_own(spark, v):
    from functools import partial

    rows = v.where("vec_id < 500").selectExpr("vec_id", "embedding", "if(vec_id < 120, 1, vec_id % 3 + 2) as key")
    asked = rows.where("vec_id % 3 = 0").union(rows.where("vec_id % 3 = 0").selectExpr("vec_id", "embedding", "7 as key"))
    whole = knn.exact_by_key(rows, asked, "key", 4)
    small = grid.met_by_key(rows, asked, "key", knn._pairs(knn.shortlist(4, "squared_l2")), knn.SCHEMA, partial(grid.nearest_of, k=4), side=10)
    key = {r.vec_id: r.key for r in rows.collect()}
    d = ((X[:, None] - X[None]) ** 2).sum(axis=2)
    brute = [(i, j, p) for i in range(0, 150, 3) for p, j in enumerate(sorted((j for j in range(150) if key[j] == key[i]), key=lambda j: (d[i, j], j))[:4], 1)]
    for got in (whole, knn.ranked(small, 4)):
        assert sorted((r.q_id, r.b_id, r["rank"]) for r in got.collect()) == sorted(brute)


def test_distance_sums_of_equal_and_far_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[50:90], x[100:140] = x[0], x[1] + rng.normal(size=(40, 8)) * 1e-7
    x += 1e3  # far from the origin, where a product loses what is small
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).sum(axis=1)
    assert np.allclose(clusters.distance_sums(x, x), want, rtol=1e-9)
    assert clusters.distance_sums(x[:0], x).shape == (0,) and not clusters.distance_sums(x, x[:0]).any()


def test_few_files_are_dealt_to_all_cores(spark, v):
    one = v.coalesce(1)
    assert knn.within(one, v, 1.5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism

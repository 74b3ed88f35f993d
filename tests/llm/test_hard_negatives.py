import math

import duckdb
import numpy as np
import pytest

from hopweave.llm import hard_negatives as H

F = H.F
SCHEMA = "vec_id long, embedding array<float>, label int, rank int, positives string"


def brute(rows):
    """Every pair, in whole numbers; an id that repeats is one anchor and counts by its best score."""
    good = [(v, [math.floor(256 * float(c)) for c in x], y) for v, x, y, *_ in rows if v is not None and y is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    good = [(v, x, (y + 1) % 10 if v % 7 == 0 else y) for v, x, y in good]
    anchors = {}
    for v, x, y in good:
        if v % 100 == 0:
            anchors[v] = min(anchors.get(v, (y, x)), (y, x))
    out = []
    for a, (label, x) in anchors.items():
        same, other = {}, {}
        for v, z, y in good:
            if v != a:
                s, held = sum(p * q for p, q in zip(x, z, strict=False)), same if y == label else other
                held[v] = max(held.get(v, s), s)
        for p, sp in sorted(same.items(), key=lambda t: (-t[1], t[0]))[:5]:
            fits = {}
            for v, z, y in good:
                if v != a and y != label:
                    s = sum(m * q for m, q in zip(x, z, strict=False))
                    if 80 * sp <= 100 * s <= 100 * sp:
                        fits[v] = max(fits.get(v, s), s)
            for r, (n, sn) in enumerate(sorted(fits.items(), key=lambda t: (-t[1], t[0]))[:5], 1):
                out.append((a, p, r, n, sp, sn))
    return sorted(out)


def vectors(n, dim, seed, hot=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.random(n) < hot] = x[0]  # a large group of equal vectors: ties
    return [(i * 5, [float(np.float32(c)) for c in v], int(rng.integers(0, 6)), 1, "c") for i, v in enumerate(x)]


@pytest.mark.parametrize("block,cell", [(2048, 1 << 15), (16, 64)])
def test_matches_brute_force(spark, monkeypatch, block, cell):
    monkeypatch.setattr(H, "ROWS", cell), monkeypatch.setattr(H, "BLOCK", block), monkeypatch.setattr(H, "ANCHORS", 8 if block == 16 else 512)
    rows = vectors(700, 24, 0) + [(10_000, [1.0, -1.0], 2, 1, "c"), (10_007, [], 1, 1, "c"), (10_100, None, 1, 1, "c"), (10_200, [float("nan")] * 24, 1, 1, "c")]
    rows += [(10_300, [None] + [1.0] * 23, 1, 1, "c"), (10_400, [1.0] * 24, None, 1, "c"), (None, [1.0] * 24, 1, 1, "c"), (10_500, [0.0] * 24, 3, 1, "c"), (10_600, [900.0] * 24, 3, 1, "c"), (10_601, [-700.5] * 24, 3, 1, "c")]
    rows += [rows[0]] * 9 + [rows[3]] * 9 + [(100, rows[5][1], 4, 1, "c"), (15, rows[7][1], 2, 1, "c"), (15, rows[8][1], 2, 1, "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = H.mined(H.shifted(df), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert H.mined(H.shifted(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_matches_sql(spark):
    rows = vectors(600, 16, 3, hot=0.1)
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("given", df.select("vec_id", "embedding", "label").toArrow())
    con.execute("CREATE TABLE embeddings AS SELECT * FROM given")
    want = con.execute(H.oracle_sql())
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, H.mined(H.shifted(df), F.col("vec_id") % 100 == 0).select(*names).collect())) == sorted(want.fetchall())


def test_intervals_drop_candidates():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(500, 32)) / 6)
    a = np.floor(256 * rng.normal(size=(20, 32)) / 6)
    low, planes = H.Block.sliced(x)
    block = H.Block(np.arange(500), np.zeros(500, np.int64), 32, low, planes)
    exact = (a @ x.T).astype(np.int64)
    floor = np.sort(exact, axis=1)[:, -9].astype(float)
    i, j, s = H.bounded(a, block, np.ones((20, 500), bool), floor, np.full(20, np.inf))
    assert len(i) == 20 * 9 and (exact[i, j] == s).all()
    i, j, s = H.bounded(a, block, np.ones((20, 500), bool), np.full(20, -np.inf), np.full(20, np.inf), k=5)
    assert len(i) < 20 * 50 and (exact[i, j] == s).all() and all((s[i == q] >= np.sort(exact[q])[-5]).sum() >= 5 for q in range(20))


def test_scores_beyond_exact_products_raise():
    with pytest.raises(ValueError):
        H.Block.sliced(np.array([[1e30]]))

import numpy as np

from hopweave.llm import rp_forest as R


def brute(rows):
    ok = [i for i, (v, x) in enumerate(rows) if v is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in ok:
        for j in ok:
            a, b = rows[i][1], rows[j][1]
            if i != j and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    lab = np.arange(n)
    vid = np.array([r[0] if r[0] is not None else 10**9 for r in rows])
    for _ in range(n):
        new = np.where(link, lab[None, :], n).min(axis=1)
        new = np.minimum(new, lab)
        if (new == lab).all():
            break
        lab = new
    low = {}
    for i, x in enumerate(lab):
        low[x] = min(low.get(x, 10**9), vid[i])
    out = []
    for i, (v, _) in enumerate(rows):
        c = None if v is None else int(low[lab[i]])
        out.append((v, int(link[i].sum()), c, v is None or v == c))
    return sorted(out, key=str)


def data(n, dim, rng, copies=3):
    rows, i = [], 0
    for _ in range(n):
        base = rng.normal(size=dim)
        for _ in range(copies):
            x = base + rng.normal(size=dim) * rng.choice([0.0, 0.2, 0.45])
            rows.append((i, [float(np.float32(c)) for c in x]))
            i += 1
    return rows


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = data(120, 24, rng) + data(20, 7, rng)
    rows = [(i, x) for i, (_, x) in enumerate(rows)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [None] + [1.0] * 23), (5004, [float("nan")] + [1.0] * 23), (5005, [float("inf")] * 24), (None, rows[0][1]), (3, rows[3][1]), (5006, [2 * c for c in rows[3][1]])]
    df = spark.createDataFrame([(*r, "l") for r in rows], "vec_id long, embedding array<float>, n string").repartition(5)
    assert sorted(map(tuple, R.near_duplicates(df).collect()), key=str) == brute(rows)
    assert R.near_duplicates(df.limit(0)).count() == 0


def test_recall_in_deep_forests_and_grids(spark, monkeypatch):
    for k, v in (("LEAF", 24), ("CELL", 16), ("LEAST_FIT", 4)):
        monkeypatch.setattr(R, k, v)
    monkeypatch.setattr(R.Forest.__init__, "__defaults__", (R.TREES, 24, R.THRESHOLD, R.SEED))
    rng = np.random.default_rng(3)
    hot = rng.normal(size=32)
    rows = data(150, 32, rng) + [(0, [float(np.float32(c)) for c in hot + rng.normal(size=32) * 0.15]) for _ in range(200)]
    rows = [(i, x) for i, (_, x) in enumerate(rows)]
    got = {r.vec_id: r for r in R.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = brute(rows)
    assert all(got[v].n_links <= n for v, n, _, _ in want)  # no link below the threshold, none counted twice
    assert sum(got[v].n_links for v, *_ in want) >= 0.97 * sum(w[1] for w in want)
    assert np.mean([got[v].component_id == c for v, _, c, _ in want]) > 0.97

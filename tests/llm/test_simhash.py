import numpy as np
import xxhash

from hopweave.llm import simhash_bk as S


def brute_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    f = [brute_print(t) for _, t in rows]
    p = list(range(len(rows)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 2:
                p[find(i)] = find(j)
    return sorted((rows[i][0], f"{f[i]:016x}", min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i in range(len(rows)))


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        w = list(rng.choice(words, 40 + i))
        rows.append((10 * i, " ".join(w)))
        for j in range(3):
            v = list(w)
            v[rng.integers(len(v))] = "Changed"
            rows.append((10 * i + j + 1, "  ".join(v).upper() + "\n"))
    rows += [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "One two"), (2005, "one TWO"), (2006, "é x"), (2007, rows[0][1]), (2007, rows[0][1])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string")
    got = sorted(tuple(r) for r in S.near_duplicates(df).collect())
    assert got == brute(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0
    assert {r[0] for r in S.near_duplicates(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()} == {None}


def test_hot_keys_are_split_exactly(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    pts = {base}
    while len(pts) < 400:
        pts.add(base ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    pts = np.array(sorted(pts), dtype=np.uint64)
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(pts.view(np.int64))], "fp long, rep long")
    from hopweave.llm.common import connected_components

    want = {r[0]: r[1] for r in connected_components(S.links(df)).collect()}
    monkeypatch.setattr(S, "HOT_KEY", 3)
    got = {r[0]: r[1] for r in connected_components(S.links(df)).collect()}
    near = np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 2
    lab = np.arange(len(pts))
    for _ in range(len(pts)):
        new = np.where(near, lab[None, :], len(pts)).min(axis=1)
        if (new == lab).all():
            break
        lab = new
    brute = {i: int(x) for i, x in enumerate(lab) if near[i].sum() > 1}
    assert want == brute and got == brute


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 2), (3, "A b C d", 3), (9, "quite another text", 4), (None, "a b c d", 5), (None, None, 6), (7, None, 7), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n int")
    assert sorted(r._n for r in S.one_per_component(df).collect()) == [3, 4, 5, 6, 7]
    twice = df.where("doc_id = 5")
    assert S.one_per_component(twice).count() == 1

import hashlib
import zlib

import duckdb
import pytest

from hopweave.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int, path array<int>"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def climb(digests):
    """(root, for each digest its levels of (before, after))"""
    paths, at, now = [[] for _ in digests], list(range(len(digests))), digests
    while len(now) > 1:
        for i, p in enumerate(paths):
            run = now[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
            p.append(("".join(run[: at[i] % 8]), "".join(run[at[i] % 8 + 1 :])))
        now = [sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)]
        at = [a // 8 for a in at]
    return now[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted([(r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in rows if r[2] == g], key=lambda x: x[:3]) for g in langs}
    trees = {g: climb([x[2] for x in own[g]]) for g in langs}
    root, tops = climb([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (_, _, h, r), path in zip(own[g], trees[g][1], strict=True):
            path = path + top
            turned = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])) if turned else h
            for before, after in path:
                now = sha(before + now + after)
            out.append((r[0], h, trees[g][0], root, sha("".join(b + a for b, a in path)), now, now == root))
    return out


def table(n):
    texts = [None, "", "plain words", "Upper Case", "ÄÖ É kept", "12:x-", "A" * 300_000, "\x00Z\n"]
    rows = [(i - 5, texts[i % 8], (None, "", "en", "fr", "en", "zé", "en")[i % 7], ("a", None, "")[i % 3], (i, None)[i % 2], "d", 1, [1]) for i in range(n)]
    return rows + [(3, "Same row", "en", "s", 8, "d", 1, None)] * 40 + [(None, "No Id", "en", None, None, None, None, None)] * 9 + [(10**12, "Alone", "solo", "s", 5, None, None, None)]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 700])
def test_matches_plain_python(spark, n):
    rows = table(n) if n > 1 else [(7, "Only One", None, None, 3, "d", 1, None)] * n
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = M.verified(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows) if rows else [], key=str)


def test_sql_and_proofs(spark):
    rows = table(200)
    df = spark.createDataFrame(rows, SCHEMA).drop("digest", "tree", "path")
    con = duckdb.connect()
    con.register("given", df.toArrow())
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    got, want = M.verified(df), con.execute(M.oracle_sql())
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
    kept = M.manifest(df, fanout=3).withColumn("again", M.folded(M.F.col("leaf"), M.F.col("proof")))
    assert kept.where("again <> root").count() == 0 and kept.select("root").distinct().count() == 1

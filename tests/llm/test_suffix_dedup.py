import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import suffix_dedup as S


def covered(rows, length):
    """For each row, which bytes a string of `length` bytes covers that also starts elsewhere."""
    count = Counter(d[i : i + length] for _, t in rows for d in [(t or "").encode()] for i in range(len(d) - length + 1))
    for _, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        yield d, gone[: len(d)]


def stretches_of(gone):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut_passages(rows, passage):
    """For each row what is left without repeated passages, and these."""
    for d, gone in covered(rows, passage):
        found = [(a, b) for a, b in stretches_of(gone) if b - a >= S.LENGTH or len(d[a:b].split()) >= S.WORDS]
        left = bytes(c for i, c in enumerate(d) if not any(a <= i < b for a, b in found))
        yield left.decode(errors="ignore"), found


def brute(rows, length):
    out = []
    for (k, _), (d, gone) in zip(rows, covered(rows, length)):
        left = bytes(c for c, g in zip(d, gone) if not g)
        out.append((k, len(d), int(gone.sum()), len(stretches_of(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=1, max_size=40), st.integers(0, 40)), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_interleaves_are_the_sorted_orders(words):
    group, data = np.array([g for g, _, _ in words]), [w.encode() for _, w, _ in words]
    off = np.array([min(o, len(w)) for _, w, o in words])
    places = set()
    for place, order, prefix in S.interleaves(group, data, off):
        places.add(place)
        rows = {i: (group[i], data[i][off[i] + place :]) for i in range(len(words)) if 0 <= off[i] + place < len(data[i])}
        assert sorted(order) == sorted(rows) and [rows[i] for i in order] == sorted(rows.values())
        for x, y, p in zip(order, order[1:], prefix[1:]):
            a, b = rows[x][1], rows[y][1]
            same = next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))
            assert p == (same if group[x] == group[y] else -1)
    assert places == {i - o for w, o in zip(data, off.tolist()) for i in range(len(w))}


def texts(rng, n, alphabet):
    pool = ["".join(rng.choice(list(alphabet), rng.integers(20, 90))) for _ in range(12)]
    return ["".join(pool[rng.integers(12)] if rng.random() < 0.5 else "".join(rng.choice(list(alphabet), rng.integers(1, 40))) for _ in range(rng.integers(0, 8))) for _ in range(n)]


@pytest.mark.parametrize(("alphabet", "length", "turn", "hot"), [("abcdefghij é", 25, 1 << 22, 20_000), ("ab", 40, 64, 20_000), ("abcé", 25, 200, 1), ("a", 30, 1 << 22, 2), ("a b", 30, 128, 20_000)])
def test_matches_brute_force(spark, monkeypatch, alphabet, length, turn, hot):
    monkeypatch.setattr(S, "TURN", turn)
    monkeypatch.setattr(S, "HOT", hot)
    t = texts(np.random.default_rng(length), 60, alphabet)
    rows = list(enumerate(t)) + [(1000, None), (1001, ""), (None, t[3]), (5, t[5]), (5, t[5]), (1002, "a" * 200), (-1, t[3])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(4)
    monkeypatch.setattr(S, "WORDS", 4), monkeypatch.setattr(S, "LENGTH", 60)
    assert sorted(map(tuple, S.digests(df, length).collect()), key=str) == brute(rows, length)
    left = sorted(((r.doc_id, r.text) for r in S.without_repeats(df, length).collect()), key=str)
    assert left == sorted(((k, t if t is None else cut) for (k, t), (cut, _) in zip(rows, cut_passages(rows, length))), key=str)


def test_production_length_and_text(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    say = lambda n: " ".join(rng.choice(words, n))
    shared, edge = say(150), say(200).encode()[:400].decode()
    rows = [(1, say(50) + shared + say(60)), (2, shared + "é" + say(90)), (3, say(300)), (4, "x" + edge + "y"), (5, "z" + edge + "q"), (6, "z" + edge[:-1] + "!")]
    big = say(400)
    rows += [(10 + i, big) for i in range(40)] + [(60 + i, big[: 700 + i] + "#" + big[701 + i :]) for i in range(40)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    assert sorted(map(tuple, S.digests(df).collect()), key=str) == brute(rows, 400)
    left = {r.doc_id: r for r in S.without_repeats(df).collect()}
    assert left[3].text == rows[2][1] and left[4].text == "xy" and left[10].text == "" and left[1].source == "s" and len(left) == len(rows)
    assert {k: r.text for k, r in left.items()} == {k: cut for (k, _), (cut, _) in zip(rows, cut_passages(rows, 200))}
    assert S.digests(df.limit(0)).count() == 0


def test_repeated_rows_cost_in_proportion(spark):
    """Rows that share a null id and a text share their spans: these are made once, not for each pair of rows."""
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice([f"w{i}" for i in range(3000)], 350))
    rows = [(None, text)] * 4000 + [(7, text[:-300] + "!" + text[-299:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = Counter(map(tuple, S.digests(df).collect()))
    want = Counter({r: 4000 if r[0] is None else 1 for r in brute(rows[-3:], 400)})
    assert got == want


def test_planted_passages_are_told_from_clean_documents(spark):
    """Passages of 51 to 55 words are mostly shorter than 400 bytes, and still stand in the result."""
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(rng.choice([f"w{i}" for i in range(9000)], n))
    planted = [say(51 + i % 5) for i in range(10)]
    rows = [(i, say(60) + " " + (planted[i % 10] + " " if i < 30 else "") + say(70)) for i in range(90)] + [(90, None), (91, say(400))] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.digests(df, 400, 200).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 400)
    assert sorted(((r.doc_id, r.n_passages, r.passage_bytes) for r in got), key=str) == sorted(((k, len(f), sum(b - a for a, b in f)) for (k, _), (_, f) in zip(rows, cut_passages(rows, 200))), key=str)
    assert {r.doc_id for r in got if r.n_passages} == {*range(30), 91} and all(r.n_removed == 0 for r in got if r.doc_id < 90)

import unicodedata
import zlib

import numpy as np
import public_tokenizers as P

from hopweave.llm import langid as L


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield [pieces.get(word[:k], len(pieces)), *rest]


def test_forward_sums_all_segmentations():
    names = ["a", "ab", "b", "ba", "bab", "▁", "▁a", "c"]
    pieces = {p: i for i, p in enumerate(names)}
    rng = np.random.default_rng(0)
    prob = np.vstack([rng.random((len(names) + 1, 3)), np.zeros(3)])
    prob /= prob.sum(axis=0)
    words = ["▁abab", "▁", "bzb", "bababé", "c" * 60]
    lattice = L.Lattice(names)
    want = [np.log(sum(np.prod([prob[p] for p in s], axis=0) for s in segmentations(w, pieces))) for w in words]
    assert np.allclose(lattice.scores(words, prob), want)
    times = rng.integers(0, 5, (len(words), 3)).astype(float)
    uses = np.zeros((len(names) + 1, 3))
    for w, t in zip(words, times):
        each = [(s, np.prod([prob[p] for p in s], axis=0)) for s in segmentations(w, pieces)]
        z = sum(x for _, x in each)
        for s, x in each:
            for p in s:
                uses[p] += t * x / z
    assert np.allclose(lattice.expected(words, times, prob), uses)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    stems = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["schnee", "wald", "berg", "und"], "zz": ["été", "neige", "bois", "roi"]}
    rows = [(i, " ".join(rng.choice(stems[k := sorted(stems)[i % 3]], 12)), k) for i in range(240)]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 _ !", "xx"), (1004, "² ½ ③", "xx"), (1005, "Ⅷ ⅓", "xx"), (None, "wald berg", "yy"), (1003, "schnee " * 3000 + "w" * 500, None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    got = L.identified(df, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002, 1004, 1005):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id == 1003 or r.doc_id is None:
            assert r.lang_pred == "yy"
        else:
            assert r.lang_pred == truth[r.doc_id]
    assert {r.lang_pred for r in L.identified(df.withColumn("lang", df["lang"].substr(9, 1)).limit(0), P.path("piece_bpe_32k.model")).collect()} == set()


def test_letters_are_letters():
    every = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs"))
    assert {c for w in L.LETTERS.findall(every) for c in w} == {c for c in every if unicodedata.category(c)[0] == "L"}


def test_whole_operator_against_enumeration(spark, monkeypatch):
    """Learning and scores by listing every segmentation, in plain Python, on a small vocabulary."""
    names = sorted(["a", "ab", "b", "ba", "▁", "▁a", "▁b", "c", "▁ca"])
    pieces = {p: i for i, p in enumerate(names)}
    monkeypatch.setattr(L, "pieces_of", lambda _: names)
    rng = np.random.default_rng(4)
    draw = lambda p: " ".join("".join(rng.choice(list("abcz"), rng.integers(1, 6), p=p)) for _ in range(6))
    rows = [(i, draw([0.5, 0.3, 0.1, 0.1] if i % 2 else [0.1, 0.2, 0.6, 0.1]), "xy"[i % 2]) for i in range(40)]
    rows += [(100, "12 ½", "x"), (101, None, "y"), (102, "ab! ca²ba", None), (None, "ab", "y"), (3, rows[3][1], rows[3][2])]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    langs = ["x", "y"]
    words = [(w, langs.index(lang)) for d, t, lang in rows if d is not None and t is not None and lang and not held(d) for w in L.words_of(t)]
    prob = [[1 / (len(names) + 1)] * 2 for _ in range(len(names) + 1)]
    total = lambda w, k: sum(float(np.prod([prob[p][k] for p in s])) for s in segmentations(w, pieces))
    for _ in range(L.ROUNDS):
        uses = [[L.SMOOTHING] * 2 for _ in range(len(names) + 1)]
        for w, k in words:
            z = total(w, k)
            for s in segmentations(w, pieces):
                for p in s:
                    uses[p][k] += float(np.prod([prob[q][k] for q in s])) / z
        prob = [[u[k] / sum(v[k] for v in uses) for k in (0, 1)] for u in uses]
    got = sorted(L.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect(), key=str)
    want = []
    for d, t, _ in rows:
        logs = [sum(np.log(total(w, k)) for w in L.words_of(t)) for k in (0, 1)]
        best = 0 if logs[0] >= logs[1] else 1
        want.append((d, held(d), langs[best], 1 / sum(np.exp(x - logs[best]) for x in logs)) if L.words_of(t) else (d, held(d), "und", 0.0))
    for a, b in zip(got, sorted(want, key=lambda r: str(next(g for g in got if g.doc_id == r[0]))), strict=True):
        assert tuple(a)[:3] == b[:3] and abs(a.score - b[3]) < 1e-9

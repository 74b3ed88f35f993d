import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import quality_crf as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


@given(st.one_of(st.none(), st.text("ab c\n\t\r\x0b\x0c\x1c\x85\xa0#|é", max_size=120), st.text(max_size=60)))
@settings(max_examples=300, deadline=None)
def test_base_counts(text):
    got = Q.verdict(text, Q.prior())
    assert got[:6] == brute(text)
    assert not (got[5] and got[6])
    assert Q.lines_of(text)[1].sum() == got[0]  # the labels' words are the rules' words


@given(st.integers(1, 7), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_viterbi_finds_the_best_labels(n, seed):
    rng = np.random.default_rng(seed)
    f, w = rng.integers(0, 2, (n, len(Q.FEATURES))).astype(float), rng.normal(size=len(Q.FEATURES) + 1)
    s = f @ w[:-1]
    score = lambda y: sum((2 * a - 1) * b for a, b in zip(y, s)) + sum(w[-1] if a != b else -w[-1] for a, b in zip(y, y[1:]))
    best = max(map(score, itertools.product((0, 1), repeat=n)))
    assert abs(score(Q.viterbi(f, w).tolist()) - best) < 1e-9


def test_gradient_ascent_raises_the_likelihood():
    rng = np.random.default_rng(0)
    k = len(Q.FEATURES)
    docs = [(np.where(rng.random((8, k)) < 0.2, 1.0, 0.0) * (np.arange(k) != 2), 1) for _ in range(30)] + [(np.where(rng.random((8, k)) < 0.2, 1.0, 0.0) + (np.arange(k) == 2), 0) for _ in range(30)]
    w = Q.fit([(np.minimum(f, 1), y) for f, y in docs])
    assert w[2] < 0 and np.isfinite(w).all() and np.allclose(Q.fit([]), Q.prior())


GOOD = "The quick brown fox jumps over the lazy dog near the old river bank.\nAnother plain sentence follows here, with quite enough words in it to read.\n" + " ".join(f"word{i}x" for i in range(40)) + "."
BAD = "\n".join(" ".join(f"{w}$$$" for w in f"alpha beta{i} gamma{i} delta{i} eps{i} zeta{i}".split()) for i in range(12))


def test_frame(spark):
    rows = [(1, GOOD, "a"), (2, BAD, "b"), (3, None, "c"), (3, "", "d"), (None, GOOD, "e"), (4, "word " * 30, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    for lab in (None, labels, labels.limit(0)):
        got = {(r.doc_id, r.n_words): r.kept for r in Q.quality(df, lab).collect()}
        assert got == {(1, 67): True, (None, 67): True, (2, 72): False, (3, 0): False, (4, 30): False}
        assert sorted(r[2] for r in Q.kept(df, lab).collect()) == ["a", "e"]
    assert Q.quality(df.limit(0), labels).count() == 0


def best_labels(scores, change):
    """The best labelling by plain recursion over lines, boilerplate on a tie of the last line's."""
    ways = {0: (-scores[0], [0]), 1: (scores[0], [1])}
    for s in scores[1:]:
        step = {}
        for y in (0, 1):
            v, path = max(((ways[x][0] + (change if x != y else -change), ways[x][1]) for x in (0, 1)), key=lambda t: t[0])
            step[y] = (v + (2 * y - 1) * s, [*path, y])
        ways = step
    return max(ways.values(), key=lambda t: t[0])[1]


def test_whole_query_against_plain_python(spark):
    """op5 on whole tables: counts by brute force, and the field's verdicts by the sampled rows and labels worked out again."""
    from hopweave.llm import registry

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    known = [(Q.lines_of(docs[i])[0], int(q > 0)) for i, q in labels.items() if i in docs]
    assert len(known) < Q.SAMPLE and all(len(f) <= Q.SAMPLE_LINES for f, _ in known)  # all of them are the sample
    w = Q.fit(known)
    got = {r.doc_id: r for r in registry.op5_crf_quality(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        counts = brute(text)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counts
        f, sizes, _ = Q.lines_of(text)
        labelled = best_labels((f @ w[:-1]).tolist(), w[-1]) if len(f) else []
        share = sum(n for n, y in zip(sizes.tolist(), labelled) if y) / max(1, sum(sizes.tolist()))
        assert got[i].kept == (not counts[5] and share >= Q.CONTENT_SHARE), i


def test_megabytes(spark):
    text = GOOD + "\n" + "\n".join(" ".join(f"{w}{i}" for w in "these are all words of one line alone".split()) + "." for i in range(60_000))
    got = Q.quality(spark.createDataFrame([(1, text), (2, "#" * 3_000_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_symbols, r.kept) for r in got} == {1: (len(text.split()), 0, True), 2: (1, 3_000_000, False)}

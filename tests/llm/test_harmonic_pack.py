import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hopweave.llm import harmonic_pack as H


@given(st.integers(1, 20000), st.sampled_from([8, 100, 2048]))
@settings(max_examples=200, deadline=None)
def test_cuts_cover_and_fit(n, capacity):
    c = H.cuts(n, capacity)
    assert sum(x for x, _ in c) == n and all(0 < x and x * k <= capacity for x, k in c)


@pytest.mark.parametrize("sizes", [[1], [2048], [2049, 5, 700], list(np.random.default_rng(0).integers(1, 6000, 800))])
def test_worker_fills_whole_sequences(sizes):
    w = H.Worker(2048)
    seqs = [s for i, n in enumerate(sizes) for s in w.add(i, np.arange(n, dtype="<u4"))] + list(w.close())
    got = defaultdict(dict)
    for s in seqs:
        used = sum(len(p[2]) for p in s)
        assert 0 < used <= 2048
        for d, at, ids, n in s:
            assert n == sizes[d] and at not in got[d]
            got[d][at] = ids
    for d, n in enumerate(sizes):
        assert np.array_equal(np.concatenate([got[d][k] for k in sorted(got[d])]), np.arange(n))
    used = [sum(len(p[2]) for p in s) for s in seqs]
    padded = sum(2048 - u for u in used if u & (u - 1))
    assert padded <= 0.02 * sum(used) + 64


def test_pack_matches_library(spark):
    path = P.path("byte_bpe_50k.json")
    texts = ["Hello world", None, "", "word " * 5000, "a<|endoftext|>b", "é漢字"] + [f"text {i} " * (i % 90) for i in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(4)
    got = H.pack(df, path).collect()
    tk = Tokenizer.from_file(path)
    want = {d: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        docs[r.doc_id].append((r.start, ids.tolist()))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert {d: sum((i for _, i in sorted(p)), []) for d, p in docs.items()} == want
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert H.pack(df.limit(0), path).count() == 0

import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import bpe_replay as B

PATH = P.path("byte_bpe_50k.tiktoken")
R = B.replay(PATH)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text("aehtn <|endof>\n'", max_size=200)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_match_library_and_decode(texts):
    got = R.encode(texts)
    assert [a.tolist() for a in got] == [ENC.encode_ordinary(t or "") for t in texts]
    assert [R.decode(a.tolist()) for a in got] == [(t or "").encode() for t in texts]


def test_runs_and_long_words():
    texts = ["a" * n for n in range(60)] + ["ab" * 3000, "0" * 5001, "-" * 777, " " * 300, "the" * 999]
    assert [a.tolist() for a in R.encode(texts)] == [ENC.encode_ordinary(t) for t in texts]


def test_frame(spark):
    rows = [(1, "Hello world", 0), (None, None, 0), (3, "", 0), (3, "", 0), (4, "word " * 600, 0), (5, "é漢字<|endoftext|>", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((tuple(r)[:4] for r in B.encoded(df, PATH).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i := ENC.encode_ordinary(t or "")), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for d, t, _ in rows]
    assert got == sorted(want, key=str)
    assert B.encoded(df.limit(0), PATH).count() == 0

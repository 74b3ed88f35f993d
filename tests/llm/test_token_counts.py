import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hopweave.llm import token_counts as C

PATH = P.path("byte_bpe_50k.json")
TK = Tokenizer.from_file(PATH)


@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text("ab <|endoftx>\n'", max_size=60), st.just("x<|endoftext|> y<|endoftext|>")), max_size=8))
@settings(max_examples=150, deadline=None)
def test_counts_match_library(texts):
    assert C.merger(PATH).batch(texts) == [len(TK.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_runs_and_long_words():
    texts = ["a" * n for n in range(40)] + ["ab" * 3000, "0" * 5001, "-" * 777, " " * 300]
    assert C.merger(PATH).batch(texts) == [len(TK.encode(t, add_special_tokens=False).ids) for t in texts]


def test_frame(spark):
    rows = [(1, "Hello world", 0), (None, None, 0), (3, "", 0), (3, "", 0), (4, "word " * 600, 0), (5, "é漢字", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, C.token_counts(df, PATH).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(TK.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _ in rows]
    assert got == sorted(want, key=str)
    assert C.token_counts(df.limit(0), PATH).count() == 0

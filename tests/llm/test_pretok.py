import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hopweave.llm import pretok

PIECES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "a", "é", "漢", "😀", "1", "²", "Ⅷ", "!", "_", "re", "l", "S", "́", "​"]
TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=30), st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.just("x" + pretok.MARK + " y")), max_size=6)


@given(TEXTS)
@settings(max_examples=1500, deadline=None)
def test_rules_match_the_pattern(texts):
    words, counts = pretok.pretokens(texts)
    want = [pretok.splitter().findall(t or "") for t in texts]
    assert words == [w for x in want for w in x] and counts == [len(x) for x in want]


def test_the_pattern_is_the_known_one():
    assert P.PATTERN == pretok.KNOWN


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_encoder_matches_library(texts):
    path = P.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    assert [a.tolist() for a in pretok.library_encoder(path)(texts)] == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]

import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hopweave.llm import forced_bpe as B

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = B.encoder(PATH)


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("aEé'sSt ΣİßｱǺ\u0085\xa0½Ⅷ#*9<|endoftx>\n", max_size=120)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_ids_match_library_and_decode(texts):
    got = [a.tolist() for a in OWN.encode(texts)]
    assert got == [ids(t) for t in texts]
    assert [OWN.decode(a) for a in got] == [LIB.decode(a, skip_special_tokens=False) for a in got]


def test_quick_way_is_taken():
    assert OWN.simple and not OWN.odd.search("Größe “naïve” – 5 €")


@pytest.mark.parametrize("text", ["a" * 900, "ab" * 3000, "zqxj" * 9000, "=" * 100_000, "É" * 4000, "漢字" * 3000, "x<|endoftext|><|startoftext|>y <|endoftext", "a <|endoftext|>́b", " \n\t", "don't WE'LL 'Tis"])
def test_whole_texts(text):
    assert OWN.encode([text])[0].tolist() == ids(text)


def test_megabytes_in_stretches():
    text = "Some Words, 12 and more… " * 90_000 + "y" * 700_000 + " end"
    assert OWN.encode([text])[0].tolist() == ids(text)


def test_cuts_are_forced():
    word = "xqzvjkqhello"
    parts = OWN.fragments(word.encode())
    assert b"".join(parts) == word.encode() and len(parts) > 1
    held = {t.removesuffix(OWN.end) for t in LIB.get_vocab()}
    for a, b in zip(parts, parts[1:], strict=False):
        pair = chr(a[-1]) + chr(b[0])
        assert b is parts[-1] and len(b) == 1 or not any(pair in t for t in held)


def test_frame(spark):
    rows = [(1, "Hello World", 0), (None, None, 0), (3, "", 0), (3, "", 0), (4, "word " * 600, 0), (5, "é漢字<|endoftext|>", 0), (6, "Qzxj-" * 40_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(i := ids(t)), sha(" ".join(map(str, i))), sha(LIB.decode(i, skip_special_tokens=False))) for d, t, _ in rows]
    assert sorted((tuple(r)[:4] for r in B.encoded(df, PATH).collect()), key=str) == sorted(want, key=str)
    assert B.encoded(df.limit(0), PATH).count() == 0

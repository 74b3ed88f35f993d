"""Texts of megabytes through the operators that take whole texts, beside the libraries or plain Python."""

import base64
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from hopweave.llm import bpe_replay, harmonic_pack, langid, simhash_bk, suffix_dedup, token_counts, token_output
from hopweave.llm.common import new_path

BYTE = P.path("byte_bpe_50k.json")
RNG = np.random.default_rng(3)
STEMS = ["ka", "lo", "mi", "nu", "pé", "ra", "so", "tü", "ve", "zi"]
LONG = " ".join("".join(RNG.choice(STEMS, RNG.integers(1, 5))) for _ in range(250_000))
TEXTS = {1: LONG, 2: "x" * 1_000_000, 3: "- " * 400_000, 4: "short text"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def ids():
    tk = Tokenizer.from_file(BYTE)
    return {i: tk.encode(t, add_special_tokens=False).ids for i, t in TEXTS.items()}


def test_token_file_counts_and_packing(spark, docs, ids):
    sums = {i: zlib.crc32(np.array([*own, 0], "<u4").tobytes()) for i, own in ids.items()}
    got = token_output.token_digests(docs, new_path(spark, "long"), BYTE, 0).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {i: (len(own) + 1, sums[i]) for i, own in ids.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BYTE).collect()} == {i: len(own) for i, own in ids.items()}
    pieces: dict[int, list] = {}
    for r in harmonic_pack.pack(docs, BYTE, end_id=1).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4")))
    for i, own in ids.items():
        assert np.concatenate([x for _, x in sorted(pieces[i], key=lambda p: p[0])]).tolist() == [*own, 1]


def test_replay(docs):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    texts = {i: t for i, t in TEXTS.items() if i != 2}  # the library is quadratic in one long word
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_replay.encoded(docs.where("doc_id <> 2"), path).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in texts.items()}


def test_fingerprints_and_languages(docs):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        bits = [int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h) for b in range(64)]
        return f"{sum(1 << b for b, x in enumerate(bits) if x):016x}"

    assert {r.doc_id: r.fingerprint for r in simhash_bk.near_duplicates(docs).collect()} == {i: fingerprint(t) for i, t in TEXTS.items()}
    labelled = docs.selectExpr("doc_id", "text", "if(doc_id = 3, null, 'aa') as lang")
    assert {r.doc_id: r.lang_pred for r in langid.identified(labelled, P.path("piece_bpe_32k.model")).collect()} == {1: "aa", 2: "aa", 3: "und", 4: "aa"}


def test_repeats(docs):
    """Runs repeat 400 bytes within their own text and go whole; words drawn at random do not."""
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digests(docs, length=400).collect()}
    assert got == {1: (len(LONG.encode()), 0, 0), 2: (1_000_000, 1_000_000, 1), 3: (800_000, 800_000, 1), 4: (10, 0, 0)}

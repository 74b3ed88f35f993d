"""BPE with word ends by forced boundaries: encoding and decoding.

A token is a run of bytes of one pre-token, so two neighbouring bytes that stand side by side inside no token of the
vocabulary can never be merged into one: between them a cut is certain. Pre-tokens are cut there, each fragment is
merged for itself, and the ids are put one after another. Normaliser, pre-tokeniser and the merging of one fragment are
the tokenizers library's.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed
from .pretok import REMEMBERED, byte_alphabet, chunks

#: Characters of text that are split into pre-tokens at once.
STRETCH = 1 << 19
#: Longer pre-tokens are encoded whenever they come up, not remembered.
SHORT = 256
BLANK = re.compile(r"[ \t\n\r\f\v]")
#: Code points that lower one by one and compose with nothing before them: Latin and general punctuation.
SIMPLE = [*range(0x250), *range(0x2010, 0x205F), 0x20AC, 0x2122]
#: The words that the pre-tokeniser's pattern names (fixed value).
SHORT_FORMS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class(codes: list[int]) -> str:
    return "".join(f"\\U{c:08x}" for c in codes)


def simple_parts() -> tuple[re.Pattern, re.Pattern]:
    """(finds a character outside SIMPLE, finds the pre-tokens of lower-cased text inside it).

    Both are for the pattern `short forms | \\p{L}+ | \\p{N} | [^\\s\\p{L}\\p{N}]+`.
    """
    lower = sorted({ord(x) for c in SIMPLE for x in chr(c).lower()})
    of = lambda first: [c for c in lower if unicodedata.category(chr(c))[0] == first]
    letter, number = _class(of("L")), _class(of("N"))
    blank = r"\t\n\v\f\r\x85" + _class(of("Z"))
    return re.compile(f"[^{_class(SIMPLE)}]"), re.compile(f"{SHORT_FORMS}|[{letter}]+|[{number}]|[^{blank}{letter}{number}]+")


class _Known(dict):
    """Pre-token (or special id) -> its ids as bytes."""

    def __init__(self, own: ForcedBpe):
        self.own = own

    def __missing__(self, word: str | int) -> bytes:
        if isinstance(word, int):
            return word.to_bytes(4, "little")
        parts = self.own.fragments(word.encode())
        out = b"".join([self.own.merged(p, False) for p in parts[:-1]]) + self.own.merged(parts[-1], True)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


class ForcedBpe:
    def __init__(self, path: str):
        """path: a tokenizers .json file of byte-level BPE with an end-of-word suffix."""
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = byte_alphabet()
        self.byte = {c: b for b, c in names.items()}
        self.name = {b: c for b, c in names.items() if chr(b) != c}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: The library's merging: [0] inside a word, [1] at its end, where the last byte carries the suffix.
        self.models = (BPE(vocab=vocab, merges=merges), BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.end))
        #: Byte pairs that some token holds: [0] both inside the word, [1] the second ends it.
        self.joined: tuple[set[tuple[int, int]], set[tuple[int, int]]] = (set(), set())
        for token in vocab:
            ends = token.endswith(self.end) and len(token) > len(self.end)
            body = [self.byte[c] for c in (token[: -len(self.end)] if ends else token)]
            found = list(zip(body, body[1:], strict=False))
            self.joined[1].update(found[-1:] if ends else ())
            self.joined[0].update(found[:-1] if ends else found)
        self.odd, self.parts = simple_parts()
        self.simple = all(self.parts.findall(t.lower()) == self._by_library(t) for t in [*map(chr, SIMPLE), *self._samples()])
        self.known = _Known(self)

    def _samples(self) -> list[str]:
        """Texts on which the quick way must agree with the library, beside every simple character alone."""
        every = "".join(map(chr, SIMPLE))
        return [every, every[::-1], " ".join(every), "it's we'll I'd'VE don't 'tis ab12cd.,;x a\u00a0b\u2028c"]

    def _by_library(self, text: str) -> list[str]:
        own = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(own)]

    def pretokens(self, text: str) -> list[str]:
        """Of a text without special strings. The library is asked for words that hold other characters than SIMPLE."""
        if self.simple and not self.odd.search(text):
            return self.parts.findall(text.lower())
        out: list[str] = []
        for word in text.encode().split():  # at ASCII white space, which nothing composes with
            own = word.decode()
            out += self.parts.findall(own.lower()) if self.simple and not self.odd.search(own) else self._by_library(own)
        return out

    def fragments(self, word: bytes) -> list[bytes]:
        """A non-empty pre-token cut where no token holds both bytes; the last fragment ends it."""
        inside, ending = self.joined
        cuts = [i for i, p in enumerate(zip(word, word[1:-1], strict=False), 1) if p not in inside]
        if len(word) > 1 and (word[-2], word[-1]) not in ending:
            cuts.append(len(word) - 1)
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def merged(self, fragment: bytes, ends: bool) -> bytes:
        """ids (u4, little endian) of a fragment for itself; ends: it ends its pre-token."""
        own = fragment.decode("latin-1")
        if not (own.isascii() and own.isprintable()):
            own = own.translate(self.name)
        return array("I", [t.id for t in self.models[ends].tokenize(own)]).tobytes()

    def _pieces(self, text: str) -> list[str | int]:
        if not self.marks or not self.marks.search(text):
            return self.pretokens(text)
        out: list[str | int] = []
        for own in self.marks.split(text):
            out += [self.special[own]] if own in self.special else self.pretokens(own)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text as Tokenizer.encode(text, add_special_tokens=False) gives them; null: none."""
        get = self.known.__getitem__
        return [np.frombuffer(b"".join([b"".join(map(get, self._pieces(s))) for s in stretches(t or "")]), "<u4") for t in texts]

    def decode(self, ids: list[int]) -> str:
        """As Tokenizer.decode(ids, skip_special_tokens=False): the file names no decoder, so tokens are joined by blanks."""
        return " ".join(map(self.token.__getitem__, ids))


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters, cut at ASCII white space only."""
    at = 0
    while len(text) - at > STRETCH:
        gap = BLANK.search(text, at + STRETCH)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


@lru_cache(2)
def encoder(path: str) -> ForcedBpe:
    """One for each Python worker and file."""
    return ForcedBpe(path)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (u32, little endian).

    A row for each row, repeated ones too. Null and empty texts have no ids (both digests are of nothing), and neither
    has a text of white space. The file's special strings inside a text are their tokens. Texts are encoded whole,
    however long, a stretch at a time. An empty table gives an empty one; other columns, whatever their names, play no part.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        decimal = {i: str(i) for i in own.token}
        for b in batches:
            for first, texts in chunks(b.column("text"), STRETCH):
                arrays = own.encode(texts)
                digests, decoded = [], []
                for a in arrays:
                    ids = a.tolist()
                    digests.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(texts)), pa.array([len(a) for a in arrays], pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array([a.tobytes() for a in arrays], pa.binary())], names)

    return keyed(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")

"""Pre-tokens of byte-level BPE, and ids by the tokenizers library with each distinct pre-token encoded once."""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

#: Distinct pre-tokens that a Python worker remembers; beyond it they are encoded again.
REMEMBERED = 900_000


#: The pattern that pretokens() knows by its rules (fixed value).
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands between pre-tokens for a moment; texts that hold it are matched with the pattern.
MARK = "\U0010ffff"
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(1)
def splitter() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, as the pattern's \\s, \\p{L} and \\p{N} have it."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(name, every):
            out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def _starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end; first: whether a text starts at each code point (and past the end).

    Runs of one class stay together. A space joins the run behind it; of more white space before a run the last one
    stands alone, or joins the run if it is a space. A contraction's letters go with an apostrophe that starts a token.
    """
    n = len(code)
    kind = classes()[code]
    gap = kind == SPACE
    at = first[:n].copy()
    at[1:] |= kind[1:] != kind[:-1]
    at[1:] &= first[1:n] | ~((code[:-1] == 32) & ~gap[1:])  # a space joins what follows
    before_run = np.zeros(n, bool)
    before_run[:-1] = gap[:-1] & ~gap[1:] & ~first[1:n]
    at[1:] |= before_run[1:] & gap[:-1]  # the last white space before a run
    quote = np.flatnonzero((code == 39) & at)
    if len(quote):
        ends = np.flatnonzero(first)  # of each text, as the next one's start
        stop = ends[np.searchsorted(ends, quote, side="right")]
        padded = np.append(code, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (quote + 1 < stop)
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs]) & (quote + 2 < stop)
        for where, size in ((quote[short], 2), (quote[long], 3)):
            at[where + 1] = False
            rest = where + size
            at[rest[rest < n]] = True
    return at


def pretokens(texts: list[str | None]) -> tuple[list[str], list[int]]:
    """(the pre-tokens of all texts, one text after another; how many each text has), as the pattern matches them."""
    words: list[str] = []
    counts: list[int] = []
    for _, part in stretches(texts, 1 << 15):  # small enough for a core's cache
        own, n = _pretokens([t or "" for t in part])
        words += own
        counts += n
    return words, counts


def stretches(texts, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first, texts) of up to about `most` characters, one text at least."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text or "")
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _pretokens(texts: list[str]) -> tuple[list[str], list[int]]:
    whole = "".join(texts)
    if public_tokenizers.PATTERN != KNOWN or MARK in whole or not whole:
        found = [splitter().findall(t) for t in texts]
        return [w for words in found for w in words], [len(words) for words in found]
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    first = np.zeros(len(code) + 1, bool)
    first[begin] = True
    first[-1] = True
    at = _starts(code, first)
    count = np.cumsum(at)
    marked = np.full(len(code) + count[-1], ord(MARK), np.uint32)
    marked[np.arange(len(code)) + count] = code
    words = marked[1:].tobytes().decode("utf-32-le").split(MARK)
    upto = np.concatenate(([0], count))
    return words, (upto[begin + size] - upto[begin]).tolist()


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Pre-token -> its ids as bytes of the given type."""

    def __init__(self, tokenize, dtype: str):
        self.tokenize, self.code = tokenize, {"<u2": "H", "<u4": "I"}[dtype]
        self.table = {b: c for b, c in byte_alphabet().items() if chr(b) != c}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if word.isascii() and word.isprintable():
            own = word.replace(" ", "\u0120")  # the only one of these that another character stands for
        else:
            own = word.encode().decode("latin-1").translate(self.table)
        self[word] = out = array(self.code, [t.id for t in self.tokenize(own)]).tobytes()
        return out


class LibraryEncoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them.

    Byte-level BPE files go through the library's model, one call for each distinct pre-token; texts that hold an
    added token's string, and files of other kinds, go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        pre = spec.get("pre_tokenizer") or {}
        plain = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"}
        self.direct = (
            spec["model"]["type"] == "BPE"
            and spec.get("normalizer") is None
            and (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not any(spec["model"].get(k) for k in plain)
        )
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.pieces = _Pieces(self.library.model.tokenize, self.dtype)

    def whole(self, text: str) -> bool:
        return not self.direct or any(a in text for a in self.added)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text; null: none."""
        words, sizes = pretokens(["" if t is None or self.whole(t) else t for t in texts])
        raw = list(map(self.pieces.__getitem__, words))
        out, at = [], 0
        for text, n in zip(texts, sizes, strict=True):
            if text and self.whole(text):
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype))
            else:
                out.append(np.frombuffer(b"".join(raw[at : at + n]), self.dtype))
            at += n
        return out


def chunks(column: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, list[str | None]]]:
    """stretches() of an Arrow column, converted as they come."""
    return stretches((x.as_py() for x in column), most)


@lru_cache(2)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each Python worker and file."""
    gc.set_threshold(100_000, 50, 100)  # millions of short lists, no cycles: scans of the remembered words would be idle
    return LibraryEncoder(path)

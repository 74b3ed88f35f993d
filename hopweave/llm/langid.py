"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by the forward algorithm; a text's is the product over its words. Probabilities are
learned by expectation-maximisation over the same sums from a bounded sample of labelled documents (SAMPLE a language).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, shuffle_width, written
from .pretok import chunks

#: Labelled documents of a language to learn from, about: those whose id's hash falls below SAMPLE / their number.
SAMPLE = 3000
ROUNDS = 3
#: Letter runs are scored in stretches of so many letters.
STRETCH = 64
#: Added to every piece's expected count.
SMOOTHING = 0.05
#: Characters of text whose new words are scored together.
CHUNK = 4 << 20
#: Words whose scores a Python worker remembers.
REMEMBERED = 400_000
#: Scale of each letter's probability that keeps sums within a double's range; divided out at the end.
SCALE = 16.0
UNDETERMINED = "und"
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased letter runs, cut into stretches, each led by the vocabulary's word mark."""
    out = []
    for w in LETTERS.findall((text or "").lower()):
        for at in range(0, len(w), STRETCH):
            out.append("▁" + w[at : at + STRETCH] if not at else w[at : at + STRETCH])
    return out


def pieces_of(model_file: str) -> list[str]:
    """The vocabulary's pieces that can be part of a lower-cased word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in every if p and (p == "▁" or LETTERS.fullmatch(p.removeprefix("▁"))) and p == p.lower()})


class Lattice:
    """All segmentations of words into pieces; a single letter that is no piece counts as the last, unknown piece."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.array([ord(c) for c in letters])
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        number = {c: i for i, c in enumerate(letters)}
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                at = nodes.setdefault((at, number[c]), len(nodes) + 1)
            ends[at] = i
        keys = np.array([a * len(letters) + c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.node = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1)
        self.piece[list(ends)] = list(ends.values())

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths; piece[w, start, length - 1] or -1) of words, padded to the longest."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(size.max())
        codes = np.zeros((len(words), wide), np.int64)
        codes[np.arange(wide) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        slot = np.minimum(np.searchsorted(self.letter, codes), len(self.letter) - 1)
        known = np.where(self.letter[slot] == codes, slot, -1)
        out = np.full((len(words), wide, min(self.longest, wide)), -1)
        w, start = np.nonzero(np.arange(wide) < size[:, None])
        out[w, start, 0] = self.unknown
        node = np.zeros(len(w), np.int64)
        for k in range(out.shape[2]):
            inside = start + k < size[w]
            w, start, node = w[inside], start[inside], node[inside]
            c = known[w, start + k]
            key = node * len(self.letter) + c
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = (c >= 0) & (self.keys[at] == key)
            w, start, node = w[good], start[good], self.node[at[good]]
            ended = self.piece[node] >= 0
            out[w[ended], start[ended], k] = self.piece[node[ended]]
        return size, out

    def forward(self, size: np.ndarray, piece: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """sums[w, j, language] over the segmentations of the first j letters, times SCALE**j; prob: (pieces + 2, languages), last row 0."""
        n, wide, longest = piece.shape
        sums = np.zeros((n, wide + 1, prob.shape[1]))
        sums[:, 0] = 1
        for j in range(1, wide + 1):
            for k in range(min(longest, j)):
                sums[:, j] += sums[:, j - k - 1] * prob[piece[:, j - k - 1, k]] * SCALE ** (k + 1)
        return sums

    def backward(self, size: np.ndarray, piece: np.ndarray, prob: np.ndarray) -> np.ndarray:
        n, wide, longest = piece.shape
        sums = np.zeros((n, wide + 1, prob.shape[1]))
        sums[np.arange(n), size] = 1
        for j in range(wide - 1, -1, -1):
            for k in range(min(longest, wide - j)):
                sums[:, j] += sums[:, j + k + 1] * prob[piece[:, j, k]] * SCALE ** (k + 1)
        return sums

    def scores(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each language."""
        out = np.zeros((len(words), prob.shape[1]))
        for at in self.alike(words):
            size, piece = self.of([words[i] for i in at])
            total = self.forward(size, piece, prob)[np.arange(len(at)), size]
            out[at] = np.log(np.maximum(total, 1e-300)) - size[:, None] * np.log(SCALE)
        return out

    def expected(self, words: list[str], times: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (and the unknown one) by language; times: (words, languages)."""
        out = np.zeros((self.unknown + 1, prob.shape[1]))
        for at in self.alike(words):
            size, piece = self.of([words[i] for i in at])
            ahead, behind = self.forward(size, piece, prob), self.backward(size, piece, prob)
            share = times[at] / np.maximum(ahead[np.arange(len(at)), size], 1e-300)
            for k in range(piece.shape[2]):
                w, start = np.nonzero(piece[:, :, k] >= 0)
                p = piece[w, start, k]
                np.add.at(out, p, ahead[w, start] * prob[p] * SCALE ** (k + 1) * behind[w, start + k + 1] * share[w])
        return out

    def alike(self, words: list[str], most: int = 4096) -> Iterator[np.ndarray]:
        """Indices of words in groups of like length."""
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for i in range(0, len(order), most):
            yield order[i : i + most]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, prob) from documents that have an id, text and lang and are not held out.

    prob: (pieces + 2, languages): pieces, the unknown letter, and a row of zeros.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = own.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    # languages are few (the model has a column for each): what is kept of one follows from its count
    held = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not held:
        return [], np.zeros((len(pieces) + 2, 0))
    least = F.create_map(*[F.lit(x) for k, n in held.items() for x in (k, int(min(1.0, SAMPLE / n) * (1 << 32)))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.element_at(least, F.col("lang")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[str, Counter] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    words = written(sample.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = sorted(held)
    lattice, place = Lattice(pieces), {x: i for i, x in enumerate(languages)}
    prob = np.full((len(pieces) + 2, len(languages)), 1 / (len(pieces) + 1))
    prob[-1] = 0
    words = words.repartition(shuffle_width(spark), "word")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((lattice, prob))  # bounded by the vocabulary and the languages

        def uses(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, prob = shared.value
            out = np.zeros((lattice.unknown + 1, prob.shape[1]))
            for b in batches:
                names, index = np.unique(b.column("word").to_numpy(zero_copy_only=False), return_inverse=True)
                if len(names):
                    times = np.zeros((len(names), prob.shape[1]))
                    np.add.at(times, (index, [place[x] for x in b.column("lang").to_pylist()]), b.column("n").to_numpy())
                    out += lattice.expected(names.tolist(), times, prob)
            p, lang = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(lang), pa.array(out[p, lang])], ["piece", "lang", "uses"])

        found = words.mapInArrow(uses, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        count = np.full((len(pieces) + 1, len(languages)), SMOOTHING)
        count[found["piece"], found["lang"]] += found["uses"].to_numpy()
        prob = np.vstack([count / count.sum(axis=0), np.zeros(len(languages))])
    return languages, prob


class Identifier:
    def __init__(self, lattice: Lattice, languages: list[str], prob: np.ndarray):
        self.lattice, self.languages, self.prob = lattice, languages, prob
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(languages)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words_of(t) for t in texts]
        new = {w for words in found for w in words if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = {w for words in found for w in words}
        first, new = len(self.known), sorted(new)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        if len(self.known) > len(self.rows):
            self.rows = np.concatenate((self.rows[:first], np.zeros((2 * len(self.known) - first, len(self.languages)))))
        if new:
            self.rows[first : len(self.known)] = self.lattice.scores(new, self.prob)
        out = []
        for words in found:
            if not words or not self.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def identified(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's share of the total probability): a row for each row of docs.

    und and score 0 for null texts, texts without a letter, and where no language could be learned. Ties go to the
    first language in alphabetical order. Whole texts are scored. Equal rows share one result and stand in the sample
    together. An empty table gives an empty one; columns but doc_id, text and lang, whatever their names, play no part.
    """
    pieces = pieces_of(vocabulary)
    languages, prob = learn(docs, pieces)
    shared = docs.sparkSession.sparkContext.broadcast((Lattice(pieces), languages, prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(*shared.value)
        for b in batches:
            for first, texts in chunks(b.column("text"), CHUNK):
                names, scores = zip(*own(texts), strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(texts)), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return keyed(docs).mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""Quality rules with a linear-chain conditional random field over lines.

Each line is labelled content or boilerplate by Viterbi decoding; a document stays if enough of its words stand in
content lines and no plain rule rejects it. The field is fitted by penalised likelihood around fixed prior weights, on
a bounded sample of labelled documents (SAMPLE) whose lines carry their document's label; without labels the prior
weights hold. Prediction sees the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, small_batches

#: Labelled documents that the field is fitted on at most, chosen by a hash of their id.
SAMPLE = 1000
#: Lines that one of them adds to the fit at most: a stretch whose place follows from a hash of the text.
SAMPLE_LINES = 400
#: A document stays if this share of its words stands in content lines.
CONTENT_SHARE = 0.5
#: Fixed values of the rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "#*$%&|<>"
BLANK = b" \t\n\r\x0b\x0c"
OTHER_BLANKS = re.compile(r"[\t\r\x0b\x0c]")

#: Features of a line, each 0 or 1, and their prior weights for content (its negative: for boilerplate).
FEATURES = {
    "always": 1.0,
    "symbol for every third word": -2.0,
    "symbol for every word": -2.0,
    "most words upper case": -2.0,
    "most words end in ! or ?": -2.0,
    "over a third digits": -1.0,
    "same as an earlier line": -1.0,
    "under 3 words": -0.25,
    "ends in . ! ? or a closing quote": 0.5,
    "12 words or more": 0.5,
    "mean word over 14 or under 2 characters": -1.0,
}
#: Prior weight of a change of label between neighbouring lines (its negative: of none).
CHANGE = -0.75
#: Weight of the prior against a line's log-likelihood.
PENALTY = 20.0


def words_of(text: str | None) -> list[bytes]:
    """Between ASCII white space: [^\\x20\\x09-\\x0D]+."""
    return (text or "").encode().split()


def repeat_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that are found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed + ids[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    if len(np.unique(mixed)) == n:  # different hashes, so different windows
        return 0
    windows = list(zip(*(ids[k : k + n].tolist() for k in range(WINDOW)), strict=True))
    count = Counter(windows)
    found = np.array([count[w] > 1 for w in windows])
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= found
    return int(covered.sum())


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(features of each line that has a word, its words, lines equal to an earlier one)."""
    seen: set[str] = set()
    rows, sizes, again = [], [], 0
    plain = not OTHER_BLANKS.search(text or "")
    for line in (text or "").split("\n"):
        words = [w for w in (line if plain else OTHER_BLANKS.sub(" ", line)).split(" ") if w]
        if not words:
            continue
        n, old = len(words), line in seen
        seen.add(line)
        again += old
        symbols = sum(map(line.count, SYMBOLS))
        loud = sum(w[-1] in "!?" for w in words)
        upper = sum(map(str.isupper, words))
        digits = sum(map(str.isdigit, line)) if any(d in line for d in "0123456789") else 0
        mean = sum(map(len, words)) / n
        rows.append((True, 3 * symbols >= n, symbols >= n, 2 * upper > n and n > 1, 2 * loud > n and n > 1, 3 * digits > mean * n, old, n < 3, words[-1][-1] in ".!?\"'»”", n >= 12, mean > 14 or mean < 2))
        sizes.append(n)
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, np.int64), again


def prior() -> np.ndarray:
    return np.array([*FEATURES.values(), CHANGE])


def viterbi(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """1 for content, 0 for boilerplate, of each line; ties go to content."""
    content, change = features @ weights[:-1], weights[-1]
    best, back = [-content[0], content[0]], []
    for s in content[1:].tolist():
        b, c = best
        from_b = 1 if c + change >= b - change else 0
        from_c = 1 if c - change >= b + change else 0
        back.append((from_b, from_c))
        best = [(c + change if from_b else b - change) - s, (c - change if from_c else b + change) + s]
    out = [1 if best[1] >= best[0] else 0]
    for step in reversed(back):
        out.append(step[out[-1]])
    return np.array(out[::-1])


def fit(documents: list[tuple[np.ndarray, int]], steps: int = 60) -> np.ndarray:
    """Weights at the posterior mode, by gradient ascent; documents: (line features, label of all lines)."""
    weights = prior()
    documents = [(f, y) for f, y in documents if len(f)]
    if len({y for _, y in documents}) < 2:
        return weights
    total = sum(len(f) for f, _ in documents)
    speed = np.zeros_like(weights)
    for _ in range(steps):
        gradient = -PENALTY * (weights - prior())
        for f, y in documents:
            s, change = f @ weights[:-1], weights[-1]
            pair = np.array([[-change, change], [change, -change]])
            node = np.stack([-s, s], axis=1)
            ahead, behind = [node[0]], [np.zeros(2)]
            for x in node[1:]:
                ahead.append(np.logaddexp(ahead[-1][0] + pair[0], ahead[-1][1] + pair[1]) + x)
            for x in node[:0:-1]:
                behind.append(np.logaddexp(pair[:, 0] + x[0] + behind[-1][0], pair[:, 1] + x[1] + behind[-1][1]))
            ahead, behind = np.array(ahead), np.array(behind[::-1])
            z = np.logaddexp(*ahead[-1])
            content = np.exp(ahead[:, 1] + behind[:, 1] - z)
            gradient[:-1] += f.T @ ((2 * y - 1) - (2 * content - 1))
            if len(f) > 1:
                joint = np.exp(ahead[:-1, :, None] + pair + (node[1:] + behind[1:])[:, None, :] - z)
                gradient[-1] += -(len(f) - 1) - (joint[:, 0, 1] + joint[:, 1, 0] - joint[:, 0, 0] - joint[:, 1, 1]).sum()
        speed = 0.8 * speed + gradient / total
        weights = weights + 0.5 * speed
    return weights


def _stretch(lines: np.ndarray, h: int) -> np.ndarray:
    first = h % max(1, len(lines) - SAMPLE_LINES + 1)
    return lines[first : first + SAMPLE_LINES]


def fitted(docs: DataFrame, labels: DataFrame | None) -> np.ndarray:
    """Weights from a bounded sample of labelled documents of docs; quality 1: content, 0: boilerplate.

    Bounds of the fit alone: SAMPLE labelled documents that are in docs, by a hash of the id; SAMPLE_LINES lines of each;
    2 * SAMPLE rows in all where ids repeat, by hash too. Labels without a document play no part; without labels the prior stands.
    """
    if labels is None:
        return prior()
    own = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = keyed(docs).join(F.broadcast(own), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "text", "quality")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [_stretch(lines_of(t)[0], h).astype(np.uint8).tobytes() for t, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("quality"), pa.array(cut, pa.binary())], ["doc_id", "h", "quality", "lines"])

    found = rows.mapInArrow(featured, "doc_id long, h long, quality int, lines binary").orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h").limit(2 * SAMPLE).collect()
    return fit([(np.frombuffer(r.lines, np.uint8).reshape(-1, len(FEATURES)).astype(float), int(r.quality > 0)) for r in found])


def verdict(text: str | None, weights: np.ndarray) -> tuple[int, int, int, int, int, bool, bool, float]:
    words = words_of(text)
    n, text = len(words), text or ""
    symbols = sum(map(text.count, SYMBOLS))
    features, sizes, again = lines_of(text)
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    share = float(sizes[viterbi(features, weights) == 1].sum() / sizes.sum()) if len(sizes) else 0.0
    return n, len(text) - sum(map(text.count, BLANK.decode())), symbols, again, repeated, failed, not failed and share >= CONTENT_SHARE, share


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]


def quality(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, the rules' counts, base_failed, kept and content_share: one row for each row of docs.

    Null and empty texts have no words and fail; lines without a word carry no label. Long texts are read whole. Equal
    rows share one verdict, null ids stay null, an empty table gives none, and other columns play no part.
    """
    weights = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [verdict(t.as_py(), weights) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()], strict=True)]], ["doc_id", *NAMES])

    return keyed(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def kept(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever their names.

    Null and empty texts go, as they have too few words; equal rows share one verdict, long texts are read whole, and an
    empty table stays empty.
    """
    small_batches(docs.sparkSession)
    weights = fitted(docs, labels)

    @F.pandas_udf("boolean")
    def stays(texts):
        return texts.map(lambda t: verdict(t, weights)[6])

    return docs.where(stays(F.col("text").cast("string")))

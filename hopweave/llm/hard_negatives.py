"""Hard negatives by bit-sliced integer products.

Vectors become integers and are stored as blocks of bit planes. An anchor's product with a row is worked out a plane at
a time, the most significant first: what the planes behind can still add bounds the score from both sides, and a row is
dropped once its interval cannot hold a score that qualifies. Anchors and blocks meet in the cells of a grid, so no task
holds more than a group of anchors and a bounded number of rows. One pass finds positives, the next negatives below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_width, written

SCALE = 256
#: Rows of a block, and components of a block (long vectors stand in blocks of fewer rows).
BLOCK, PARTS = 2048, 1 << 18
#: Rows and anchors of a cell of the grid.
ROWS, ANCHORS = 1 << 15, 512
#: Share of pairs below which those left are gone on with one by one.
FEW = 1 / 16
#: Pairs gone on with at once.
PAIRS = 1 << 15


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(SCALE * x) as doubles) of the vectors of each length."""
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    start = np.concatenate(([0], np.cumsum(size)))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]


class Block:
    """Rows of one length as bit planes of their components less the least of them (or 0)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, dim: int, low: int, planes: list[bytes]):
        self.ids, self.labels, self.dim, self.low, self.bits = ids, labels, dim, low, len(planes)
        self.planes = planes  # the least significant first

    @staticmethod
    def sliced(x: np.ndarray) -> tuple[int, list[bytes]]:
        if np.abs(x).max(initial=0) >= 1 << 52:
            raise ValueError("components are too large for exact scores")
        low = int(min(0, x.min(initial=0)))
        rest = x.astype(np.int64) - low
        return low, [np.packbits((rest >> b & 1).astype(bool)).tobytes() for b in range(int(rest.max(initial=0)).bit_length())]

    def plane(self, b: int, dim: int, dtype: type) -> np.ndarray:
        n = len(self.ids)
        return np.unpackbits(np.frombuffer(self.planes[b], np.uint8), count=n * self.dim).reshape(n, self.dim)[:, :dim].astype(dtype)

    def fresh(self) -> np.ndarray:
        """Of rows that share an id, one."""
        out = np.zeros(len(self.ids), bool)
        out[np.unique(self.ids, return_index=True)[1]] = True
        return out


def bounded(a: np.ndarray, block: Block, alive: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of `alive` whose score can be from floor to ceiling, by anchor.

    k: only an anchor's best k ids are asked for, so that floor rises to the k-th lower bound.
    """
    dim = min(a.shape[1], block.dim)  # a component that one of the two lacks counts as 0
    a = a[:, :dim]
    most = 4 * dim * np.abs(a).max(initial=0) * (1 << block.bits)  # no sum on the way is larger
    if most >= 1 << 53:
        raise ValueError("scores are too large for exact products")
    dtype = np.float32 if most < 1 << 24 else np.float64
    a, floor, ceiling = a.astype(dtype), floor.astype(dtype), ceiling.astype(dtype)
    above, below = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
    score = np.repeat((block.low * a.sum(axis=1))[:, None], len(block.ids), axis=1)
    fresh = block.fresh()
    pairs = None
    for b in reversed(range(block.bits)):
        plane, rest = block.plane(b, dim, dtype), dtype((1 << b) - 1)
        if pairs is None:
            score += (a @ plane.T) * dtype(1 << b)
            if 0 < k < len(block.ids):
                sure = np.where(alive & fresh, score + (rest * below)[:, None], -np.inf)
                floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k])
            alive &= (score + (rest * above)[:, None] >= floor[:, None]) & (score + (rest * below)[:, None] <= ceiling[:, None])
            if alive.mean() < FEW:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            i, j = pairs
            for at in range(0, len(i), PAIRS):
                part = slice(at, at + PAIRS)
                score[part] += np.einsum("ij,ij->i", a[i[part]], plane[j[part]]) * dtype(1 << b)
            stay = (score + rest * above[i] >= floor[i]) & (score + rest * below[i] <= ceiling[i])
            pairs, score = (i[stay], j[stay]), score[stay]
    if pairs is None:
        pairs = np.nonzero(alive)
        score = score[pairs]
    return *pairs, score.astype(np.int64)


def best(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each group's first k ids by score, then id; an id counts once, by its best score. Ordered."""
    order = np.lexsort((-score, ids, group))
    group, ids, score = group[order], ids[order], score[order]
    one = np.ones(len(ids), bool)
    one[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
    group, ids, score = group[one], ids[one], score[one]
    order = np.lexsort((ids, -score, group))
    group, ids, score = group[order], ids[order], score[order]
    first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    place = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    keep = place < k
    return group[keep], ids[keep], score[keep]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for rows, x in integers(batch.column("embedding")):
            step = max(1, min(BLOCK, PARTS // max(1, x.shape[1])))
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                low, planes = Block.sliced(x[at : at + step])
                values = [own[0:1] * 0 + len(own), [ids[own].astype("<i8").tobytes()], [labels[own].astype("<i8").tobytes()], [x.shape[1]], [low], [planes]]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["n", "ids", "labels", "dim", "low", "planes"])


def _read(rows: pa.Table) -> Iterator[Block]:
    for r in rows.to_pylist():
        yield Block(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), r["dim"], r["low"], r["planes"])


def _anchors(rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, labels, integers) of the anchors of each length."""
    rows = rows.combine_chunks()
    if rows.num_rows:
        for at, x in integers(rows.column("embedding").chunk(0)):
            own = rows.take(pa.array(at))
            yield own, own.column("vec_id").to_numpy(), own.column("label").to_numpy(), x


FOUND = "anchor_id long, vec_id long, score long"
MINED = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _positives(anchors: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    out = [(np.zeros(0, np.int64),) * 3]
    for _, ids, labels, a in _anchors(anchors):
        held, floor = out[0], np.full(len(ids), -np.inf)
        for block in _read(blocks):
            alive = (labels[:, None] == block.labels) & (ids[:, None] != block.ids)
            i, j, score = bounded(a, block, alive, floor, np.full(len(ids), np.inf), k)
            held = best(*map(np.concatenate, zip(held, (i, block.ids[j], score), strict=True)), k)
            count = np.bincount(held[0], minlength=len(ids))
            full = np.flatnonzero(count == k)
            floor[full] = held[2][np.cumsum(count)[full] - 1]
        out.append((ids[held[0]], *held[1:]))
    return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["anchor_id", "vec_id", "score"])


def _negatives(anchors: pa.Table, blocks: pa.Table, k: int, share: tuple[int, int]) -> pa.Table:
    none = (np.zeros(0, np.int64),) * 3
    out = [(none[0],) * 5]
    for rows, ids, labels, a in _anchors(anchors):
        positives = [sorted((p["score"], p["vec_id"]) for p in own) for own in rows.column("positives").to_pylist()]
        width = max(map(len, positives))
        # a positive's window; places that an anchor does not fill hold nothing
        high, low, names = np.full((len(ids), width), -np.inf), np.full((len(ids), width), np.inf), np.zeros((len(ids), width), np.int64)
        for i, own in enumerate(positives):
            for p, (score, name) in enumerate(own):
                high[i, p], low[i, p], names[i, p] = score, -(-share[0] * score // share[1]), name
        held, least = none, low.copy()
        for block in _read(blocks):
            alive = (labels[:, None] != block.labels) & (ids[:, None] != block.ids)
            i, j, score = bounded(a, block, alive, least.min(axis=1), high.max(axis=1))
            fits = [np.flatnonzero((score >= least[i, p]) & (score <= high[i, p])) for p in range(width)]
            new = [np.concatenate([f(p, at) for p, at in enumerate(fits)]) for f in (lambda p, at: i[at] * width + p, lambda p, at: block.ids[j[at]], lambda p, at: score[at])]
            held = best(*map(np.concatenate, zip(held, new, strict=True)), k)
            count = np.bincount(held[0], minlength=len(ids) * width)
            full = np.flatnonzero(count == k)
            least.reshape(-1)[full] = held[2][np.cumsum(count)[full] - 1]
        i, p = held[0] // width, held[0] % width
        out.append((ids[i], names[i, p], high[i, p].astype(np.int64), *held[1:]))
    return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])


def _met(anchors: DataFrame, blocks: DataFrame, groups: int, cells: int, f, schema: str) -> DataFrame:
    """f(anchors, blocks) over every cell of the grid: `groups` groups of anchors by `cells` groups of blocks."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.lit(groups).cast("long"))).withColumn("g", every(cells))
    right = blocks.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(cells).cast("long"))).withColumn("a", every(groups))
    return left.groupBy("a", "g").cogroup(right.groupBy("a", "g")).applyInArrow(lambda x, y: f(x, y), schema)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group by score, then id; an id counts once, by its best score."""
    one = found.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def mined(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors, told by vec_id. An anchor's positives are its first rows of its label by inner
    product of floor(256 * x), then vec_id; each has its first rows of other labels whose score is at most the
    positive's and at least share[0] / share[1] of it. Rows without vec_id, label or vector, or with a null or
    non-finite component, take no part; empty vectors score 0, and a component that one of two vectors lacks counts as
    0. An id that repeats is one anchor (by its smallest label, then vector), counts once among positives and once
    among a positive's negatives, by its best score, and never meets itself. Equal scores go to the smaller vec_id.
    Components so large that a score is inexact in a double raise an error. An empty table gives an empty one; other
    columns, whatever their names, play no part.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    kinds = "n long, ids binary, labels binary, dim long, low long, planes array<binary>"
    blocks = written(own.mapInArrow(_blocks, kinds), "hard-negative-blocks")
    one = own.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")
    one = written(one, "hard-negative-anchors")
    rows, groups = blocks.agg(F.sum("n")).first()[0] or 0, -(-one.count() // ANCHORS) or 1
    cells = max(1, -(-rows // ROWS), -(-shuffle_width(vectors.sparkSession) // groups))
    found = _ranked(_met(one, blocks, groups, cells, partial(_positives, k=positives), FOUND), ["anchor_id"], positives)
    first = written(found, "hard-negative-positives")
    windows = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("score", F.col("vec_id").alias("vec_id"))).alias("positives"))  # a few each
    found = _met(one.join(windows, "vec_id"), blocks, groups, cells, partial(_negatives, k=negatives, share=share), MINED)
    ranked = _ranked(found, ["anchor_id", "positive_id", "positive_score"], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted(vectors: DataFrame) -> DataFrame:
    """Label (label + 1) % 10 where 7 divides vec_id."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", label.alias("label"))


def oracle_sql() -> str:
    return f"""
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 5
"""

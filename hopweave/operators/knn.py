"""Exact nearest neighbours of a stated query set against all rows, in blocks.

Queries and rows meet in bounded blocks (see grid): a task compares a block of each by matrix products and keeps the k
nearest it has, so that what is shuffled is k rows a query and block. A product only shortlists: distances
of the shortlist are computed again directly, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics
from ..plans.iterate import checkpointed
from .grid import PAIRS, matrix, met, met_by_key, nearest_of

SCHEMA = "q_id long, b_id long, dist double"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Approximate distances of all pairs, by products where they allow it.
_ALL: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "squared_l2": lambda q, b: (q * q).sum(1)[:, None] - 2 * (q @ b.T) + (b * b).sum(1),
    "ip": lambda q, b: -(q @ b.T),
    "cosine": lambda q, b: -(_unit(q) @ _unit(b).T),
    "angular": lambda q, b: 1 - _unit(q) @ _unit(b).T,
    "l1": lambda q, b: np.stack([np.abs(x - b).sum(1) for x in q]) if len(q) else np.zeros((0, len(b))),
    "hamming": lambda q, b: ((q > 0).astype(float) @ (b <= 0).T + (q <= 0).astype(float) @ (b > 0).T) / q.shape[1],
}
#: The distance of paired rows.
_PAIRED: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "squared_l2": lambda q, b: ((q - b) ** 2).sum(1),
    "ip": lambda q, b: -(q * b).sum(1),
    "cosine": lambda q, b: -(q * b).sum(1) / np.sqrt((q * q).sum(1) * (b * b).sum(1)),
    "angular": lambda q, b: 1 - (q * b).sum(1) / np.sqrt((q * q).sum(1) * (b * b).sum(1)),
    "l1": lambda q, b: np.abs(q - b).sum(1),
    "hamming": lambda q, b: ((q > 0) != (b > 0)).mean(1),
}


def _pairs(keep: Callable) -> Callable:
    """grid's form of keep(query ids, queries, base ids, base) -> (query row, base row, distance) of the pairs that stay."""

    def each(ids: np.ndarray, q: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        own = b.column("vec_id").to_numpy()
        i, j, dist = keep(ids, q, own, matrix(b.column("embedding")))
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), pa.array(dist)], ["q_id", "b_id", "dist"])

    return each


#: Queries and rows whose products are worked out at once; a query's first rows are few, as their nearest are selected.
TILE, DEPTH, FIRST = 256, 4096, 512
#: The most neighbours that a task keeps as a table of its queries.
TABLED = 128


def _nearest(k: int, exclude_self: bool) -> Callable[[np.ndarray, np.ndarray, Iterator[pa.RecordBatch]], pa.Table]:
    """grid's `whole` of the k nearest by squared_l2: products of floats are compared with the k-th distance so far, with
    room for their error, and what passes is measured directly. Rows that are not finite have no distance."""

    def whole(ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> pa.Table:
        n, left = len(ids), {}
        dist, best = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        with np.errstate(over="ignore", invalid="ignore"):
            qq = (q * q).sum(axis=1)
            size = FIRST
            for b in batches:
                own, x = b.column("vec_id").to_numpy(), matrix(b.column("embedding"))
                good = np.isfinite(x).all(axis=1)
                own, x, at = own[good], x[good], 0
                while at < len(x):
                    _meet(ids, q, qq, left, own[at : at + size], x[at : at + size], k, exclude_self, dist, best)
                    at, size = at + size, min(DEPTH, 2 * size)
        i, j = np.nonzero(np.isfinite(dist))
        return pa.table({"q_id": ids[i], "b_id": best[i, j], "dist": dist[i, j]})

    return whole


def _meet(ids: np.ndarray, q: np.ndarray, qq: np.ndarray, left: dict, own: np.ndarray, x: np.ndarray, k: int, exclude_self: bool, dist: np.ndarray, best: np.ndarray) -> None:
    """Some rows meet all queries; dist and best, the k nearest so far, are brought up to date. left keeps the queries' side and the tiles' memory."""
    xx = (x * x).sum(axis=1)
    top, m = float(max(np.nanmax(qq, initial=0), xx.max())), len(x)
    kind = np.float32 if 1e-20 < top < 1e30 else np.float64
    if kind not in left:
        left[kind] = np.concatenate((-2 * q, np.ones((len(q), 1))), axis=1).astype(kind)
    right = np.ascontiguousarray(np.concatenate((x, xx[:, None]), axis=1).astype(kind).T)
    slack = (x.shape[1] + 8) * float(np.finfo(kind).eps) * (qq + 2 * float(xx.max()))
    if exclude_self:
        by = np.argsort(own, kind="stable")
        low = np.searchsorted(own[by], ids)
        count = np.searchsorted(own[by], ids, "right") - low
    if (kind, m) not in left:  # written over by each tile: fresh memory for each would cost more than the products
        left[kind, m] = np.empty((TILE, m), kind), np.empty((TILE, m), bool)
    for t in range(0, len(q), TILE):
        tile = slice(t, t + TILE)
        part = left[kind][tile]
        s = np.matmul(part, right, out=left[kind, m][0][: len(part)])  # distances less the query's own square
        if exclude_self and (c := count[tile]).any():
            i = np.repeat(np.arange(len(c)), c)
            s[i, by[np.repeat(low[tile] - np.cumsum(c) + c, c) + np.arange(len(i))]] = np.inf
        bar = dist[tile, -1] - qq[tile] + slack[tile]
        if m > k and np.isinf(dist[tile, -1]).any():
            bar = np.fmin(bar, np.partition(s, k - 1, axis=1)[:, k - 1] + 2 * slack[tile])
        near = np.flatnonzero(np.less_equal(s, bar.astype(kind)[:, None], out=left[kind, m][1][: len(part)]))
        i, j = near // m, near % m
        if exclude_self:
            i, j = (y[ids[t + i] != own[j]] for y in (i, j))
        d = np.concatenate([_PAIRED["squared_l2"](q[t + i[a : a + 8192]], x[j[a : a + 8192]]) for a in range(0, len(i), 8192)] or [np.zeros(0)])
        in_ = (d <= dist[t + i, -1]) & np.isfinite(d)
        i, j, d = t + i[in_], j[in_], d[in_]
        rows = np.unique(i)
        who, b, d = np.concatenate((np.repeat(rows, k), i)), np.concatenate((best[rows].ravel(), own[j])), np.concatenate((dist[rows].ravel(), d))
        order = np.lexsort((b, d, who))
        who, b, d = who[order], b[order], d[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        keep = nth < k
        dist[who[keep], nth[keep]], best[who[keep], nth[keep]] = d[keep], b[keep]


def _compared(base: DataFrame, queries: DataFrame, keep: Callable, closing: Callable | None = None) -> DataFrame:
    """The pairs that keep() lets stay, in blocks (see grid)."""
    return met(base.select("vec_id", "embedding"), queries, _pairs(keep), SCHEMA, closing)


def ranked(pairs: DataFrame, k: int, by: str = "q_id") -> DataFrame:
    """The k rows of each query of least (dist, b_id), with rank from 1."""
    order = Window.partitionBy(by).orderBy("dist", "b_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(base: DataFrame, queries: DataFrame, k: int, metric: str = "squared_l2", exclude_self: bool = False) -> DataFrame:
    """q_id, b_id, dist, rank: the k nearest rows of base for each query; both sides are (vec_id, embedding).

    Null embeddings take no part. Fewer than k rows give fewer neighbours. exclude_self drops pairs of equal ids.
    """
    if metric == "squared_l2" and 0 < k <= TABLED:
        return ranked(met(base.select("vec_id", "embedding"), queries, None, SCHEMA, whole=_nearest(k, exclude_self)), k)
    return ranked(_compared(base, queries, shortlist(k, metric, exclude_self), partial(nearest_of, k=k)), k)


def exact_by_key(base: DataFrame, queries: DataFrame, key: str, k: int, metric: str = "squared_l2") -> DataFrame:
    """exact() among the rows of a query's keys: base (vec_id, embedding, key), queries a row for each of their keys."""
    rows, asked = (df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", key).where("embedding is not null") for df in (base, queries))
    return ranked(met_by_key(rows, asked, key, _pairs(shortlist(k, metric)), SCHEMA, partial(nearest_of, k=k)), k)


def shortlist(k: int, metric: str, exclude_self: bool = False) -> Callable:
    """keep() of the k nearest of a block, measured directly."""
    if metric not in _ALL:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(_ALL)}")
    near, paired = _ALL[metric], _PAIRED[metric]

    def keep(ids, q, own, x):
        d = near(q, x)
        if exclude_self:
            d[ids[:, None] == own[None, :]] = np.inf
        if d.shape[1] > k:
            bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero(d <= bound + 1e-9 * np.maximum(1, np.abs(bound)))
        else:
            i, j = np.nonzero(np.isfinite(d))
        good = np.isfinite(d[i, j])
        i, j = i[good], j[good]
        return i, j, paired(q[i], x[j])

    return keep


def within(base: DataFrame, queries: DataFrame, below: float, metric: str = "squared_l2", exclude_self: bool = False) -> DataFrame:
    """q_id, b_id, dist of all pairs with dist < below."""
    near, paired = _ALL[metric], _PAIRED[metric]

    def keep(ids, q, own, x):
        i, j = np.nonzero(near(q, x) < below + 1e-9 * max(1, abs(below)))
        if exclude_self:
            apart = ids[i] != own[j]
            i, j = i[apart], j[apart]
        d = paired(q[i], x[j])
        inside = d < below
        return i[inside], j[inside], d[inside]

    return _compared(base, queries, keep)


def filtered(base: DataFrame, queries: DataFrame, tag: str, k: int, metric: str = "squared_l2") -> DataFrame:
    """The k nearest among rows with the query's tag; a tag's rows and queries meet in bounded blocks, however many they are."""
    return exact_by_key(base, queries, tag, k, metric)


def set_pairs(base: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, items) both sides -> q_id, b_id, dist (Jaccard) of pairs that share an item, through the items.

    Only sizes and items travel; pairs without a common item are no neighbours and never made.
    """
    sized = lambda df, i, n: df.select(F.col("id").alias(i), F.size(F.array_distinct("items")).alias(n), F.explode(F.array_distinct("items")).alias("item"))
    met = sized(base, "b_id", "bn").join(sized(queries, "q_id", "qn"), "item").groupBy("q_id", "b_id", "qn", "bn").agg(F.count("*").alias("both"))
    pairs = met.select("q_id", "b_id", (1 - F.col("both") / (F.col("qn") + F.col("bn") - F.col("both"))).alias("dist"))
    return pairs.where(metrics.valid("jaccard", F.col("dist")))


def jaccard(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return ranked(set_pairs(base, queries), k)


def _lists(rows: DataFrame) -> DataFrame:
    """id, terms, weights of (id, term, weight) rows, or of rows that are such lists already."""
    if "terms" in rows.columns:
        return rows.select(F.col("id").cast("long").alias("id"), "terms", F.col("weights").cast("array<double>").alias("weights"))
    return rows.groupBy(F.col("id").cast("long").alias("id")).agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("weight").cast("double")).alias("weights"))  # a row's own terms


#: Bytes of the postings of queries that are broadcast at once, about.
POSTING_BYTES = 64 << 20
#: A term of one in so many queries is multiplied as a column, at most so many of them; others meet posting by posting.
COMMON, COLUMNS = 24, 1024


def _posting_blocks(queries: DataFrame) -> Iterator[_Postings]:
    """The queries' postings, a bounded block of queries at a time."""
    own = checkpointed(_lists(queries))
    blocks = -(-(own.agg(F.sum(F.size("terms"))).first()[0] or 0) * 16 // POSTING_BYTES)
    for i in range(blocks):
        block = own if blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        held = block.orderBy("id").toArrow().combine_chunks()
        if held.num_rows:
            yield _Postings.of(held)


@dataclass
class _Postings:
    """A block of queries: their ids and lengths, terms, ends of each term's postings, these by query and weight, and the
    columns of common terms, with the column of each term (or -1). least: the least weight, a query's length being 1."""

    ids: np.ndarray
    norm: np.ndarray
    terms: pa.Array
    ends: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    columns: np.ndarray
    column: np.ndarray
    least: float

    @classmethod
    def of(cls, held: pa.Table) -> _Postings:
        n, lists = held.num_rows, held.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        term, weight = coded.indices.to_numpy().astype(np.int64), held.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        query = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
        by = np.argsort(term, kind="stable")
        term, query, weight = term[by], query[by], weight[by]
        ends = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
        often = np.argsort(-np.diff(ends), kind="stable")[:COLUMNS]
        often = often[np.diff(ends)[often] * COMMON >= n]
        column = np.full(len(coded.dictionary), -1)
        column[often] = np.arange(len(often))
        at = column[term]
        columns = np.bincount(query[at >= 0] * len(often) + at[at >= 0], weight[at >= 0], minlength=n * len(often)).reshape(n, -1) if len(often) else np.zeros((n, 0))
        norm = np.sqrt(np.bincount(query, weight * weight, minlength=n))
        norm[norm == 0] = 1
        return cls(held.column("id").to_numpy(), norm, coded.dictionary, ends, query.astype(np.int32), weight, columns, column, float((weight / norm[query]).min(initial=np.inf)))

    def nearest(self, batches: Iterator[pa.RecordBatch], k: int, places: int) -> tuple[np.ndarray, np.ndarray]:
        """(negative rounded products, ids) of each query's k best rows of the batches; infinite where there are fewer."""
        n = len(self.ids)
        dist, best = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        single = (self.columns / self.norm[:, None]).astype(np.float32)
        deep = min(1024, max(64, PAIRS // max(n, 1)))
        for b in batches:
            lists = b.column("terms")
            met = pc.index_in(lists.flatten(), value_set=self.terms.cast(lists.type.value_type))
            hit = np.flatnonzero(np.asarray(met.is_valid()))
            own = np.repeat(np.arange(len(b)), pc.list_value_length(lists).to_numpy())[hit]
            t, w = met.drop_null().to_numpy().astype(np.int64), b.column("weights").flatten().to_numpy(zero_copy_only=False)[hit]
            ids, cuts = b.column("id").to_numpy(), np.searchsorted(own, np.arange(0, len(b) + deep, deep))
            for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if lo < hi:
                    self._meet(single, t[lo:hi], own[lo:hi] - i * deep, w[lo:hi], ids[i * deep : (i + 1) * deep], k, places, dist, best)
        return dist, best

    def _meet(self, single: np.ndarray, t: np.ndarray, own: np.ndarray, w: np.ndarray, ids: np.ndarray, k: int, places: int, dist: np.ndarray, best: np.ndarray) -> None:
        """Some rows' terms (t, of row own, with weight w): products in floats only tell which may be among the k best,
        those are added up in doubles. The floats' error is at most `slack`, lengths being 1."""
        n, m, wide = len(self.ids), len(ids), self.columns.shape[1]
        long = np.sqrt(np.bincount(own, w * w).max()) or 1.0
        # a product that may be 0 or less does not tell whether a term is shared: all go posting by posting and are counted
        plain = min(self.least, w.min()) <= 0 or self.least * w.min() <= 1e-30 * long
        at = np.full(len(t), -1) if plain else self.column[t]
        d = np.bincount(own[at >= 0] * wide + at[at >= 0], w[at >= 0], minlength=m * wide).astype(float, copy=False).reshape(m, wide)
        scale, slack = 1 / (self.norm * long), (wide + 64) * 2.0**-23
        t, own, w = t[at < 0], own[at < 0], w[at < 0]
        size = self.ends[t + 1] - self.ends[t]
        place = np.repeat(self.ends[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = self.query[place] * np.int64(m) + np.repeat(own, size)
        rest = np.bincount(key, np.repeat(w, size) * self.weight[place], minlength=n * m).astype(float, copy=False).reshape(n, m)  # whole numbers, if there are none
        s = single @ (d / long).astype(np.float32).T
        s += rest * scale[:, None]
        if plain:
            s[np.bincount(key, minlength=n * m).reshape(n, m) == 0] = -np.inf
        step = 10.0**-places * scale
        least = np.maximum((-dist[:, -1] - 10.0**-places) * scale - slack, -1e30 if plain else 1e-35)
        some = np.flatnonzero(s.max(axis=1) >= least)
        s, least = s[some], least[some]
        if m > k:
            many = np.flatnonzero(np.count_nonzero(s >= least[:, None], axis=1) > k)
            kth = np.partition(s[many], m - k, axis=1)[:, m - k]
            least[many] = np.maximum(least[many], kth - 2 * slack - step[some[many]])
        i, j = np.nonzero(s >= least[:, None])
        i = some[i]
        total = rest[i, j]
        for a in range(0, len(i) if wide and not plain else 0, 2048):
            total[a : a + 2048] += np.einsum("ij,ij->i", self.columns[i[a : a + 2048]], d[j[a : a + 2048]])
        rows = np.unique(i)
        q, b, x = np.concatenate((np.repeat(rows, k), i)), np.concatenate((best[rows].ravel(), ids[j])), np.concatenate((dist[rows].ravel(), -np.round(total, places)))
        order = np.lexsort((b, x, q))
        q, b, x = q[order], b[order], x[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < k
        dist[q[keep], nth[keep]], best[q[keep], nth[keep]] = x[keep], b[keep]


def sparse_ip(base: DataFrame, queries: DataFrame, k: int, places: int = 12) -> DataFrame:
    """(id, term, weight) rows, or lists (id, terms, weights), both sides -> the k rows of greatest inner product that
    share a term; dist is its negative.

    queries are a stated set: their postings are broadcast in bounded blocks, each task adds up the products of its own
    rows and keeps k a query, so a frequent term makes no rows to shuffle. Common terms are multiplied as a matrix, in
    floats, which only shortlists. Sums are rounded before they are ranked, so that equal rows tie in whatever order
    their terms were added.
    """
    spark, parts = base.sparkSession, []
    rows = _lists(base)
    for block in _posting_blocks(queries):
        shared = spark.sparkContext.broadcast(block)  # bounded by POSTING_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            dist, best = shared.value.nearest(batches, k, places)
            q, j = np.nonzero(np.isfinite(dist))
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids[q]), pa.array(best[q, j]), pa.array(dist[q, j])], ["q_id", "b_id", "dist"])

        parts.append(rows.mapInArrow(run, SCHEMA))
    return ranked(reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], SCHEMA), k)


def graph(vectors: DataFrame, k: int, metric: str = "squared_l2") -> DataFrame:
    """Directed k-nearest-neighbour graph: src, pos (0 nearest), dst, dist."""
    found = exact(vectors, vectors, k, metric, exclude_self=True)
    return found.select(F.col("q_id").alias("src"), (F.col("rank") - 1).alias("pos"), F.col("b_id").alias("dst"), "dist")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall: hits among truth's first k over queries * k, even where fewer were returned."""
    true = truth.where(F.col("rank") <= k).select("q_id", "b_id").distinct()
    hits = found.select("q_id", "b_id").distinct().join(true, ["q_id", "b_id"], "left_semi")
    asked = truth.agg(F.count_distinct("q_id").alias("nq"))
    return hits.agg(F.count("*").alias("hits")).join(F.broadcast(asked)).select((F.col("hits") / (F.col("nq") * k)).alias("recall"))


def recall_each(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """q_id, recall without the query itself on either side."""
    true = truth.where("q_id <> b_id").select("q_id", "b_id", "rank")
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))).where(F.col("r") <= k)
    hit = found.where("q_id <> b_id").select("q_id", "b_id").distinct().withColumn("hit", F.lit(1))
    return true.join(hit, ["q_id", "b_id"], "left").groupBy("q_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("recall"))


def missing(found: DataFrame, truth: DataFrame) -> DataFrame:
    """truth rows (q_id, b_id, rank) that found lacks."""
    return truth.select("q_id", "b_id", "rank").join(found.select("q_id", "b_id"), ["q_id", "b_id"], "left_anti")


def nearest_present(lost: DataFrame, found: DataFrame, vectors: DataFrame, metric: str = "squared_l2", within: tuple[str, ...] = ()) -> DataFrame:
    """For each missing (q_id, b_id): the row of found nearest to it, ties to the smaller id: q_id, b_id, present, dist.

    within: columns in which both must agree too.
    """
    v = lambda i, x: vectors.select(F.col("vec_id").alias(i), F.col("embedding").alias(x))
    pairs = lost.select("q_id", "b_id", *within).join(found.select("q_id", *within, F.col("b_id").alias("present")), ["q_id", *within]).join(v("b_id", "_b"), "b_id").join(v("present", "_p"), "present")
    scored = pairs.select("q_id", "b_id", "present", metrics.metric(metric)(F.col("_b"), F.col("_p")).alias("dist"))
    best = scored.groupBy("q_id", "b_id").agg(F.min(F.struct("dist", "present")).alias("m"))
    return best.select("q_id", "b_id", "m.present", "m.dist")



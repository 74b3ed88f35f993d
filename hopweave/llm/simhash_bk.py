"""SimHash near-duplicates found with BK-trees.

Distinct fingerprints are dealt to shards by two of four 16-bit blocks: fingerprints at two or fewer differing bits
agree on at least two blocks, so each pair meets in a shard. In a shard every block pair's fingerprints form a BK-tree
(children keyed by their Hamming distance to the parent), and a search follows only the edges within the radius.
Shard trees grow with the corpus and so have no size bound; they are therefore not broadcast to all, but meet the
fingerprints that can be near them by that key. Results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, keyed, shuffle_width, written

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Keys with more distinct fingerprints than this are split by a third of their remaining bits.
HOT_KEY = 4096


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash: A-Z lower-cased, words between ASCII white space, `width`-word shingles with repeats.

    Null, empty or blank text: 0. Fewer words than `width`: the whole sequence is the only shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


class BKForest:
    """One BK-tree for each key, all built and searched level by level in numpy."""

    def __init__(self, keys: np.ndarray, points: np.ndarray):
        """keys: ints, rows sorted by them; points: uint64, distinct under a key."""
        n = len(points)
        self.points = points
        self.root = np.searchsorted(keys, keys)  # of each row: the first row of its key
        parents, edges, children = [], [], []
        at = np.flatnonzero(self.root != np.arange(n))
        over = self.root[at]
        while len(at):
            d = np.bitwise_count(points[at] ^ points[over]).astype(np.int64)
            slot = over * 65 + d
            order = np.argsort(slot, kind="stable")
            at, slot = at[order], slot[order]
            first = np.concatenate(([True], slot[1:] != slot[:-1]))
            parents.append(slot[first] // 65), edges.append(slot[first] % 65), children.append(at[first])
            over = at[first][np.cumsum(first) - 1][~first]
            at = at[~first]
        p, e, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, edges, children))
        order = np.argsort(p * 65 + e)
        self.slots, self.child = (p * 65 + e)[order], c[order]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, other row) at distance <= radius, under the same key."""
        q, node, found = queries, self.root[queries], []
        while len(q):
            d = np.bitwise_count(self.points[q] ^ self.points[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            found.append((q[hit], node[hit]))
            lo = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right")
            many = hi - lo
            q = np.repeat(q, many)
            node = self.child[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (queries[:0], queries[:0])


def roots_after(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find by arrays: parent (flat) after joining rows a[i] and b[i]; each root is its class's smallest row."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _shard_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "fp"], ignore_index=True)
    key = pd.factorize(pdf["key"])[0]
    forest = BKForest(key, pdf["fp"].to_numpy().view(np.uint64))
    parent = np.arange(len(pdf))
    for at in range(0, len(pdf), 512):  # the search's frontier stays small
        parent = roots_after(parent, *forest.near(np.arange(at, min(at + 512, len(pdf))), RADIUS))
    rep = pdf["rep"].to_numpy()
    linked = np.flatnonzero(parent != np.arange(len(pdf)))
    return pd.DataFrame({"a": rep[linked], "b": rep[parent[linked]]})


def links(points: DataFrame) -> DataFrame:
    """Distinct (fp, rep) -> (a, b): pairs of rep whose closure is that of all pairs at distance <= RADIUS."""
    spark = points.sparkSession
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = points.select("fp", "rep", F.posexplode(F.array(*[F.shiftleft(block(i), 16) + block(j) for i, j in pairs])).alias("t", "v"))
    shared = keys.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
    keys = keys.join(shared, ["t", "v"])
    # a hot key's free 32 bits in three parts of which two points within the radius share one; 21 free bits are left
    rest = [[k for k in range(4) if k not in p] for p in pairs]
    free = F.element_at(F.array(*[F.shiftleft(block(a), 16) + block(b) for a, b in rest]), F.col("t") + 1)
    part = F.array(free.bitwiseAND(F.lit(0x7FF)), F.shiftrightunsigned(free, 11).bitwiseAND(F.lit(0x7FF)), F.shiftrightunsigned(free, 22))
    none = F.array(F.lit(-1).cast("long"))
    keys = keys.select("fp", "rep", "t", "v", F.posexplode(F.when(F.col("n") > HOT_KEY, part).otherwise(none)).alias("s", "w"))
    shards = 8 * shuffle_width(spark)
    keys = keys.select("fp", "rep", F.xxhash64("t", "v", "s", "w").alias("key"))
    return keys.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(_shard_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest doc_id reachable over links.

    Every row of docs gives one row, repeated rows and ids too. Null text: fingerprint zero, linked like any other.
    A row with a null doc_id gets its fingerprint's component, or null if only such rows have it. Empty table: no rows.
    Long texts are fingerprinted whole; other columns, whatever their names, play no part.
    """
    prints = written(keyed(docs).mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    points = points.checkpoint()
    found = connected_components(links(points))
    named = points.join(found, points["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: one row of each component's smallest id stays, and all rows with a null id.

    Components are of fingerprints, and a row is known by its id and text: ids may repeat with other texts.
    """
    text = F.xxhash64(F.col("text").cast("string"))
    own = keyed(docs.where("doc_id is not null")).withColumn("_text", text)
    prints = written(own.mapInArrow(_fingerprints, "doc_id long, fp long, _text long"), "simhash")
    points = prints.select("fp").distinct().withColumn("rep", F.col("fp")).checkpoint()
    found = connected_components(links(points))
    named = points.join(found, points["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    first = prints.join(named, "fp").groupBy("component").agg(F.min(F.struct("doc_id", "fp", "_text")).alias("m")).select("m.doc_id", "m._text")
    kept = docs.where("doc_id is not null").select("doc_id", text.alias("_text"), F.struct(*docs.columns).alias("_row")).join(first, ["doc_id", "_text"], "left_semi")
    # of rows that repeat id and text, one; they lie together already
    order = Window.partitionBy("doc_id", "_text").orderBy("_text")
    kept = kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_row.*")
    return kept.union(docs.where("doc_id is null"))

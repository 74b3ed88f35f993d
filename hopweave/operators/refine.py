"""Trace-driven refinement of a graph: prune by edge statistics, insert by reachability, repair, tune and loop."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.iterate import checkpointed, placed
from . import knn, search
from .vectors import keyed_hash, seeds

if TYPE_CHECKING:
    from .cells import Cells


@dataclass(frozen=True)
class Settings:
    """Parameters of a refinement; defaults are those of the hierarchical family (fixed values)."""

    family: str = "hnsw"
    rounds: int = 14
    prune_ratio: float = 0.02
    core_k: int = 20
    jump_max: int = -1
    repeat_max: int = 1
    seed_share: float = 0.7
    train_ef: int = 2000
    ef_max: int = 1000
    target_recall: float = 0.99
    ef_cap: int = 2000
    coarse_step: int = 10
    fine_step: int = 2
    repair_target: float = 0.90
    repair_degree: int = 20
    level_scope: int = 2
    ks: tuple[int, ...] = (1, 10, 50, 100)

    @property
    def jumps(self) -> int:
        return self.jump_max if self.jump_max >= 0 else int(2 * math.sqrt(self.core_k))


#: Fixed values of the three families.
FAMILY = {
    "hnsw": Settings(),
    "nsg": Settings(family="nsg", rounds=20, seed_share=0.2, target_recall=0.90, coarse_step=400, fine_step=40),
    "hcnng": Settings(family="hcnng", rounds=20, seed_share=0.2, coarse_step=100, fine_step=20),
}


# prune


def _worst(*more: Column) -> list[Column]:
    """Worst edges first: a total order of candidates."""
    return [F.desc("ratio"), F.desc("total"), F.desc("discarded"), *more, F.asc("src"), F.asc("dst")]


def prune_candidates(stats: DataFrame) -> DataFrame:
    """Edges met and adopted, with ratio discarded / adopted and their rank on their level, worst first."""
    c = stats.where("adopted > 0").withColumn("ratio", F.col("discarded") / F.col("adopted")).withColumn("total", F.col("adopted") + F.col("discarded"))
    return placed(c, ["level"], _worst(), "rank")


def prune_selected(stats: DataFrame, prune_ratio: float = 0.02, per_node: int = 2) -> DataFrame:
    """level, src, pos, dst of the edges to delete (stats: edges with adopted and discarded).

    First the worst adopted edge of each source in rank order, until max(1, ceil(share of candidates)) a level; then
    edges that were only ever discarded, in list order; at most per_node of a source and level. Edges never met stay.
    """
    share = min(max(prune_ratio, 0.0), 1.0)
    c = prune_candidates(stats)
    target = c.groupBy("level").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share)).alias("target"))
    one = c.withColumn("own", F.row_number().over(Window.partitionBy("level", "src").orderBy("rank"))).where("own = 1")
    first = placed(one, ["level"], [F.asc("rank")], "turn").join(F.broadcast(target), "level").where("turn <= target")
    first = first.select("level", "src", "pos", "dst", F.lit(0).alias("phase"), F.col("rank").cast("long").alias("place"))
    zero = stats.where("adopted = 0 and discarded > 0").select("level", "src", "pos", "dst", F.lit(1).alias("phase"), F.col("pos").cast("long").alias("place"))
    order = Window.partitionBy("level", "src").orderBy("phase", "place", "dst")
    return first.union(zero).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_node).select("level", "src", "pos", "dst")


def prune_ratio_legacy(stats: DataFrame, prune_ratio: float = 0.02) -> DataFrame:
    """The older rule: floor(share) worst ratios overall, one cut a node in list order; and all only-discarded edges."""
    c = prune_candidates(stats)
    n = c.count()
    worst = placed(c, [], _worst(F.asc("level")), "r").where(F.col("r") <= int(n * prune_ratio))
    one = worst.withColumn("own", F.row_number().over(Window.partitionBy("level", "src").orderBy("pos"))).where("own = 1")
    return one.select("level", "src", "pos", "dst").union(stats.where("adopted = 0 and discarded > 0").select("level", "src", "pos", "dst")).distinct()


def sampled_edges(edges: DataFrame, share: float = 0.05) -> DataFrame:
    """A keyed sample of the edges."""
    key = keyed_hash(F.col("src") * 1000003 + F.col("dst"))
    return edges.where(key < int(share * 4294967296))


def without(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """edges less cut (level, src, dst), list positions closed up."""
    left = edges.join(cut.select("level", "src", "dst"), ["level", "src", "dst"], "left_anti")
    order = Window.partitionBy("level", "src").orderBy("pos")
    return left.withColumn("pos", F.row_number().over(order) - 1).select("level", "src", "pos", "dst")


def extended(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new (level, src, dst) appended to their lists in dst order; those that exist are not added again."""
    fresh = new.select("level", "src", "dst").where("src <> dst").distinct().join(edges.select("level", "src", "dst"), ["level", "src", "dst"], "left_anti")
    both = edges.select("level", "src", "dst", F.lit(0).alias("late"), F.col("pos").cast("long").alias("place")).union(fresh.select("level", "src", "dst", F.lit(1), F.col("dst")))
    order = Window.partitionBy("level", "src").orderBy("late", "place")
    return both.withColumn("pos", F.row_number().over(order) - 1).select("level", "src", "pos", "dst")


# local insertion


def reach(a: np.ndarray, hops: int) -> np.ndarray:
    """Which columns each row reaches in 1..hops steps of the boolean matrix a."""
    out, step = a.copy(), a.copy()
    for _ in range(hops - 1):
        new = out | (step.astype(np.int64) @ a.astype(np.int64) > 0)
        if (new == out).all():
            break
        step, out = new, new
    return out


def deficit_edges(a: np.ndarray, jumps: int, repeats: int = 1, both_ways: bool = True) -> list[tuple[int, int]]:
    """Links that the adjacency a lacks most, given as added index pairs.

    The row that reaches fewest within `jumps` is linked with the unreached column that reaches most within jumps - 1.
    """
    a, added = a.astype(bool).copy(), []
    for _ in range(repeats):
        far, near = reach(a, jumps), reach(a, max(1, jumps - 1)) if jumps > 1 else np.zeros_like(a)
        r = int((~far).sum(axis=1).argmax())
        score = np.where(~far[r], near.sum(axis=1), 0)
        if not score.max(initial=0):
            break
        c = int(score.argmax())
        if r == c:
            continue
        for u, v in ((r, c), (c, r)) if both_ways else ((r, c),):
            if not a[u, v]:
                a[u, v] = True
                added.append((u, v))
    return added


def expansion(g: search.Graph, q: np.ndarray, start: int, ef: int, level: int = 0, start_dist: float | None = None) -> list[tuple[float, int]]:
    """Best first without a cut-off: ascending (dist, node) of the expanded, until ef are seen or 2 ef expanded."""
    from heapq import heappop, heappush

    d0 = float(g.distances(q, np.array([start]))[0]) if start_dist is None else start_dist
    heap, seen, out = [(d0, start)], {start}, []
    while heap and len(seen) < ef and len(out) < 2 * ef:
        d, node = heappop(heap)
        out.append((d, node))
        fresh = [v for v in g.lists[level][node].tolist() if v not in seen]
        if fresh:
            seen.update(fresh)
            for dv, v in zip(g.distances(q, np.array(fresh)).tolist(), fresh, strict=True):
                heappush(heap, (dv, v))
    while heap and len(out) < 2 * ef:
        out.append(heappop(heap))
    return sorted(out)


def local_edges(g: search.Graph | search.Shards, vectors: DataFrame, settings: Settings) -> DataFrame:
    """level, src, dst that hop-limited reachability around each seed asks for; vectors: the seeds.

    Around a seed, the core_k nearest expanded nodes (the seed among them) and their adjacency. The hierarchical family
    expands level 0 from the seed itself and links nodes of the task's level; others expand from the entry. Each seed
    is a node of one shard, in which it asks.
    """

    def each(g: search.Graph, q_id: int, q: np.ndarray):
        levels = min(settings.level_scope, len(g.lists)) if settings.family == "hnsw" else 1
        own = int(np.searchsorted(g.ids, q_id))
        from_seed = settings.family == "hnsw"
        found = expansion(g, q, own if from_seed else g.start(q_id), settings.ef_max, 0, 0.0 if from_seed else None)
        rows = []
        for level in range(levels):
            if level and (g.tops is None or g.tops[own] < level):
                break
            core = [v for _, v in found if not level or g.tops[v] >= level][: settings.core_k]
            if own not in core:
                core = [*core[: settings.core_k - 1], own]
            place = {v: i for i, v in enumerate(core)}
            a = np.zeros((len(core), len(core)), bool)
            for v, i in place.items():
                for w in g.lists[level][v].tolist():
                    if w in place:
                        a[i, place[w]] = True
            rows += [(level, int(g.ids[core[u]]), int(g.ids[core[v]])) for u, v in deficit_edges(a, settings.jumps, settings.repeat_max)]
        return rows

    return search._over(g, vectors, "level int, src long, dst long", each, home=True).distinct()


# repair, tuning, evaluation


def pseudo_truth(g: search.Graph | search.Shards, vectors: DataFrame, degree: int, ef: int = 2000) -> DataFrame:
    """q_id, rank, b_id: what the index itself finds for its own vectors at a high ef; of cells, in a vector's own."""
    return search.answers(g, vectors, degree, ef, home=_overlapping(g))


def _overlapping(g: search.Graph | search.Shards) -> bool:
    return isinstance(g, search.Shards) and g.centres is not None


def repair_edges(found: DataFrame, truth: DataFrame, vectors: DataFrame, degree: int, target: float = 0.90, most: int = 2, present: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """level 0 src, dst (both ways) for nodes whose recall of `truth` falls under the target.

    A node's missing neighbours, in rank order, are each linked with the nearest row that was found; two of them at most.
    Edges lie in one shard: with several, present (q_id, b_id, shard) has what each shard found, and a missing neighbour
    is linked with the nearest of its own shard (nodes: id, shard).
    """
    hit = found.select("q_id", "b_id").join(truth.select("q_id", "b_id"), ["q_id", "b_id"], "left_semi").groupBy("q_id").agg(F.count("*").alias("h"))
    poor = truth.select("q_id").distinct().join(hit, "q_id", "left").where(F.coalesce("h", F.lit(0)) / degree + 1e-6 < target).select("q_id")
    lost = knn.missing(found, truth).join(poor, "q_id", "left_semi")
    if present is None:
        near = knn.nearest_present(lost, found.join(poor, "q_id", "left_semi"), vectors)
    else:
        placed = lost.join(nodes.select(F.col("id").alias("b_id"), "shard"), "b_id")
        near = knn.nearest_present(placed, present.join(poor, "q_id", "left_semi"), vectors, within=("shard",))
    near = near.where("b_id <> present").join(lost, ["q_id", "b_id"])
    order = Window.partitionBy("q_id").orderBy("rank")
    pick = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    out = pick.select(F.lit(0).alias("level"), F.col("present").alias("src"), F.col("b_id").alias("dst"))
    return out.union(out.select("level", "dst", "src")).distinct()


def repairs(g: search.Graph | search.Shards, vectors: DataFrame, truth: DataFrame, degree: int, ef: int, target: float = 0.90) -> DataFrame:
    """repair_edges of what a search at ef finds for the index's own vectors."""
    if not isinstance(g, search.Shards) or _overlapping(g):  # cells are one graph: a new edge may lie in any of them
        return repair_edges(checkpointed(search.answers(g, vectors, degree, ef, home=_overlapping(g))), truth, vectors, degree, target)
    parts = checkpointed(search.shard_answers(g, vectors, degree, ef))
    found = checkpointed(search.merged_answers(parts, degree))
    return repair_edges(found, truth, vectors, degree, target, present=parts.where("b_id is not null").select("q_id", "b_id", "shard"), nodes=g.nodes)


def recall_at(g: search.Graph | search.Shards, queries: DataFrame, truth: DataFrame, k: int, ef: int) -> tuple[float, float]:
    """(recall@k, mean evaluations) at one ef."""
    found = search.knn_search(g, queries, k, ef)
    hit = truth.where(F.col("rank") <= k).select("q_id", "b_id", F.lit(1).alias("hit"))
    each = found.join(hit, ["q_id", "b_id"], "left").groupBy("q_id").agg(F.count("hit").alias("h"), F.max("evaluations").alias("e"))
    n = truth.select("q_id").distinct().count()
    row = each.agg(F.sum("h"), F.avg("e")).first()
    return (row[0] or 0) / (n * k), row[1] or 0.0


def recalls_at(g: search.Graph | search.Shards, queries: DataFrame, truth: DataFrame, k: int, efs: Sequence[int]) -> Iterator[tuple[float, float]]:
    """recall_at for each ef; of one shard in one job."""
    if isinstance(g, search.Shards):
        yield from (recall_at(g, queries, truth, k, ef) for ef in efs)
        return

    def each(g: search.Graph, q_id: int, q: np.ndarray):
        for ef, (found, count) in zip(efs, search.searches(g, q, q_id, k, efs), strict=True):
            yield from ((q_id, ef, int(g.ids[v]), count) for _, v in found)

    hit = truth.where(F.col("rank") <= k).select("q_id", "b_id", F.lit(1).alias("hit"))
    found = search._over(g, queries, "q_id long, ef int, b_id long, evaluations long", each)
    own = found.join(hit, ["q_id", "b_id"], "left").groupBy("ef", "q_id").agg(F.count("hit").alias("h"), F.max("evaluations").alias("e"))
    rows = {r[0]: r for r in own.groupBy("ef").agg(F.sum("h"), F.avg("e")).collect()}  # a row for each ef
    n = truth.select("q_id").distinct().count()
    for ef in efs:
        _, h, e = rows.get(ef, (ef, 0, 0.0))
        yield h / (n * k), e


def measures(g: search.Graph | search.Shards, queries: DataFrame, truth: DataFrame, k: int, ef: int) -> tuple[float, float, float | None]:
    """recall_at, and the acer of the same searches' traces on level 0; of one shard in one search a query."""
    if isinstance(g, search.Shards):
        return *recall_at(g, queries, truth, k, ef), search.cost(search.traces(g, queries, ef).where("level = 0")).first()["acer"]

    def each(g: search.Graph, q_id: int, q: np.ndarray):
        met, adopted = 0, 0

        def event(level: int, src: int, v: int, d: float, own: int) -> None:
            nonlocal met, adopted
            if level == 0:
                met, adopted = met + 1, adopted + own

        found, count, _ = search.search(g, q, q_id, k, ef, event)
        return [(q_id, int(g.ids[v]), count, adopted, met) for _, v in found]

    hit = truth.where(F.col("rank") <= k).select("q_id", "b_id", F.lit(1).alias("hit"))
    found = search._over(g, queries, "q_id long, b_id long, evaluations long, adopted long, met long", each)
    own = found.join(hit, ["q_id", "b_id"], "left").groupBy("q_id").agg(F.count("hit").alias("h"), F.max("evaluations").alias("e"), F.max(F.expr("if(met > 0, adopted / met, null)")).alias("a"))
    asked = truth.agg(F.count_distinct("q_id").alias("n"))
    h, e, a, n = own.agg(F.sum("h"), F.avg("e"), F.avg("a")).join(F.broadcast(asked)).first()
    return (h or 0) / (n * k), e or 0.0, a


def _first_reaching(g: search.Graph | search.Shards, queries: DataFrame, truth: DataFrame, k: int, target: float, efs: Sequence[int]) -> int | None:
    """The first of efs that reaches the target; they are asked for 4, 8, 16, ... at once, so that few are in vain."""
    at, size = 0, 4
    while at < len(efs):
        part = efs[at : at + size]
        for ef, (r, _) in zip(part, recalls_at(g, queries, truth, k, part), strict=True):
            if r >= target:
                return ef
        at, size = at + size, 2 * size
    return None


def tuned_ef(g: search.Graph | search.Shards, queries: DataFrame, truth: DataFrame, k: int, target: float, start: int, coarse: int, fine: int, most: int) -> int:
    """The least ef of a coarse, then fine grid that reaches the target recall; `most` if none does."""
    ef = _first_reaching(g, queries, truth, k, target, range(start, most + 1, coarse))
    if ef is None or ef == start:
        return most if ef is None else ef
    return _first_reaching(g, queries, truth, k, target, range(ef - coarse + fine, ef, fine)) or ef


def dynamic_efs(tuned: int) -> dict[str, int]:
    return {"prune": tuned, "train": 2000, "add": max(2 * tuned, 2000)}


def sweep(g: search.Graph | search.Shards, queries: DataFrame, truth: DataFrame, k: int, efs: Iterator[int] | range, stop_at: float | None = None) -> list[dict]:
    """ef, recall and mean evaluations over a range of ef, until a recall is passed."""
    out = []
    for ef in efs:
        r, e = recall_at(g, queries, truth, k, ef)
        out.append({"k": k, "ef": ef, "recall": r, "evaluations": e})
        if stop_at is not None and r > stop_at:
            break
    return out


def edge_impact(g: search.Graph | search.Shards, seeds_of: DataFrame, vectors: DataFrame, truth: DataFrame, k: int, ef: int) -> DataFrame:
    """src, dst, seeds, comparison_diff, recall_diff, impact_ratio: searches with and without each edge, for its seeds.

    seeds_of: (src, dst, seed). Both searches leave the seed out of its answer. impact_ratio: relative change of
    evaluations; diffs are baseline less disabled, averaged over seeds. With several shards the edge's own is searched
    again and the others' part of the answer and the evaluations stays.
    """
    true = truth.where("q_id <> b_id").withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))).where(F.col("r") <= k)
    wanted = true.groupBy(F.col("q_id").alias("seed")).agg(F.collect_list("b_id").alias("truth"))
    if _overlapping(g):
        raise ValueError("an edge of overlapping cells stands in several; open the graph as one for its edges' impact")
    if isinstance(g, search.Shards):
        return _impact(_shard_impact(g, seeds_of, vectors, wanted, k, ef))
    spark = vectors.sparkSession
    shared = g.shared(spark)
    names = ["src", "dst", "base_evals", "evals", "base_recall", "recall"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held = shared.value, {}

        def one(q_id: int, truth: set, off: frozenset):
            own = int(np.searchsorted(g.ids, q_id))
            found, count, _ = search.search(g, g.x[own], q_id, ef, ef, disabled=off)
            ids = [int(g.ids[v]) for _, v in found if g.ids[v] != q_id][:k]
            return count, len(truth & set(ids)) / k

        for b in batches:
            rows = []
            for src, dst, seed, truth in zip(*(b.column(n).to_pylist() for n in ("src", "dst", "seed", "truth")), strict=True):
                if seed not in held:
                    if len(held) > 10_000:
                        held.clear()
                    held[seed] = one(seed, set(truth), frozenset())
                off = frozenset([(int(np.searchsorted(g.ids, src)), int(np.searchsorted(g.ids, dst)))])
                rows.append((src, dst, held[seed][0], (now := one(seed, set(truth), off))[0], held[seed][1], now[1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    # one seed's edges go to one task, which searches its baseline once; rows are small and long work, so their tasks are not to be merged
    rows = seeds_of.select("src", "dst", "seed").join(wanted, "seed").repartition(4 * spark.sparkContext.defaultParallelism, "seed").mapInArrow(run, _IMPACT)
    return _impact(rows)


_IMPACT = "src long, dst long, base_evals long, evals long, base_recall double, recall double"


def _shard_impact(g: search.Shards, seeds_of: DataFrame, vectors: DataFrame, wanted: DataFrame, k: int, ef: int) -> DataFrame:
    """Rows of _IMPACT. A seed goes to each shard with its edges there and all shards' baseline answers."""
    asked = vectors.join(seeds_of.select(F.col("seed").alias("vec_id")).distinct(), "vec_id", "left_semi")
    base = search.shard_answers(g, asked, k, ef, exclude_self=True)
    base = base.groupBy(F.col("q_id").alias("seed")).agg(F.collect_list(F.struct("shard", F.coalesce("dist", F.lit(math.inf)).alias("dist"), F.coalesce("b_id", F.lit(-1)).alias("b_id"), "evaluations")).alias("base"))  # k a shard
    cut = seeds_of.join(g.nodes.select(F.col("id").alias("src"), "shard"), "src").groupBy("shard", "seed").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))  # a trace's
    rows = cut.join(wanted, "seed").join(base, "seed").join(asked.select(F.col("vec_id").alias("seed"), "embedding"), "seed").withColumnRenamed("seed", "vec_id")

    def each(g: search.Graph, q_id: int, q: np.ndarray, edges, truth, base):
        truth, others = set(truth), [(b["dist"], b["b_id"]) for b in base if b["shard"] != g.shard and b["b_id"] >= 0]
        elsewhere = sum({b["shard"]: b["evaluations"] for b in base if b["shard"] != g.shard}.values())

        def one(off: frozenset):
            found, count, _ = search.search(g, q, q_id, ef, ef, disabled=off)
            own = [(d, int(g.ids[v])) for d, v in found if g.ids[v] != q_id][:k]
            return elsewhere + count, len(truth & {b for _, b in sorted(own + others)[:k]}) / k

        whole = one(frozenset())
        for e in edges:
            now = one(frozenset([(int(np.searchsorted(g.ids, e["src"])), int(np.searchsorted(g.ids, e["dst"])))]))
            yield e["src"], e["dst"], whole[0], now[0], whole[1], now[1]

    return search._dealt(g, rows, _IMPACT, each, False, ("shard", "edges", "truth", "base"))


def _impact(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "dst").agg(
        F.count("*").alias("seeds"),
        F.avg(F.col("base_evals") - F.col("evals")).alias("comparison_diff"),
        F.avg(F.col("base_recall") - F.col("recall")).alias("recall_diff"),
        F.avg((F.col("base_evals") - F.col("evals")) / F.col("base_evals")).alias("impact_ratio"),
    )


def impact_summary(impact: DataFrame, column: str = "impact_ratio") -> DataFrame:
    """One row: mean, median, max and how many are over 1, 1.5, 2 and 5 percent."""
    x = F.abs(column)
    over = {"over_1": 0.01, "over_1_5": 0.015, "over_2": 0.02, "over_5": 0.05}
    return impact.agg(F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.max(x).alias("max"), *[F.count_if(x > t).alias(n) for n, t in over.items()])


def quantiles(frame: DataFrame, value: Column, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: exact quantiles with linear interpolation, p25 ... p99."""
    return frame.agg(*[F.percentile(value, q).alias(f"p{round(100 * q)}") for q in at])


def isolated_share(edges: DataFrame, nodes: DataFrame) -> float:
    """Share of nodes without out-links; insertion is skipped above 0.1."""
    row = nodes.select("id").join(edges.select(F.col("src").alias("id")).distinct().withColumn("has", F.lit(1)), "id", "left").agg(F.avg(F.col("has").isNull().cast("int"))).first()
    return row[0] or 0.0


def refine(edges: DataFrame, nodes: DataFrame, vectors: DataFrame, queries: DataFrame, truth: DataFrame, settings: Settings, k: int = 20, cells: Cells | None = None) -> tuple[DataFrame, DataFrame]:
    """(refined edges, log): alternate prune and add rounds, prune first; each round's edges are checkpointed.

    cells: those of a united graph that is too large for one task; each search then stays in a few of them.

    ef is tuned on (queries, truth), which are parameters. The log has a row for each round: round, operation, ef,
    changed (edges), edges, recall, evaluations, acer.
    """
    spark = vectors.sparkSession
    random = settings.family == "hcnng"
    edges, log = checkpointed(edges.select("level", "src", "pos", "dst")), []
    base = vectors.where("embedding is not null")
    opened = partial((cells or search).opened, random_entry=random)

    def measured(turn: int, what: str, ef: int, g: search.Graph | search.Shards | None) -> search.Graph | search.Shards:
        size, g = edges.count(), again(g)
        r, e, acer = measures(g, queries, truth, k, ef)
        log.append((turn, what, ef, abs(size - log[-1][4]) if log else 0, size, r, e, acer))
        return g

    def again(g: search.Graph | search.Shards | None) -> search.Graph | search.Shards:
        """The edges as they are now; of one shard only they are read again."""
        return search.relinked(g, edges, edges.count()) if isinstance(g, search.Graph) else opened(edges, nodes, base)

    g = measured(0, "start", max(k, settings.ef_cap // 20), None)
    for turn in range(1, settings.rounds + 1):
        start = max(k, settings.coarse_step) if settings.family == "hnsw" else settings.coarse_step
        ef = tuned_ef(g, queries, truth, k, settings.target_recall, start, settings.coarse_step, settings.fine_step, settings.ef_cap)
        if turn % 2:
            chosen = base.join(seeds(base, settings.seed_share), "vec_id", "left_semi")
            stats = checkpointed(search.aligned(edges, search.edge_counts(g, chosen, ef, settings.level_scope)))  # searched once
            edges = checkpointed(without(edges, prune_selected(stats, settings.prune_ratio)))
        elif isolated_share(edges.where("level = 0"), nodes) <= 0.1:
            if settings.family != "nsg":
                true = checkpointed(pseudo_truth(g, base, settings.repair_degree, settings.train_ef))
                edges = checkpointed(extended(edges, repairs(g, base, true, settings.repair_degree, max(ef, settings.repair_degree), settings.repair_target)))
                g = again(g)
            chosen = base.join(seeds(base, 0.1), "vec_id", "left_semi") if settings.family == "nsg" else base
            edges = checkpointed(extended(edges, local_edges(g, chosen, settings)))
        g = measured(turn, "prune" if turn % 2 else "add", ef, g)
    return edges, spark.createDataFrame(log, "round int, operation string, ef int, changed long, edges long, recall double, evaluations double, acer double")


def settings_for(family: str, **changed) -> Settings:
    return replace(FAMILY[family], **changed)

"""Greedy walks over an edge table as rounds of joins: all queries move one step a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..plans.iterate import checkpointed


def steps(edges: DataFrame, vectors: DataFrame, queries: DataFrame, entry: DataFrame) -> DataFrame:
    """q_id, step, node, dist: from the entry (one row: vec_id) to the nearest neighbour (ties to the first in the
    list) as long as that is strictly nearer."""
    v = vectors.select(F.col("vec_id").alias("node"), F.col("embedding").alias("_v"))
    q = queries.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("_q"))
    near = metrics.squared_l2(F.col("_q"), F.col("_v"))
    start = F.broadcast(entry.select(F.col("vec_id").alias("node")))  # one row
    now = q.join(start).join(v, "node").select("q_id", F.lit(0).alias("step"), "node", near.alias("dist"))
    now = out = checkpointed(now)
    turn = 0
    while True:
        turn += 1
        around = scanned(edges, vectors, queries, now)
        best = around.groupBy("q_id", "at").agg(F.min(F.struct("d", "pos", "dst")).alias("m"))
        now = checkpointed(best.where("m.d < at").select("q_id", F.lit(turn).alias("step"), F.col("m.dst").alias("node"), F.col("m.d").alias("dist")))
        if now.isEmpty():
            return out
        out = out.union(now)


def scanned(edges: DataFrame, vectors: DataFrame, queries: DataFrame, at: DataFrame) -> DataFrame:
    """q_id, src, pos, dst, d, at: the neighbours that a step at a node (q_id, node, dist) looks at."""
    q = queries.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("_q"))
    v = vectors.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("_v"))
    links = at.select("q_id", F.col("node").alias("src"), F.col("dist").alias("at")).join(edges.select("src", "pos", "dst"), "src")
    return links.join(v, "dst").join(q, "q_id").select("q_id", "src", "pos", "dst", metrics.squared_l2(F.col("_q"), F.col("_v")).alias("d"), "at")


def edge_statistics(edges: DataFrame, vectors: DataFrame, queries: DataFrame, path: DataFrame) -> DataFrame:
    """src, dst, adopted, discarded: over all steps, neighbours nearer than the node stepped from are adopted."""
    rows = scanned(edges, vectors, queries, path)
    return rows.groupBy("src", "dst").agg(F.sum((F.col("d") < F.col("at")).cast("long")).alias("adopted"), F.sum((F.col("d") >= F.col("at")).cast("long")).alias("discarded"))


def pruned_lists(candidates: DataFrame, vectors: DataFrame, most: int, alpha: float | None, keys: tuple[str, ...] = ("src",)) -> DataFrame:
    """(src, dst, dist) candidates -> src, pos, dst kept, as a fold over each list in (dist, dst) order; keys tell lists apart.

    alpha None: a candidate stays if no kept one is nearer to it than src is (the hierarchical rule). Else it goes if
    alpha * d(kept, candidate) <= d(src, candidate) for a kept one (the robust rule).
    """
    v = vectors.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("e"))
    lists = candidates.join(v, "dst").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dist", "dst", "e"))).alias("c"))  # bounded lists

    def step(kept, c):
        far = (lambda k: metrics.squared_l2(k["e"], c["e"]) < c["dist"]) if alpha is None else (lambda k: alpha * metrics.squared_l2(k["e"], c["e"]) <= c["dist"])
        return F.when((F.size(kept) < most) & ~F.exists(kept, far), F.concat(kept, F.array(c))).otherwise(kept)

    empty = F.filter("c", lambda x: F.lit(False))
    return lists.select(*keys, F.posexplode(F.transform(F.aggregate("c", empty, step), lambda k: k["dst"])).alias("pos", "dst"))


def beam_rounds(edges: DataFrame, vectors: DataFrame, queries: DataFrame, entry: DataFrame, ef: int) -> DataFrame:
    """q_id, found (ascending structs of dist and node), evaluations: best-first search as rounds of joins.

    entry: a row (vec_id) for each shard; a query's searches from all of them are merged.
    All queries expand one node a round; neighbours are offered in list order by a fold over the round's array. Gives
    what search.beam gives, without holding the graph in one place; a round costs a job, so it suits small ef.
    """
    v = vectors.select(F.col("vec_id").alias("node"), F.col("embedding").alias("_v"))
    q = queries.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("_q"))
    near = metrics.squared_l2(F.col("_q"), F.col("_v"))
    start = F.broadcast(entry.select(F.col("vec_id").alias("node")))  # one row a shard
    first = q.join(start).join(v, "node").select("q_id", F.col("node").alias("root"), "node", near.alias("d"))
    held = lambda d, i: F.array(F.struct(d.alias("d"), i.alias("i")))
    # open nodes hold the negative id: of equal distances the larger id is the least
    state = first.select("q_id", "root", held(F.col("d"), F.col("node")).alias("top"), held(F.col("d"), -F.col("node")).alias("open"), F.array("node").alias("seen"), F.lit(False).alias("done"))
    links = edges.select(F.col("src").alias("at"), "pos", F.col("dst").alias("node"))

    def offered(acc, x):
        takes = (F.size(acc["top"]) < ef) | (x["d"] < F.array_max(acc["top"])["d"])
        grown = F.concat(acc["top"], held(x["d"], x["node"]))
        top = F.when(F.size(grown) > ef, F.array_except(grown, F.array(F.array_max(grown)))).otherwise(grown)
        return F.struct(F.when(takes, top).otherwise(acc["top"]).alias("top"), F.when(takes, F.concat(acc["open"], held(x["d"], -x["node"]))).otherwise(acc["open"]).alias("open"))

    state = checkpointed(state)
    while True:
        nearest = F.array_min("open")
        over = F.col("done") | (F.size("open") == 0) | ((nearest["d"] > F.array_max("top")["d"]) & (F.size("top") == ef))
        state = checkpointed(state.withColumn("done", over))
        live = state.where("not done")
        if live.isEmpty():
            each = state.groupBy("q_id").agg(F.flatten(F.collect_list("top")).alias("top"), F.sum(F.size("seen")).cast("int").alias("evaluations"))  # ef a shard
            return each.select("q_id", F.transform(F.slice(F.array_sort("top"), 1, ef), lambda t: F.struct(t["d"].alias("dist"), t["i"].alias("node"))).alias("found"), "evaluations")
        popped = live.withColumn("at", -nearest["i"]).withColumn("open", F.array_except("open", F.array(nearest)))
        around = popped.select("q_id", "root", "at", "seen").join(links, "at").where(~F.array_contains("seen", F.col("node")))
        fresh = around.join(v, "node").join(q, "q_id").groupBy("q_id", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "node", near.alias("d")))).alias("fresh"))
        met = popped.join(fresh, ["q_id", "root"], "left").withColumn("fresh", F.coalesce("fresh", F.array().cast("array<struct<pos:int,node:bigint,d:double>>")))
        folded = met.withColumn("acc", F.aggregate("fresh", F.struct("top", "open"), offered))
        state = folded.select("q_id", "root", "acc.top", "acc.open", F.concat("seen", F.transform("fresh", lambda x: x["node"])).alias("seen"), "done").union(state.where("done"))

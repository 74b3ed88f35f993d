"""Search trees: rows of search.trees, (q_id, shard, seq, node, parent, dist, place, evaluations), one for each node that
a search adopted, linked to the node whose list it was met in; the root has no parent.

A query has a tree in each shard of the graph; nodes of two trees are never the same but where shards overlap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.iterate import checkpointed
from .refine import deficit_edges


def marked(trees: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """trees with chosen: 1 for the k nearest that a search found, else 0. With targets (q_id, target): 2 for the nearest
    found, if it is the query's target, and 0 for all others."""
    if targets is None:
        return trees.withColumn("chosen", F.coalesce((F.col("place") <= k).cast("int"), F.lit(0)))
    hit = (F.col("place") == 1) & (F.col("node") == F.col("target"))
    return trees.join(targets.select("q_id", "target"), "q_id", "left").withColumn("chosen", F.when(hit, 2).otherwise(0)).drop("target")


def ratios(trees: DataFrame) -> DataFrame:
    """q_id, shard, held, evaluations, ecr: how many nodes a search held at its end, for each that it compared."""
    each = trees.groupBy("q_id", "shard").agg(F.count("place").alias("held"), F.max("evaluations").alias("evaluations"))
    return each.withColumn("ecr", F.col("held") / F.col("evaluations"))


def sizes(trees: DataFrame) -> DataFrame:
    """q_id, nodes, leaves, over all trees of a query."""
    inner = trees.where("parent is not null").select("q_id", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(1))
    return trees.join(inner, ["q_id", "node"], "left").groupBy("q_id").agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("inner").isNull(), 1).otherwise(0)).alias("leaves"))


def main_paths(marked: DataFrame) -> DataFrame:
    """q_id, up (0 at the target), node: the way from the node marked 2 up to its root; none where no target was found."""
    t = checkpointed(marked.select("q_id", "shard", "node", "parent", "chosen"))
    now = t.where("chosen = 2").select("q_id", "shard", F.lit(0).alias("up"), "node", "parent")
    out, up = now, 0
    while True:
        up += 1
        step = now.where("parent is not null").select("q_id", "shard", F.col("parent").alias("node")).join(t, ["q_id", "shard", "node"])
        now = checkpointed(step.select("q_id", "shard", F.lit(up).alias("up"), "node", "parent"))
        if now.isEmpty():
            return out.select("q_id", "up", "node")
        out = out.union(now)


def path_edges(paths: DataFrame) -> DataFrame:
    """q_id, src, dst of the steps of main paths."""
    a = paths.select("q_id", "up", F.col("node").alias("dst"))
    b = paths.select("q_id", (F.col("up") - 1).alias("up"), F.col("node").alias("src"))
    return a.join(b, ["q_id", "up"]).select("q_id", "src", "dst")


def node_visits(paths: DataFrame) -> DataFrame:
    return paths.groupBy("node").agg(F.count("*").alias("visits"))


def edge_visits(paths: DataFrame) -> DataFrame:
    return path_edges(paths).groupBy("src", "dst").agg(F.count("*").alias("visits"))


def depths(paths: DataFrame) -> DataFrame:
    """q_id, depth of the target (the root has 0)."""
    return paths.groupBy("q_id").agg(F.max("up").alias("depth"))


def inner_visits(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, visits) of nodes with children, and (src, dst, visits) of links to them, over all trees."""
    t = trees
    inner = t.where("parent is not null").select("q_id", F.col("parent").alias("node")).distinct()
    own = t.join(inner, ["q_id", "node"], "left_semi")
    return own.groupBy("node").agg(F.count("*").alias("visits")), own.where("parent is not null").groupBy(F.col("parent").alias("src"), F.col("node").alias("dst")).agg(F.count("*").alias("visits"))


def shortcuts(paths: DataFrame, longest: int = 8, least_visits: int = 2) -> DataFrame:
    """src, dst: for main paths of over `longest` nodes, a link to the target from the first node (from the root) that
    under `least_visits` main paths visit."""
    visits = node_visits(paths)
    size = Window.partitionBy("q_id")
    p = paths.withColumn("n", F.count("*").over(size)).where(F.col("n") > longest).join(visits, "node")
    rare = p.where((F.col("visits") < least_visits) & (F.col("up") > 1)).groupBy("q_id").agg(F.max(F.struct("up", "node")).alias("m"))
    target = paths.where("up = 0").select("q_id", F.col("node").alias("dst"))
    return rare.join(target, "q_id").select(F.col("m.node").alias("src"), "dst").distinct()


def local_matrix(trees: DataFrame, edges: DataFrame, num: int = 10) -> DataFrame:
    """q_id, src, dst, i, j, shard: links among each tree's `num` nearest nodes, with their places in that order."""
    order = Window.partitionBy("q_id", "shard").orderBy("dist", "node")
    near = trees.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") < num).select("q_id", "shard", "node", "i")
    a = near.select("q_id", "shard", F.col("node").alias("src"), "i")
    b = near.select("q_id", "shard", F.col("node").alias("dst"), F.col("i").alias("j"))
    return a.join(edges.select("src", "dst").distinct(), "src").join(b, ["q_id", "shard", "dst"]).select("q_id", "src", "dst", "i", "j", "shard")


def local_links(trees: DataFrame, edges: DataFrame, num: int = 10, jumps: int = 8, most: int = 5) -> DataFrame:
    """q_id, src, dst: up to `most` directed links that the `num` nearest nodes of each tree lack (see refine)."""
    order = Window.partitionBy("q_id", "shard").orderBy("dist", "node")
    near = trees.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") < num).select("q_id", "shard", "node", "i")
    links = local_matrix(trees, edges, num).groupBy("q_id", "shard").agg(F.collect_list(F.struct("i", "j")).alias("links"))  # num * num
    core = near.groupBy("q_id", "shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda s: s["node"]).alias("core"))

    def run(batches):
        for pdf in batches:
            rows = []
            for q_id, core, links in zip(pdf["q_id"], pdf["core"], pdf["links"], strict=True):
                a = np.zeros((len(core), len(core)), bool)
                for x in links if links is not None else []:
                    a[x["i"], x["j"]] = True
                rows += [(q_id, core[u], core[v]) for u, v in deficit_edges(a, jumps, most, both_ways=False)]
            yield pd.DataFrame(rows, columns=["q_id", "src", "dst"])

    return core.join(links, ["q_id", "shard"], "left").mapInPandas(run, "q_id long, src long, dst long")


PREORDER = "q_id long, shard int, at int, node long, parent long, depth int, dist double, chosen int"
#: Depth beyond which printed trees end (fixed value).
DEEPEST = 7


def preorder(marked: DataFrame) -> DataFrame:
    """q_id, shard, at, node, parent, depth, dist, chosen: each tree depth first, children in the order they were met.

    A node that is met again stays where it was met first. A task holds one search's tree at a time, which is as long as
    the nodes that search adopted.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        q_id, shard = pdf["q_id"].iloc[0], pdf["shard"].iloc[0]
        met, below = set(), {}
        for node, parent, dist, chosen in zip(pdf["node"], pdf["parent"].astype("Int64"), pdf["dist"], pdf["chosen"], strict=True):
            if node not in met:
                met.add(node)
                below.setdefault(None if parent is pd.NA else int(parent), []).append((node, parent, dist, chosen))
        rows, left = [], [(*root, 0) for root in reversed(below.get(None, []))]
        while left:
            node, parent, dist, chosen, depth = left.pop()
            rows.append((q_id, shard, len(rows), node, parent, depth, dist, chosen))
            left += [(*child, depth + 1) for child in reversed(below.get(node, []))]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PREORDER.split(", ")])
        return out.astype({"parent": "Int64", "dist": "float64"})

    return marked.select("q_id", "shard", "seq", "node", "parent", "dist", "chosen").groupBy("q_id", "shard").applyInPandas(run, PREORDER)


def printed(marked: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """q_id, shard, at, line: the trees as indented text, a line a node, without nodes deeper than `deepest`."""
    place = F.row_number().over(Window.partitionBy("q_id", "shard").orderBy("at")) - 1  # a tree is one search's
    shown = preorder(marked).where(F.col("depth") <= deepest).withColumn("at", place)
    dist = F.coalesce(F.expr("format_number(dist, '0.######')"), F.lit("-"))
    # fixed format
    line = F.concat(F.expr("repeat('  ', depth)"), F.lit("Node ID: "), "node", F.lit(" (Depth: "), "depth", F.lit(", Distance: "), dist, F.lit(",chosen"), "chosen", F.lit(",count"), "at", F.lit(")"))
    return shown.select("q_id", "shard", "at", line.alias("line"))

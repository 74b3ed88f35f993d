"""Network statistics of an edge table (src, dst), as joins and aggregations; iterations checkpoint their state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..plans.iterate import checkpointed

#: Pairs of a source and a node it reaches that a batch of betweenness() holds at most.
STATES = 1 << 33
#: Bytes of links and nodes that betweenness() broadcasts at most, and those of each link and node.
LINK_BYTES = 64 << 20
LINK, NODE = 4, 16
#: States, and links followed, of the sources that a task walks at once, about.
WALKED = 1 << 21


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, out_degree, in_degree of every node (nodes: id)."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").fillna(0, ["out_degree", "in_degree"])


def joint_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """x (source's out-degree), y (target's in-degree), share of edges, and both marginals a_x, b_y."""
    d = degrees(edges, nodes)
    pairs = edges.join(d.select(F.col("id").alias("src"), F.col("out_degree").alias("x")), "src").join(d.select(F.col("id").alias("dst"), F.col("in_degree").alias("y")), "dst")
    e = pairs.groupBy("x", "y").agg(F.count("*").alias("c"))
    total = e.agg(F.sum("c").alias("t"))
    e = e.join(F.broadcast(total)).select("x", "y", (F.col("c") / F.col("t")).alias("share"))
    return e.join(e.groupBy("x").agg(F.sum("share").alias("a_x")), "x").join(e.groupBy("y").agg(F.sum("share").alias("b_y")), "y")


def assortativity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: pearson, the correlation of the ends' degrees, and pair_variance, which takes variances over distinct pairs.

    pair_variance sums a_x (x - mean)^2 once for each pair (x, y) that occurs, not once for each x. Both are null if a
    variance is zero.
    """
    j = joint_degrees(edges, nodes)
    x, y, s = F.col("x"), F.col("y"), F.col("share")
    means = j.agg(F.sum(x * s).alias("mx"), F.sum(y * s).alias("my"))
    j = j.join(F.broadcast(means))
    dx, dy = x - F.col("mx"), y - F.col("my")
    sums = j.agg(F.sum(s * dx * dy).alias("c"), F.sum(s * dx * dx).alias("vx"), F.sum(s * dy * dy).alias("vy"), F.sum(F.col("a_x") * dx * dx).alias("qx"), F.sum(F.col("b_y") * dy * dy).alias("qy"))
    over = lambda a, b: F.when((F.col(a) > 1e-12) & (F.col(b) > 1e-12), F.col("c") / F.sqrt(F.col(a) * F.col(b)))
    return sums.select(over("vx", "vy").alias("pearson"), over("qx", "qy").alias("pair_variance"))


def clustering(edges: DataFrame, nodes: DataFrame, share: float = 0.05) -> DataFrame:
    """One row: coefficient, the mean over the first share * n nodes by id of directed triangles / (in * out degree).

    Nodes with under two in-links, or without out-links, count 0; the mean divides by the number of sampled nodes.
    """
    n = nodes.count()
    first = nodes.select("id").orderBy("id").limit(max(1, int(n * share)))
    d = degrees(edges, nodes).join(first, "id", "left_semi")
    e = edges.select("src", "dst").distinct()
    a = e.join(first.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("u"))
    two = a.join(e.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u")
    closed = two.join(e.select(F.col("src").alias("v"), F.col("dst").alias("id")), ["v", "id"], "left_semi").groupBy("id").agg(F.count("*").alias("t"))
    each = d.join(closed, "id", "left").select(F.when((F.col("in_degree") >= 2) & (F.col("out_degree") > 0), F.coalesce("t", F.lit(0)) / (F.col("in_degree") * F.col("out_degree"))).otherwise(0.0).alias("c"))
    return each.agg(F.avg("c").alias("coefficient"))


def edge_lengths(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    v = lambda i, x: vectors.select(F.col("vec_id").alias(i), F.col("embedding").alias(x))
    return edges.join(v("src", "_a"), "src").join(v("dst", "_b"), "dst").select("src", "dst", metrics.euclidean(F.col("_a"), F.col("_b")).alias("length"))


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """id, rank: rank(i) = (1 - d)/n + d * sum of rank(j)/out_degree(j) over i's out-neighbours j.

    Stops after `rounds`, or when the total change falls under the tolerance (0: never).
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("deg")).withColumnRenamed("src", "dst")
    links = checkpointed(edges.select("src", "dst").join(out, "dst"))
    now = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        flow = links.join(now.select(F.col("id").alias("dst"), "rank"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("f"))
        new = nodes.select("id").join(flow, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("f", F.lit(0.0))).alias("rank"))
        if tolerance or i % 5 == 4:
            new = checkpointed(new)
        if tolerance and (new.join(now.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0) < tolerance:
            return new
        now = new
    return now


def hops(edges: DataFrame, sources: DataFrame, most: int = 1 << 30) -> DataFrame:
    """source, id, hop: nodes reachable from each source (sources: id) in at most `most` steps, breadth first."""
    e = edges.select("src", "dst").distinct()
    seen = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hop"))
    front, hop = seen, 0
    while hop < most:
        hop += 1
        new = front.join(e.withColumnRenamed("src", "id"), "id").select("source", F.col("dst").alias("id")).distinct()
        front = checkpointed(new.join(seen, ["source", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def path_summary(edges: DataFrame, nodes: DataFrame, sources: int = 10) -> DataFrame:
    """One row from the first `sources` nodes by id: average_path (over reached nodes), diameter (greatest hop)."""
    first = nodes.select("id").orderBy("id").limit(sources)
    found = hops(edges, first).where("hop > 0")
    return found.agg(F.avg("hop").alias("average_path"), F.max("hop").cast("long").alias("diameter"))


def closeness(edges: DataFrame, nodes: DataFrame, sources: int = 10) -> DataFrame:
    """id, closeness among the first `sources` nodes, which are sources and targets alike (Wasserman and Faust).

    With r nodes reached (itself included) at total distance t: ((r-1)/(s-1)) * ((r-1)/t); 0 if none is reached.
    """
    first = nodes.select("id").orderBy("id").limit(sources)
    found = hops(edges, first).join(first, "id", "left_semi").where("hop > 0")
    each = found.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("r"), F.sum("hop").alias("t"))
    value = F.col("r") / F.lit(float(max(1, sources - 1))) * (F.col("r") / F.col("t"))
    return first.join(each, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def effective_size(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, size: n - 2t/n for n out-neighbours, t ordered pairs of them that are linked."""
    e = edges.select("src", "dst").distinct()
    n = e.groupBy("src").agg(F.count("*").alias("n"))
    a, b = e.withColumnRenamed("dst", "u"), e.withColumnRenamed("dst", "v")
    linked = a.join(e.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u").join(b, ["src", "v"], "left_semi")
    t = linked.groupBy("src").agg(F.count("*").alias("t"))
    size = F.col("n") - 2 * F.coalesce("t", F.lit(0)) / F.col("n")
    return nodes.select("id").join(n.join(t, "src", "left").select(F.col("src").alias("id"), size.alias("size")), "id", "left").fillna(0.0, ["size"])


def path_counts(edges: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """A table a hop (from 0): source, id, paths, the number of shortest paths from each source (sources: id)."""
    e = checkpointed(edges.select("src", "dst").distinct())
    front = checkpointed(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))
    seen, levels = front.select("source", "id"), []
    while not front.isEmpty():
        levels.append(front)
        new = front.join(e.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = checkpointed(new.join(seen, ["source", "id"], "left_anti"))
        seen = checkpointed(seen.unionByName(front.select("source", "id")))
    return levels


def dependencies(edges: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """id, part: what the sources of path_counts depend on each node for; a source does not count for itself."""
    e = checkpointed(edges.select(F.col("src").alias("up"), F.col("dst").alias("id")).distinct())
    out, below = None, None
    for level in reversed(levels[1:]):
        if below is None:
            now = level.withColumn("part", F.lit(0.0))
        else:
            each = below.join(e, "id").select("source", F.col("up").alias("id"), ((1 + F.col("part")) / F.col("paths")).alias("share"))
            now = level.join(each.groupBy("source", "id").agg(F.sum("share").alias("share")), ["source", "id"], "left")
            now = now.select("source", "id", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("part"))
        below = checkpointed(now)
        own = below.groupBy("id").agg(F.sum("part").alias("part"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return levels[0].select("id", F.lit(0.0).alias("part")) if levels else e.select("id", F.lit(0.0).alias("part")).limit(0)
    return checkpointed(out.groupBy("id").agg(F.sum("part").alias("part")))


def source_dependencies(start: np.ndarray, to: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What some sources depend on each node for, of links in CSR form: breadth first for counts of shortest paths, and back."""
    n, k = len(start) - 1, len(sources)
    root = np.arange(k) * n + sources
    paths, depth, spot = np.zeros(k * n), np.full(k * n, -1, np.int32), np.zeros(k * n, np.int64)
    paths[root], depth[root] = 1, 0
    front, levels = root, []
    while len(front):
        node = front % n
        size = start[node + 1] - start[node]
        up = np.repeat(front, size)
        at = np.arange(len(up)) - np.repeat(np.cumsum(size) - size - start[node], size)
        down = up - np.repeat(node, size) + to[at]
        new = depth[down] < 0
        up, down = up[new], down[new]
        np.add.at(paths, down, paths[up])
        depth[down] = len(levels) + 1
        spot[down] = np.arange(len(down))
        front = down[spot[down] == np.arange(len(down))]  # each once
        levels.append((up, down))
    part = np.zeros(k * n)
    for up, down in reversed(levels):
        np.add.at(part, up, paths[up] / paths[down] * (1 + part[down]))
    part[root] = 0
    return part.reshape(k, n).sum(axis=0)


def _walked(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """id, part: dependencies() of all sources, dealt to tasks that walk some at a time; the links are broadcast, their size was checked."""
    spark = sources.sparkSession
    e = edges.select("src", "dst").toArrow()
    src, dst = (e.column(c).to_numpy() for c in ("src", "dst"))
    ids, place = np.unique(np.concatenate((src, dst)), return_inverse=True)
    order = np.lexsort((place[len(src) :], place[: len(src)]))
    start = np.searchsorted(place[: len(src)][order], np.arange(len(ids) + 1))
    shared = spark.sparkContext.broadcast((ids, start, place[len(src) :][order].astype(np.int32)))  # LINK bytes a link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, start, to = shared.value
        total, step = np.zeros(len(ids)), max(1, WALKED // max(1, len(ids), len(to)))
        for b in batches:
            own = b.column(0).to_numpy()
            at = np.searchsorted(ids, own)
            at = at[ids[np.minimum(at, len(ids) - 1)] == own] if len(ids) else at[:0]  # others have no links
            for i in range(0, len(at), step):
                total += source_dependencies(start, to, at[i : i + step])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(total[met])], ["id", "part"])

    dealt = sources.repartition(4 * spark.sparkContext.defaultParallelism, "id")
    return dealt.mapInArrow(run, "id long, part double").groupBy("id").agg(F.sum("part").alias("part"))


def betweenness(edges: DataFrame, nodes: DataFrame, share: float = 1.0) -> DataFrame:
    """id, betweenness: directed, over ordered pairs, divided by (n - 1)(n - 2), from counts of shortest paths level by level.

    Links and nodes of at most LINK_BYTES are broadcast and the sources dealt to tasks, which walk a bounded number at a time; a
    task sends one row a node. Of more links, sources go in batches whose states (a source and a node it reaches) are at most STATES, each by as many rounds of
    joins as the graph is deep, forward for counts and back for dependencies. share below 1 takes sources by a hash of
    their id and scales up, as an estimate for graphs where every source is too much.
    """
    own = nodes.select(F.col("id").cast("long").alias("id")).distinct()
    n = own.count()
    chosen = own if share >= 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sources = chosen.count()
    links = checkpointed(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null").distinct())
    if links.count() * LINK + n * NODE <= LINK_BYTES:
        return _scaled(own, _walked(links, chosen), n, sources)
    batches = max(1, -(-sources * n // STATES))
    total = None
    for i in range(batches):
        batch = chosen.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(batches)) == i)
        part = dependencies(links, path_counts(links, batch))
        total = part if total is None else checkpointed(total.unionByName(part).groupBy("id").agg(F.sum("part").alias("part")))
    return _scaled(own, total, n, sources)


def _scaled(own: DataFrame, total: DataFrame, n: int, sources: int) -> DataFrame:
    scale = n / max(1, sources) / max(1, (n - 1) * (n - 2))
    return own.join(total, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def symmetric(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def mutual(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable over edges taken in both directions; least-label rounds with shortcuts."""
    e = checkpointed(symmetric(edges))
    now = nodes.select("id", F.col("id").alias("component"))
    while True:
        around = e.join(now.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        low = now.join(around, "id", "left").select("id", "component", F.least("component", "m").alias("low"))
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        new = checkpointed(low.join(jump, "low").select("id", F.least("low", "lower").alias("new"), "component"))
        if new.where("new <> component").isEmpty():
            return now
        now = new.select("id", F.col("new").alias("component"))


def adjacency_truncated(edges: DataFrame, most: int) -> DataFrame:
    """The `most` nearest out-links of each node (edges with dist), pos from 0."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("src").orderBy("dist", "dst")
    return edges.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < most)

"""Searches, traces and what is read from them over the exact neighbour graph, which SQL can build and search as well.

The queries of the catalog on built indexes have no SQL form; these run the same operators on symmetric exact neighbour
lists in order of distance, from the medoid, beside a recursive query that follows the rules of best-first search.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, knn, refine, search, traces
from ..operators.vectors import medoid
from ..sources import results
from .catalog import _TRUTH, ORACLES, _asked, _linked, _rounded, _seeds, _walk_sql, query
from .iterate import checkpointed, new_path

# SQL: the walk's tables without its turns, then lists and distances by place in ascending order of ids

_TABLES = (
    _walk_sql(0).split(", w0 AS")[0].replace("v AS", "RECURSIVE v AS", 1)
    + ", ix AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM v), st AS (SELECT i AS en FROM ix JOIN en USING (vec_id)), "
    "adj AS MATERIALIZED (SELECT a.i AS node, list(b.i ORDER BY s2.pos) AS l FROM s2 JOIN ix a ON a.vec_id = s2.src JOIN ix b ON b.vec_id = s2.dst GROUP BY 1), "
    "dq AS MATERIALIZED (SELECT src AS q_id, list(dist ORDER BY dst) AS dd FROM p GROUP BY 1)"
)


def _beam_sql(name: str, asked: str) -> str:
    """{name}: a row for each expanded node; {name}_end: the last row of each search. asked: (q_id, ef, s, t), s to t is not followed."""
    fresh = f"list_transform(list_filter(adj.l, lambda x: NOT list_contains(z.seen, x) AND NOT (adj.node = z.s AND x = z.t)), lambda x: {{'i': x, 'd': dd[x]}})"
    takes = "len(list_filter(top, lambda u: u.d <= fr[j].d)) + len(list_filter(fr[1:j-1], lambda u: u.d <= fr[j].d)) < ef"
    new = "list_filter(ev, lambda x: x.a)"
    return (
        f"{name} AS (SELECT q_id, ef, s, t, 0 AS step, 0::BIGINT AS node, [{{'d': dd[en], 'i': en}}] AS top, [{{'d': dd[en], 'm': -en}}] AS open, [en] AS seen, []::STRUCT(i BIGINT, d DOUBLE, a BOOLEAN)[] AS ev FROM ({asked}) JOIN dq USING (q_id), st "
        f"UNION ALL SELECT q_id, ef, s, t, step + 1, node, list_sort(top || list_transform({new}, lambda x: {{'d': x.d, 'i': x.i}}))[1:ef], list_sort(open[2:] || list_transform({new}, lambda x: {{'d': x.d, 'm': -x.i}})), seen || list_transform(ev, lambda x: x.i), ev "
        f"FROM (SELECT *, list_transform(range(1, len(fr) + 1), lambda j: {{'i': fr[j].i, 'd': fr[j].d, 'a': {takes}}}) AS ev FROM (SELECT z.*, adj.node AS here, {fresh} AS fr FROM {name} z JOIN dq USING (q_id) JOIN adj ON adj.node = -z.open[1].m "
        "WHERE len(z.open) > 0 AND NOT (z.open[1].d > z.top[-1].d AND len(z.top) = z.ef))) AS o(q_id, ef, s, t, step, was, top, open, seen, old, node, fr, ev)), "
        f"{name}_end AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, ef, s, t ORDER BY step DESC) AS back FROM {name}) WHERE back = 1)"
    )


def _queries_sql(ef: str) -> str:
    return f"SELECT vec_id AS q_id, ef, -1 AS s, -1 AS t FROM v, (SELECT unnest([{ef}]) AS ef) WHERE vec_id % 50 = 0"


def _found_sql(rel: str, kept: str = "true") -> str:
    """q_id, ef, rank, b_id, dist, evaluations of a search's last rows."""
    return (
        f"SELECT q_id, ef, row_number() OVER (PARTITION BY q_id, ef, s, t ORDER BY dist, b_id)::INTEGER AS rank, b_id, dist, evaluations, s, t FROM "
        f"(SELECT q_id, ef, s, t, ix.vec_id AS b_id, o.d AS dist, n AS evaluations FROM (SELECT q_id, ef, s, t, unnest(top) AS o, len(seen)::BIGINT AS n FROM {rel}_end) JOIN ix ON ix.i = o.i) WHERE {kept}"
    )


def _trace_sql(rel: str) -> str:
    """q_id, seq, src, dst, dist, adopted: the links by which nodes were first met."""
    return (
        f"SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY step, j) - 1)::INTEGER AS seq, a.vec_id AS src, b.vec_id AS dst, e.d AS dist, e.a::INTEGER AS adopted "
        f"FROM (SELECT q_id, step, node, unnest(ev) AS e, unnest(range(1, len(ev) + 1)) AS j FROM {rel}) JOIN ix a ON a.i = node JOIN ix b ON b.i = e.i"
    )


def _searched(ef: str) -> str:
    return f"{_TABLES}, {_beam_sql('b', _queries_sql(ef))}"


def _traced_sql(ef: int) -> str:
    return f"{_searched(str(ef))}, tr AS MATERIALIZED ({_trace_sql('b')})"


# the same in Spark


def _opened(spark, sf):
    base, edges = _linked(spark, sf)
    entry = medoid(base).select(F.col("vec_id").alias("id"), F.lit(True).alias("is_entry"))
    nodes = base.select(F.col("vec_id").alias("id"), F.lit(0).alias("level")).join(entry, "id", "left").fillna(False, ["is_entry"])
    edges = edges.withColumn("level", F.lit(0))
    return base, edges, search.opened(edges, nodes, base)


def _grown(spark, sf, found: bool = False):
    """(edges, trees marked by the ten nearest that a search found, or by the true nearest vector)."""
    base, edges, g = _opened(spark, sf)
    nearest = knn.exact(base, _asked(base), 1).select("q_id", F.col("b_id").alias("target"))
    return edges, checkpointed(traces.marked(search.trees(g, _asked(base), 16), 10, None if found else nearest))


@query(f"WITH {_searched('64')} SELECT q_id, rank, b_id, round(dist, 6) AS dist, evaluations FROM ({_found_sql('b')}) WHERE rank <= 10")
def graph_search(spark, sf):
    base, _, g = _opened(spark, sf)
    return _rounded(search.knn_search(g, _asked(base), 10, 64), "dist")


@query(f"WITH {_searched('64')} SELECT q_id, rank, b_id, round(dist, 6) AS dist, evaluations FROM ({_found_sql('b', 'b_id <> q_id')}) WHERE rank <= 10")
def graph_search_self_excluded(spark, sf):
    base, _, g = _opened(spark, sf)
    return _rounded(search.knn_search(g, _asked(base), 10, 64, exclude_self=True), "dist")


@query(f"WITH {_traced_sql(32)} SELECT q_id, seq, src, dst, round(dist, 6) AS dist, adopted FROM tr")
def graph_trace(spark, sf):
    base, _, g = _opened(spark, sf)
    return _rounded(search.traces(g, _asked(base), 32), "dist").select("q_id", "seq", "src", "dst", "dist", "adopted")


_SEEDED = "SELECT vec_id AS q_id, 32 AS ef, -1 AS s, -1 AS t FROM (SELECT vec_id FROM embeddings ORDER BY (vec_id::HUGEINT * 2654435761) % 4294967296, vec_id LIMIT (SELECT greatest(1, floor(0.2 * count(*) + 0.5))::BIGINT FROM embeddings))"
_STATS = f"{_TABLES}, {_beam_sql('b', _SEEDED)}, tr AS MATERIALIZED ({_trace_sql('b')}), es AS MATERIALIZED (SELECT s2.src, s2.pos, s2.dst, coalesce(count_if(adopted = 1), 0) AS adopted, coalesce(count_if(adopted = 0), 0) AS discarded FROM s2 LEFT JOIN tr USING (src, dst) GROUP BY 1, 2, 3)"


def _seed_stats(spark, sf):
    base, edges, g = _opened(spark, sf)
    return search.aligned(edges, search.edge_statistics(search.traces(g, _seeds(base, refine.FAMILY["nsg"].seed_share), 32), level_scope=1))


@query(f"WITH {_STATS} SELECT src, pos, dst, adopted::BIGINT AS adopted, discarded::BIGINT AS discarded FROM es")
def graph_edge_stats(spark, sf):
    return _seed_stats(spark, sf).select("src", "pos", "dst", "adopted", "discarded")


@query(
    f"WITH {_STATS}, ca AS (SELECT *, row_number() OVER (ORDER BY discarded::DOUBLE / adopted DESC, adopted + discarded DESC, discarded DESC, src, dst) AS rank FROM es WHERE adopted > 0), "
    "o AS (SELECT *, row_number() OVER (ORDER BY rank) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rank) AS own FROM ca) WHERE own = 1), "
    "ph AS (SELECT src, pos, dst, 0 AS phase, rank AS place FROM o WHERE turn <= greatest(1, ceil((SELECT count(*) FROM ca) * 0.02)) UNION ALL SELECT src, pos, dst, 1, pos FROM es WHERE adopted = 0 AND discarded > 0) "
    "SELECT src, pos, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY phase, place, dst) AS n FROM ph) WHERE n <= 2"
)
def graph_prune_select(spark, sf):
    """What a pruning round at the family's ratio takes, by the traces of the family's seeds."""
    return refine.prune_selected(checkpointed(_seed_stats(spark, sf)), 0.02).select("src", "pos", "dst")


@query(f"WITH {_traced_sql(32)} SELECT src, dst, count(DISTINCT q_id)::BIGINT AS seeds FROM tr WHERE adopted = 1 GROUP BY 1, 2")
def graph_edge_seeds(spark, sf):
    base, _, g = _opened(spark, sf)
    return search.edge_seeds(search.traces(g, _asked(base), 32)).groupBy("src", "dst").agg(F.count("*").alias("seeds"))


@query(f"WITH {_traced_sql(32)}, e AS (SELECT q_id, sum(adopted) AS a, count(*) AS n FROM tr GROUP BY 1) SELECT round(avg(n), 6) AS evaluations, round(avg(a / n), 6) AS acer, round(sum((a + 1) / ((n + 1) * (n + 1))), 6) AS acer_hcnng FROM e")
def graph_cost(spark, sf):
    base, _, g = _opened(spark, sf)
    return _rounded(search.cost(search.traces(g, _asked(base), 32)), "evaluations", "acer", "acer_hcnng")


def _recalls_sql(efs: str) -> str:
    return (
        f"{_searched(efs)}, {_TRUTH}, fo AS ({_found_sql('b')}), h AS (SELECT fo.q_id, ef, count(x.b_id) AS h, max(evaluations) AS e FROM fo LEFT JOIN x ON x.q_id = fo.q_id AND x.b_id = fo.b_id WHERE fo.rank <= 10 GROUP BY 1, 2), "
        "rc AS MATERIALIZED (SELECT ef, sum(h) / (10.0::DOUBLE * (SELECT count(DISTINCT q_id) FROM x)) AS recall, avg(e) AS evaluations FROM h GROUP BY 1)"
    )


@query(f"WITH {_recalls_sql('10, 60, 110, 160')} SELECT 10 AS k, ef, round(recall, 6) AS recall, round(evaluations, 6) AS evaluations FROM rc WHERE ef <= coalesce((SELECT min(ef) FROM rc WHERE recall > 0.995), 160)")
def graph_recall_sweep(spark, sf):
    base, _, g = _opened(spark, sf)
    truth = checkpointed(knn.exact(base, _asked(base), 10))
    return _rounded(spark.createDataFrame(refine.sweep(g, _asked(base), truth, 10, range(10, 161, 50), 0.995), "k int, ef int, recall double, evaluations double"), "recall", "evaluations")


# a sweep's recalls and costs as the points of a frontier; the speed is how many queries a million comparisons allow

_SPEEDS = f"{_recalls_sql('10, 20, 40, 80, 160')}, pt AS (SELECT 10 AS k, recall, 1000000 / evaluations AS qps FROM rc), fr AS MATERIALIZED (SELECT k, recall, qps FROM (SELECT *, max(qps) OVER (ORDER BY recall DESC, qps DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pt) WHERE best IS NULL OR qps > best)"


def _speeds(spark, sf):
    base, _, g = _opened(spark, sf)
    truth = checkpointed(knn.exact(base, _asked(base), 10))
    rows = refine.sweep(g, _asked(base), truth, 10, [10, 20, 40, 80, 160])
    return spark.createDataFrame([(r["k"], r["recall"], 1e6 / r["evaluations"]) for r in rows], "k int, recall double, qps double")


@query(f"WITH {_SPEEDS} SELECT k, round(recall, 6) AS recall, round(qps, 6) AS qps FROM fr")
def graph_frontier(spark, sf):
    return _rounded(evaluate.frontier(_speeds(spark, sf)), "recall", "qps")


@query(
    f"WITH {_SPEEDS}, nx AS (SELECT *, coalesce(lead(recall) OVER o, recall) AS r1, coalesce(lead(qps) OVER o, qps) AS q1 FROM fr WINDOW o AS (ORDER BY recall, qps)) "
    f"SELECT k, level, round(coalesce(max(CASE WHEN level >= recall AND level <= r1 THEN CASE WHEN r1 = recall THEN qps ELSE qps + (q1 - qps) * (level - recall) / (r1 - recall) END END), 0), 6) AS qps FROM nx, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in evaluate.LEVELS)}]) AS level) GROUP BY 1, 2"
)
def graph_speed_at_recall(spark, sf):
    return _rounded(evaluate.at_recalls(evaluate.frontier(_speeds(spark, sf), ["k"]), ["k"]), "qps")


_TUNED = "co AS (SELECT coalesce(min(ef), 200) AS c FROM rc WHERE ef IN (10, 50, 90, 130, 170) AND recall >= 0.9), pick AS (SELECT coalesce(min(ef), (SELECT c FROM co)) AS ef FROM rc WHERE recall >= 0.9 AND ef > (SELECT c FROM co) - 40 AND ef < (SELECT c FROM co) AND (SELECT c FROM co) IN (50, 90, 130, 170))"


@query(f"WITH {_recalls_sql(', '.join(map(str, range(10, 201, 10))))}, {_TUNED} SELECT ef::INTEGER AS ef, round(recall, 6) AS recall, round(evaluations, 6) AS evaluations FROM rc JOIN pick USING (ef)")
def graph_ef_tune(spark, sf):
    base, _, g = _opened(spark, sf)
    truth = checkpointed(knn.exact(base, _asked(base), 10))
    ef = refine.tuned_ef(g, _asked(base), truth, 10, 0.9, 10, 40, 10, 200)
    return _rounded(spark.createDataFrame([(ef, *refine.recall_at(g, _asked(base), truth, 10, ef))], "ef int, recall double, evaluations double"), "recall", "evaluations")


_OFF = "SELECT DISTINCT q_id, 16 AS ef, a.i AS s, b.i AS t FROM tr JOIN ix a ON a.vec_id = src JOIN ix b ON b.vec_id = dst WHERE adopted = 1"
_HITS = "SELECT fo.q_id, fo.s, fo.t, max(evaluations) AS e, count(y.b_id) / 10.0::DOUBLE AS r FROM ({}) fo LEFT JOIN y ON y.q_id = fo.q_id AND y.b_id = fo.b_id WHERE fo.rank <= 10 GROUP BY 1, 2, 3"


@query(
    f"WITH {_traced_sql(16)}, {_beam_sql('w', _OFF)}, y AS MATERIALIZED (SELECT q_id, b_id FROM (SELECT v.vec_id AS q_id, p.dst AS b_id, row_number() OVER (PARTITION BY v.vec_id ORDER BY p.dist, p.dst) AS r FROM v JOIN p ON p.src = v.vec_id WHERE v.vec_id % 50 = 0 AND p.src <> p.dst) WHERE r <= 10), "
    f"h0 AS ({_HITS.format(_found_sql('b', 'b_id <> q_id'))}), h1 AS ({_HITS.format(_found_sql('w', 'b_id <> q_id'))}) "
    "SELECT a.vec_id AS src, b.vec_id AS dst, count(*)::BIGINT AS seeds, round(avg(h0.e - h1.e), 6) AS comparison_diff, round(avg(h0.r - h1.r), 6) AS recall_diff FROM h1 JOIN h0 USING (q_id) JOIN ix a ON a.i = h1.s JOIN ix b ON b.i = h1.t GROUP BY 1, 2"
)
def graph_edge_impact(spark, sf):
    base, _, g = _opened(spark, sf)
    impact = refine.edge_impact(g, search.edge_seeds(search.traces(g, _asked(base), 16)), base, knn.exact(base, _asked(base), 11), 10, 16)
    return _rounded(impact, "comparison_diff", "recall_diff").select("src", "dst", "seeds", "comparison_diff", "recall_diff")


_IMPACTS = ORACLES["graph_edge_impact"].replace("round(avg(h0.e - h1.e), 6) AS comparison_diff, round(avg(h0.r - h1.r), 6) AS recall_diff", "abs(avg((h0.e - h1.e) / h0.e)) AS x").rpartition(" SELECT a.vec_id")


@query(
    f"{_IMPACTS[0]}, im AS (SELECT a.vec_id{_IMPACTS[2]}) SELECT round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(max(x), 6) AS max, "
    "count_if(x > 0.01)::BIGINT AS over_1, count_if(x > 0.015)::BIGINT AS over_1_5, count_if(x > 0.02)::BIGINT AS over_2, count_if(x > 0.05)::BIGINT AS over_5 FROM im"
)
def graph_impact_counts(spark, sf):
    """How many edges change a search by over so many percent when they are not followed."""
    base, _, g = _opened(spark, sf)
    impact = refine.edge_impact(g, search.edge_seeds(search.traces(g, _asked(base), 16)), base, knn.exact(base, _asked(base), 11), 10, 16)
    return _rounded(refine.impact_summary(impact), "mean", "median", "max")


@query(f"WITH {_traced_sql(16)} SELECT DISTINCT src, dst FROM tr WHERE adopted = 1 AND (((src * 1000003 + dst)::HUGEINT * 2654435761) % 4294967296) < 858993459")
def graph_edge_sample(spark, sf):
    """A keyed fifth of the edges that searches adopted."""
    base, _, g = _opened(spark, sf)
    met = search.edge_seeds(search.traces(g, _asked(base), 16)).select("src", "dst").distinct()
    return refine.sampled_edges(met, 0.2)


# trees of traces: adopted nodes, marked 1 among the ten nearest found, or 2 if the nearest found is the nearest of all

_ENDS = "pl AS MATERIALIZED (SELECT q_id, ix.vec_id AS node, row_number() OVER (PARTITION BY q_id ORDER BY o.d, o.i) AS place, n AS evaluations FROM (SELECT q_id, unnest(top) AS o, len(seen)::BIGINT AS n FROM b_end) JOIN ix ON ix.i = o.i)"
_NEAREST = "ne AS MATERIALIZED (SELECT v.vec_id AS q_id, arg_min(p.dst, {'d': p.dist, 'i': p.dst}) AS target FROM v JOIN p ON p.src = v.vec_id WHERE v.vec_id % 50 = 0 GROUP BY 1)"
_TREE = (
    f"{_traced_sql(16)}, {_ENDS}, {_NEAREST}, nd AS MATERIALIZED (SELECT a.*, coalesce((place <= 10)::INTEGER, 0) AS top, CASE WHEN place = 1 AND a.node = target THEN 2 ELSE 0 END AS hit FROM "
    "(SELECT q_id, dst AS node, src AS parent, dist, seq FROM tr WHERE adopted = 1 UNION ALL SELECT vec_id, (SELECT ix.vec_id FROM st JOIN ix ON ix.i = st.en), NULL, (SELECT dd[en] FROM dq, st WHERE dq.q_id = v.vec_id), -1 FROM v WHERE vec_id % 50 = 0) a "
    "LEFT JOIN pl ON pl.q_id = a.q_id AND pl.node = a.node JOIN ne ON ne.q_id = a.q_id)"
)
_PATHS = f"{_TREE}, mp AS (SELECT q_id, 0 AS up, node, parent FROM nd WHERE hit = 2 UNION ALL SELECT nd.q_id, up + 1, nd.node, nd.parent FROM mp JOIN nd ON nd.q_id = mp.q_id AND nd.node = mp.parent)"


@query(f"WITH {_TREE} SELECT q_id, count(*)::BIGINT AS nodes, count_if(node NOT IN (SELECT parent FROM nd i WHERE i.q_id = nd.q_id AND parent IS NOT NULL))::BIGINT AS leaves FROM nd GROUP BY 1")
def graph_tree_sizes(spark, sf):
    return traces.sizes(_grown(spark, sf)[1])


@query(f"WITH {_TREE} SELECT q_id, node, parent, round(dist, 6) AS dist, top AS chosen FROM nd")
def graph_tree_found(spark, sf):
    """Trees marked by what each search found, roots with their distance."""
    return _rounded(_grown(spark, sf, found=True)[1].select("q_id", "node", "parent", "dist", "chosen"), "dist")


@query(f"WITH {_TREE} SELECT q_id, node, parent, hit AS chosen FROM nd WHERE hit > 0 OR parent IS NULL")
def graph_tree_targets(spark, sf):
    """Roots, and the nodes at which searches found their target."""
    return _grown(spark, sf)[1].where("chosen > 0 or parent is null").select("q_id", "node", "parent", "chosen")


@query(f"WITH {_TREE} SELECT q_id, count(*)::BIGINT AS held, max(evaluations) AS evaluations, round(count(*) / max(evaluations), 6) AS ecr FROM pl GROUP BY 1")
def graph_tree_ratios(spark, sf):
    return _rounded(traces.ratios(_grown(spark, sf)[1]), "ecr").drop("shard")


@query(f"WITH {_PATHS} SELECT q_id, up, node FROM mp")
def graph_main_paths(spark, sf):
    return traces.main_paths(_grown(spark, sf)[1])


@query(f"WITH {_PATHS} SELECT parent AS src, node AS dst, count(*)::BIGINT AS visits FROM mp WHERE parent IS NOT NULL GROUP BY 1, 2")
def graph_path_edge_visits(spark, sf):
    return traces.edge_visits(traces.main_paths(_grown(spark, sf)[1]))


_INNER = f"{_TREE}, inn AS (SELECT DISTINCT q_id, parent AS node FROM nd WHERE parent IS NOT NULL)"


@query(f"WITH {_INNER} SELECT parent AS src, node AS dst, count(*)::BIGINT AS visits FROM nd JOIN inn USING (q_id, node) WHERE parent IS NOT NULL GROUP BY 1, 2")
def graph_inner_visits(spark, sf):
    return traces.inner_visits(_grown(spark, sf)[1])[1]


@query(f"WITH {_INNER} SELECT node, count(*)::BIGINT AS visits FROM nd JOIN inn USING (q_id, node) GROUP BY 1")
def graph_inner_nodes(spark, sf):
    return traces.inner_visits(_grown(spark, sf)[1])[0]


@query(
    f"WITH {_PATHS}, vi AS (SELECT node, count(*) AS n FROM mp GROUP BY 1), lo AS (SELECT q_id FROM mp GROUP BY 1 HAVING count(*) > 3), ra AS (SELECT mp.q_id, arg_max(node, up) AS src FROM mp JOIN lo USING (q_id) JOIN vi USING (node) WHERE n < 2 AND up > 1 GROUP BY 1) "
    "SELECT DISTINCT src, node AS dst FROM ra JOIN mp USING (q_id) WHERE up = 0"
)
def graph_shortcuts(spark, sf):
    return traces.shortcuts(traces.main_paths(_grown(spark, sf)[1]), longest=3)


@query(f"WITH {_TREE}, nn AS (SELECT q_id, node, (row_number() OVER (PARTITION BY q_id ORDER BY dist, node) - 1)::INTEGER AS i FROM nd) SELECT a.q_id, s2.src, s2.dst, a.i, b.i AS j FROM nn a JOIN s2 ON s2.src = a.node JOIN nn b ON b.q_id = a.q_id AND b.node = s2.dst WHERE a.i < 10 AND b.i < 10")
def graph_local_matrix(spark, sf):
    edges, t = _grown(spark, sf)
    return traces.local_matrix(t, edges).select("q_id", "src", "dst", "i", "j")


_PREORDER = (
    f"{_TREE}, deep AS (SELECT q_id, node, parent, 0 AS depth, [seq] AS way, top AS chosen, dist FROM nd WHERE parent IS NULL "
    "UNION ALL SELECT nd.q_id, nd.node, nd.parent, depth + 1, way || [nd.seq], nd.top, nd.dist FROM deep JOIN nd ON nd.q_id = deep.q_id AND nd.parent = deep.node), "
    'pre AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY q_id ORDER BY way) - 1)::INTEGER AS "at" FROM deep)'
)


@query(f"WITH {_PREORDER} SELECT q_id, \"at\", node, parent, depth, chosen, round(dist, 6) AS dist FROM pre")
def graph_tree_preorder(spark, sf):
    return _rounded(traces.preorder(_grown(spark, sf, found=True)[1]).drop("shard"), "dist")


@query(f"WITH {_PREORDER} SELECT dense_rank() OVER (ORDER BY q_id) - 1 AS tree, \"at\", node, parent, depth, chosen, round(dist, 3) AS dist FROM pre")
def file_trace_trees(spark, sf):
    path = new_path(spark, "trees")
    results.write_trees(traces.preorder(_grown(spark, sf, found=True)[1]), path)
    return results.read_trees(spark, path).withColumn("dist", F.round("dist", 3))


@query(
    f"WITH {_PREORDER} SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY \"at\") - 1)::INTEGER AS \"at\", (row_number() OVER (PARTITION BY q_id ORDER BY \"at\") - 1)::INTEGER AS counted, round(dist, 6) AS dist, "
    "repeat('  ', depth) || 'Node ID: ' || node || ' (Depth: ' || depth || ',chosen' || chosen || ')' AS line FROM pre WHERE depth <= 2"
)
def graph_tree_lines(spark, sf):
    """Trees as text, two links deep; distances and counts are read back from the lines as numbers."""
    number = lambda pattern: F.regexp_extract("line", pattern, 1)
    lines = traces.printed(_grown(spark, sf, found=True)[1], 2)
    plain = F.regexp_replace("line", ", Distance: [^,]*|,count[0-9]+", "")
    return lines.select("q_id", "at", number(",count([0-9]+)").cast("int").alias("counted"), F.round(number(", Distance: ([0-9.]+)").cast("double"), 6).alias("dist"), plain.alias("line"))

"""The named queries over the driver's tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import build, clusters, evaluate, ivf, knn, network, refine, search, textsets, traces, vectors, walk
from ..sources import results, vecfiles
from .iterate import checkpointed, new_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# the tables as the operators take them


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _asked(base: DataFrame) -> DataFrame:
    """The stated query set of all searches."""
    return base.where("vec_id % 50 = 0")


def _seeds(base: DataFrame, share: float) -> DataFrame:
    """The vectors whose searches refinement learns from."""
    return base.join(vectors.seeds(base, share), "vec_id", "left_semi")


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, edges of the exact 10-nearest-neighbour graph, nodes)."""
    base = _base(spark, sf)
    return base, checkpointed(knn.graph(base, 10)), base.select(F.col("vec_id").alias("id"))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# SQL parts

V = "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def _sum(term: str, n: str) -> str:
    return f"list_sum(list_transform(range(1, len({n}) + 1), lambda i: {term}))"


def d2(a: str, b: str) -> str:
    return _sum(f"({a}[i] - {b}[i]) * ({a}[i] - {b}[i])", a)


def dot(a: str, b: str) -> str:
    return _sum(f"{a}[i] * {b}[i]", a)


def near(metric: str, k: int, where: str = "true") -> str:
    return (
        f"SELECT q_id, rank, b_id, dist FROM (SELECT q.vec_id AS q_id, b.vec_id AS b_id, {metric} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {metric}, b.vec_id)::INTEGER AS rank "
        f"FROM v q, v b WHERE q.vec_id % 50 = 0 AND {where}) WHERE rank <= {k}"
    )


ALL = f"p AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst, {d2('a.e', 'b.e')} AS dist FROM v a, v b)"
GRAPH = f"{V}, {ALL}, g AS MATERIALIZED (SELECT src, dst, dist, pos FROM (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INTEGER AS pos FROM p WHERE src <> dst) WHERE pos < 10)"


# exact neighbours


def _knn_query(name: str, metric: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        base = _base(spark, sf)
        return _rounded(knn.exact(base, _asked(base), 10, metric), "dist").select("q_id", "rank", "b_id", "dist")

    run.__name__ = name
    query(f"WITH {V} SELECT q_id, rank, b_id, round(dist, 6) AS dist FROM ({near(sql, 10)})")(run)


_COS = f"{dot('q.e', 'b.e')} / sqrt({dot('q.e', 'q.e')} * {dot('b.e', 'b.e')})"
_knn_query("knn_l2", "squared_l2", d2("q.e", "b.e"))
_knn_query("knn_ip", "ip", f"-{dot('q.e', 'b.e')}")
_knn_query("knn_cosine", "cosine", f"-({_COS})")
_knn_query("knn_angular", "angular", f"1 - {_COS}")
_knn_query("knn_l1", "l1", _sum("abs(q.e[i] - b.e[i])", "q.e"))
_knn_query("knn_hamming_bits", "hamming", _sum("CASE WHEN (q.e[i] > 0) <> (b.e[i] > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "q.e") + " / len(q.e)")


@query(f"WITH {V} SELECT q_id, rank, b_id, round(dist, 6) AS dist FROM ({near(d2('q.e', 'b.e'), 10, 'q.label = b.label')})")
def knn_filtered_label(spark, sf):
    base = _base(spark, sf)
    return _rounded(knn.filtered(base, _asked(base), "label", 10), "dist").select("q_id", "rank", "b_id", "dist")


@query(f"WITH {V} SELECT q.vec_id AS q_id, b.vec_id AS b_id, round({d2('q.e', 'b.e')}, 6) AS dist FROM v q, v b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id AND {d2('q.e', 'b.e')} < 1.4")
def range_search(spark, sf):
    base = _base(spark, sf)
    return _rounded(knn.within(base, _asked(base), 1.4, exclude_self=True), "dist")


@query(f"WITH {V} SELECT q.vec_id AS q_id, count_if(q.vec_id <> b.vec_id AND {d2('q.e', 'b.e')} < 1.4)::BIGINT AS neighbours FROM v q, v b WHERE q.vec_id % 50 = 0 GROUP BY 1")
def range_counts(spark, sf):
    base = _base(spark, sf)
    found = knn.within(base, _asked(base), 1.4, exclude_self=True).groupBy("q_id").agg(F.count("*").alias("neighbours"))
    return _asked(base).select(F.col("vec_id").alias("q_id")).join(found, "q_id", "left").fillna(0)


SETS = "s AS (SELECT l_orderkey AS id, l_partkey AS item FROM lineitem GROUP BY 1, 2), z AS (SELECT id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5), m AS (SELECT s.* FROM s JOIN z USING (id))"


def _baskets(spark, sf):
    return textsets.item_sets(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", 5)


@query(
    f"WITH {SETS}, pairs AS (SELECT q.id AS q_id, b.id AS b_id, count(*) AS c FROM m q JOIN m b USING (item) WHERE q.id % 50 = 0 GROUP BY 1, 2), "
    "d AS (SELECT q_id, b_id, 1 - c::DOUBLE / (x.n + y.n - c) AS dist FROM pairs JOIN z x ON x.id = q_id JOIN z y ON y.id = b_id) "
    "SELECT q_id, rank, b_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id)::INTEGER AS rank FROM d WHERE dist < 1 - 1e-5) WHERE rank <= 5"
)
def knn_jaccard_baskets(spark, sf):
    sets = _baskets(spark, sf)
    return _rounded(knn.jaccard(sets, sets.where("id % 50 = 0"), 5), "dist").select("q_id", "rank", "b_id", "dist")


@query(f"WITH {SETS} SELECT id, count(*)::BIGINT AS items, min(item)::BIGINT AS least, max(item)::BIGINT AS most FROM m GROUP BY id")
def basket_sets(spark, sf):
    return _baskets(spark, sf).select("id", F.size("items").cast("long").alias("items"), F.array_min("items").alias("least"), F.array_max("items").alias("most"))


@query("SELECT o_custkey AS id, count(DISTINCT l_partkey)::BIGINT AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 3 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 20")
def user_item_sets(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_quantity >= 3").select("l_orderkey", "l_partkey")
    rows = rows.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return textsets.item_sets(rows, "o_custkey", "l_partkey", 20).select("id", F.size("items").cast("long").alias("items"))


TERMS = "t AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\n\\t\\r]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM t)"
TFIDF = f"{TERMS}, r AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN df USING (term), n), l AS (SELECT id, sqrt(sum(w * w)) AS len FROM r GROUP BY 1), w AS (SELECT id, term, w / len AS weight FROM r JOIN l USING (id))"


@query(f"WITH {TFIDF} SELECT id, count(*)::BIGINT AS terms, round(max(weight), 6) AS top, round(sum(weight), 4) AS total FROM w GROUP BY 1")
def tfidf_terms(spark, sf):
    w = textsets.tfidf(textsets.terms(table(spark, sf, "documents")))
    return w.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top"), F.round(F.sum("weight"), 4).alias("total"))


@query(
    f"WITH {TFIDF}, d AS (SELECT q.id AS q_id, b.id AS b_id, -round(sum(q.weight * b.weight), 8) AS dist FROM w q JOIN w b USING (term) WHERE q.id % 50 = 0 GROUP BY 1, 2) "
    "SELECT q_id, rank, b_id, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id)::INTEGER AS rank FROM d) WHERE rank <= 10"
)
def sparse_ip_topk(spark, sf):
    w = checkpointed(textsets.tfidf_texts(table(spark, sf, "documents")))  # read for the queries and for the base
    found = knn.sparse_ip(w, w.where("id % 50 = 0"), 10, places=8)
    return _rounded(found, "dist", places=5).select("q_id", "rank", "b_id", "dist")


@query(
    f"WITH {TERMS}, l AS (SELECT id, sum(tf) AS len FROM t GROUP BY 1), a AS (SELECT avg(len) AS avg, count(*) AS n FROM l), "
    "w AS (SELECT id, term, tf * 101.0::DOUBLE / (100.0::DOUBLE * (0.2::DOUBLE + 0.8::DOUBLE * len / avg) + tf) * ln(a.n / (1 + df)) AS weight FROM t JOIN df USING (term) JOIN l USING (id), a) "
    "SELECT id, round(sum(weight), 4) AS total FROM w GROUP BY 1"
)
def bm25_weights(spark, sf):
    w = textsets.bm25_texts(table(spark, sf, "documents"))
    return w.groupBy("id").agg(F.round(F.sum("weight"), 4).alias("total"))


@query(
    "WITH c AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT) AS c FROM documents WHERE length(text) >= 3), "
    "h AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] * 17161 + c[i + 1] * 131 + c[i + 2])) AS h FROM c) "
    "SELECT doc_id, (h % 256)::BIGINT AS dim, count(*)::BIGINT AS n FROM h GROUP BY 1, 2"
)
def kmer_hash_counts(spark, sf):
    return textsets.kmers(table(spark, sf, "documents"))


# vectors


@query(f"WITH {V} SELECT vec_id, round(sqrt({dot('e', 'e')}), 6) AS norm FROM v")
def vector_norms(spark, sf):
    return _base(spark, sf).select("vec_id", F.round(metrics.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {V}, u AS (SELECT vec_id, e, sqrt({dot('e', 'e')}) AS n FROM v) SELECT vec_id, unnest(range(0, 64))::INTEGER AS dim, round(unnest(list_transform(e, lambda x: x / n)), 6) AS value FROM u")
def unit_normalise(spark, sf):
    u = _base(spark, sf).select("vec_id", metrics.unit(F.col("embedding")).alias("embedding"))
    return _rounded(vectors.dimensions(u), "value")


@query(
    "WITH x AS (SELECT unnest(range(0, 64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT dim, avg(x) AS m FROM x GROUP BY 1), "
    "c AS (SELECT dim, m, avg((x - m) ** 2) AS s2, avg((x - m) ** 3) AS s3, avg((x - m) ** 4) AS s4 FROM x JOIN m USING (dim) GROUP BY 1, 2) "
    "SELECT dim, round(m, 6) AS mean, round(s2, 6) AS var_pop, round(s3 / s2 ** 1.5, 6) AS skewness, round(s4 / s2 ** 2 - 3, 6) AS kurtosis FROM c"
)
def dim_moments(spark, sf):
    return _rounded(vectors.moments(_base(spark, sf)), "mean", "var_pop", "skewness", "kurtosis")


@query(
    "WITH x AS (SELECT vec_id, unnest(range(0, 64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1) "
    "SELECT vec_id, dim, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM x JOIN b USING (dim)"
)
def minmax_scale(spark, sf):
    return _rounded(vectors.dimensions(vectors.minmax_scaled(_base(spark, sf))), "value")


@query("SELECT min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def coord_bounds(spark, sf):
    return vectors.bounds(_base(spark, sf))


CENTRE = "c AS (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, avg(x) AS m FROM (SELECT unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1))"


@query(f"WITH {V}, {CENTRE} SELECT vec_id, round({d2('e', 'c')}, 6) AS dist FROM v, c ORDER BY {d2('e', 'c')}, vec_id LIMIT 1")
def medoid(spark, sf):
    return _rounded(vectors.medoid(_base(spark, sf)), "dist")


_PROJECTION = vectors.gaussian_projection(64, 4)


@query(f"WITH {V} SELECT vec_id, " + ", ".join("round(" + _sum(f"e[i] * ([{', '.join(f'{w!r}::DOUBLE' for w in _PROJECTION[:, j].tolist())}])[i]", "e") + f", 6) AS x{j}" for j in range(4)) + " FROM v")
def random_projection(spark, sf):
    p = vectors.projected(_base(spark, sf), _PROJECTION)
    return p.select("vec_id", *[F.round(F.col("embedding")[j], 6).alias(f"x{j}") for j in range(4)])


@query(f"WITH {V}, n AS (SELECT vec_id, {dot('e', 'e')} AS n FROM v) SELECT vec_id, 65::BIGINT AS dims, round(sqrt(greatest(0, (SELECT max(n) FROM n) - n)), 4) AS extra FROM n")
def mips_augment(spark, sf):
    m = vectors.mips_augmented(_base(spark, sf))
    return m.select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(F.element_at("embedding", -1), 4).alias("extra"))


@query("SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings")
def binarise(spark, sf):
    bits = metrics.binarised(F.col("embedding"))
    return _base(spark, sf).select("vec_id", F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "").alias("bits"))


@query("SELECT vec_id, ((vec_id::HUGEINT * 2654435761) % 4294967296) < 429496729 AS is_test FROM embeddings")
def train_test_split(spark, sf):
    return vectors.split(_base(spark, sf), 0.1).select("vec_id", "is_test")


@query("SELECT vec_id FROM embeddings ORDER BY (vec_id::HUGEINT * 2654435761) % 4294967296, vec_id LIMIT (SELECT greatest(1, floor(0.2 * count(*) + 0.5))::BIGINT FROM embeddings)")
def seed_sample(spark, sf):
    return vectors.seeds(_base(spark, sf), 0.2)


# inverted lists


def _unrolled(rounds: int, cells: int = 16) -> str:
    parts = [f"c0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS cid, e FROM v ORDER BY vec_id LIMIT {cells})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, cid, dist FROM (SELECT v.vec_id, c.cid, {d2('v.e', 'c.e')} AS dist, row_number() OVER (PARTITION BY v.vec_id ORDER BY {d2('v.e', 'c.e')}, c.cid) AS r FROM v, c{r} c) WHERE r = 1)")
        parts.append(
            f"c{r + 1} AS MATERIALIZED (SELECT c.cid, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT cid, list(x ORDER BY dim) AS e FROM (SELECT cid, dim, avg(x) AS x FROM "
            f"(SELECT a.cid, unnest(range(0, 64)) AS dim, unnest(v.e) AS x FROM a{r} a JOIN v USING (vec_id)) GROUP BY 1, 2) GROUP BY 1) m USING (cid))"
        )
    return ", ".join(parts[:-1])


@query(f"WITH {V}, {_unrolled(0)} SELECT vec_id, cid, round(dist, 6) AS dist FROM a0")
def ivf_assign(spark, sf):
    base = _base(spark, sf)
    return _rounded(ivf.assign(base, ivf.first_centroids(base, 16)), "dist")


@query(f"WITH {V}, {_unrolled(1)} SELECT cid, unnest(range(0, 64))::INTEGER AS dim, round(unnest(e), 6) AS value FROM c1")
def ivf_kmeans_step(spark, sf):
    c = ivf.train(_base(spark, sf), 16, 1)
    return c.select("cid", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {V}, {_unrolled(3)} SELECT c.cid, count(a.vec_id)::BIGINT AS size, (sum(count(a.vec_id)) OVER (ORDER BY c.cid))::BIGINT AS ends FROM c3 c LEFT JOIN a3 a USING (cid) GROUP BY 1")
def ivf_list_sizes(spark, sf):
    base = _base(spark, sf)
    c = ivf.train(base, 16, 3)
    return ivf.list_sizes(ivf.assign(base, c), c)


def _probe_sql(probes: int) -> str:
    return (
        f"{V}, {_unrolled(3)}, pr AS (SELECT q_id, cid FROM (SELECT v.vec_id AS q_id, c.cid, row_number() OVER (PARTITION BY v.vec_id ORDER BY {d2('v.e', 'c.e')}, c.cid) AS r FROM v, c3 c WHERE v.vec_id % 50 = 0) WHERE r <= {probes}), "
        f"f AS MATERIALIZED (SELECT q_id, rank, b_id, dist FROM (SELECT q.vec_id AS q_id, b.vec_id AS b_id, {d2('q.e', 'b.e')} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d2('q.e', 'b.e')}, b.vec_id)::INTEGER AS rank "
        "FROM pr JOIN a3 a USING (cid) JOIN v q ON q.vec_id = pr.q_id JOIN v b ON b.vec_id = a.vec_id) WHERE rank <= 10)"
    )


#: 12 of 16 probes keep the index's recall above 0.9 on these tables, whose vectors hardly cluster.
_PROBE, _WIDE = _probe_sql(12), _probe_sql(14)
_TRUTH = f"x AS MATERIALIZED ({near(d2('q.e', 'b.e'), 10)})"


def _probed(spark, sf, probes: int = 12):
    base = _base(spark, sf)
    c = ivf.train(base, 16, 3)
    found = ivf.probe(base, ivf.assign(base, c), c, _asked(base), 10, probes)
    return base, checkpointed(found.select("q_id", "rank", "b_id", "dist")), checkpointed(knn.exact(base, _asked(base), 10))


@query(f"WITH {_PROBE} SELECT q_id, rank, b_id, round(dist, 6) AS dist FROM f")
def ivf_probe_search(spark, sf):
    return _rounded(_probed(spark, sf)[1], "dist")


@query(f"WITH {_WIDE} SELECT q_id, rank, b_id, round(dist, 6) AS dist FROM f")
def ivf_probe_search_wide(spark, sf):
    return _rounded(_probed(spark, sf, 14)[1], "dist")


@query(f"WITH {V}, {_unrolled(3)} SELECT (SELECT count(*) * 4 FROM a3)::BIGINT + (SELECT sum(len(e) * 4 + 8) FROM c3)::BIGINT AS bytes")
def ivf_index_size(spark, sf):
    base = _base(spark, sf)
    c = ivf.train(base, 16, 3)
    return ivf.index_size(ivf.assign(base, c), c)


@query(f"WITH {_PROBE}, {_TRUTH} SELECT (SELECT count(*) FROM f JOIN x USING (q_id, b_id)) / ((SELECT count(DISTINCT q_id) FROM x) * 10.0::DOUBLE) AS recall")
def recall_at_k(spark, sf):
    _, found, truth = _probed(spark, sf)
    return knn.recall(found, truth, 10)


@query(f"WITH {_WIDE}, {_TRUTH} SELECT (SELECT count(*) FROM f JOIN x USING (q_id, b_id)) / ((SELECT count(DISTINCT q_id) FROM x) * 10.0::DOUBLE) AS recall")
def recall_at_k_wide(spark, sf):
    _, found, truth = _probed(spark, sf, 14)
    return knn.recall(found, truth, 10)


@query(
    f"WITH {_PROBE}, {_TRUTH}, y AS (SELECT q_id, b_id, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS r FROM x WHERE q_id <> b_id) "
    "SELECT y.q_id, count(f.b_id) / 5.0::DOUBLE AS recall FROM y LEFT JOIN f USING (q_id, b_id) WHERE r <= 5 GROUP BY 1"
)
def recall_self_excluded(spark, sf):
    _, found, truth = _probed(spark, sf)
    return knn.recall_each(found, truth, 5)


@query(f"WITH {_PROBE}, {_TRUTH} SELECT q_id, b_id, x.rank FROM x ANTI JOIN f USING (q_id, b_id)")
def missing_neighbours(spark, sf):
    _, found, truth = _probed(spark, sf)
    return knn.missing(found, truth)


@query(
    f"WITH {_PROBE}, {_TRUTH}, m AS (SELECT q_id, b_id FROM x ANTI JOIN f USING (q_id, b_id)) SELECT q_id, b_id, present, round(dist, 6) AS dist FROM "
    f"(SELECT m.q_id, m.b_id, f.b_id AS present, {d2('a.e', 'b.e')} AS dist, row_number() OVER (PARTITION BY m.q_id, m.b_id ORDER BY {d2('a.e', 'b.e')}, f.b_id) AS r FROM m JOIN f USING (q_id) JOIN v a ON a.vec_id = m.b_id JOIN v b ON b.vec_id = f.b_id) WHERE r = 1"
)
def nearest_present(spark, sf):
    base, found, truth = _probed(spark, sf)
    return _rounded(knn.nearest_present(knn.missing(found, truth), found, base), "dist")


# network statistics of the exact neighbour graph


@query(f"WITH {GRAPH} SELECT src, pos, dst, round(dist, 6) AS dist FROM g")
def knn_graph_edges(spark, sf):
    return _rounded(_graph(spark, sf)[1], "dist").select("src", "pos", "dst", "dist")


_DEG = "dg AS (SELECT v.vec_id AS id, (SELECT count(*) FROM g WHERE src = v.vec_id) AS o, (SELECT count(*) FROM g WHERE dst = v.vec_id) AS i FROM v)"


@query(f"WITH {GRAPH}, {_DEG} SELECT id, o::BIGINT AS out_degree, i::BIGINT AS in_degree FROM dg")
def in_out_degree(spark, sf):
    _, e, n = _graph(spark, sf)
    return network.degrees(e, n)


_SYM = f"{GRAPH}, s AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"
_JOINT = (
    "dg AS (SELECT src AS id, count(*) AS d FROM s GROUP BY 1), e AS (SELECT a.d AS x, b.d AS y, count(*)::DOUBLE / (SELECT count(*) FROM s) AS share FROM s JOIN dg a ON a.id = s.src JOIN dg b ON b.id = s.dst GROUP BY 1, 2), "
    "j AS (SELECT *, sum(share) OVER (PARTITION BY x) AS a_x, sum(share) OVER (PARTITION BY y) AS b_y FROM e)"
)


@query(f"WITH {_SYM}, {_JOINT} SELECT x::BIGINT AS x, y::BIGINT AS y, round(share, 8) AS share, round(a_x, 8) AS a_x, round(b_y, 8) AS b_y FROM j")
def degree_joint(spark, sf):
    _, e, n = _graph(spark, sf)
    return _rounded(network.joint_degrees(network.symmetric(e), n), "share", "a_x", "b_y", places=8)


@query(
    f"WITH {_SYM}, {_JOINT}, m AS (SELECT sum(x * share) AS mx, sum(y * share) AS my FROM j) SELECT round(sum(share * (x - mx) * (y - my)) / sqrt(sum(share * (x - mx) ** 2) * sum(share * (y - my) ** 2)), 6) AS pearson, "
    "round(sum(share * (x - mx) * (y - my)) / sqrt(sum(a_x * (x - mx) ** 2) * sum(b_y * (y - my) ** 2)), 6) AS pair_variance FROM j, m"
)
def assortativity(spark, sf):
    _, e, n = _graph(spark, sf)
    return _rounded(network.assortativity(network.symmetric(e), n), "pearson", "pair_variance")


@query(
    f"WITH {GRAPH}, {_DEG}, f AS (SELECT vec_id AS id FROM v ORDER BY 1 LIMIT (SELECT greatest(1, count(*) // 20) FROM v)), "
    "t AS (SELECT a.src AS id, count(*) AS t FROM g a JOIN g b ON a.dst = b.src JOIN g c ON b.dst = c.src AND c.dst = a.src GROUP BY 1) "
    "SELECT round(avg(CASE WHEN i >= 2 AND o > 0 THEN coalesce(t, 0) / (i * o) ELSE 0 END), 6) AS coefficient FROM f JOIN dg USING (id) LEFT JOIN t USING (id)"
)
def clustering_coeff(spark, sf):
    _, e, n = _graph(spark, sf)
    return _rounded(network.clustering(e, n), "coefficient")


@query(f"WITH {GRAPH}, t AS (SELECT a.src, count(*) AS t FROM g a JOIN g b ON a.src = b.src JOIN g c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1) SELECT v.vec_id AS id, round(10 - 2 * coalesce(t, 0) / 10, 6) AS size FROM v LEFT JOIN t ON t.src = v.vec_id")
def effective_size(spark, sf):
    _, e, n = _graph(spark, sf)
    return _rounded(network.effective_size(e, n), "size")


@query(f"WITH {GRAPH} SELECT src, dst, round(sqrt(dist), 6) AS length FROM g")
def edge_lengths(spark, sf):
    base, e, _ = _graph(spark, sf)
    return _rounded(network.edge_lengths(e, base), "length")


def _bfs(edges: str) -> str:
    return f"RECURSIVE h AS (SELECT vec_id AS source, vec_id AS id, 0 AS hop FROM embeddings WHERE vec_id < 10 UNION SELECT h.source, e.dst, h.hop + 1 FROM h JOIN {edges} e ON e.src = h.id WHERE h.hop < 8)"


_HOPS = GRAPH.replace("v AS", "RECURSIVE v AS", 1) + ", " + _bfs("g").removeprefix("RECURSIVE ") + ", hh AS (SELECT source, id, min(hop) AS hop FROM h GROUP BY 1, 2)"


@query(f"WITH {_HOPS} SELECT source, id, hop FROM hh")
def bfs_hops(spark, sf):
    _, e, n = _graph(spark, sf)
    return network.hops(e, n.select("id").orderBy("id").limit(10))


@query(f"WITH {_HOPS} SELECT round(avg(hop), 6) AS average_path, max(hop)::BIGINT AS diameter FROM hh WHERE hop > 0")
def path_lengths(spark, sf):
    _, e, n = _graph(spark, sf)
    return _rounded(network.path_summary(e, n, 10), "average_path")


@query(
    f"WITH {_HOPS}, r AS (SELECT source, count(*) AS r, sum(hop) AS t FROM hh WHERE hop > 0 AND id < 10 GROUP BY 1) "
    "SELECT vec_id AS id, round(coalesce(r / 9.0::DOUBLE * (r::DOUBLE / t), 0), 6) AS closeness FROM embeddings LEFT JOIN r ON source = vec_id WHERE vec_id < 10"
)
def wf_closeness(spark, sf):
    _, e, n = _graph(spark, sf)
    return _rounded(network.closeness(e, n, 10), "closeness")


def _pagerank_sql(rounds: int) -> str:
    parts = ["dg AS (SELECT src AS id, count(*) AS d FROM s GROUP BY 1)", "r0 AS (SELECT vec_id AS id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT v.vec_id AS id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * coalesce(sum(r.r / dg.d), 0) AS r FROM v LEFT JOIN s ON s.src = v.vec_id LEFT JOIN r{i} r ON r.id = s.dst LEFT JOIN dg ON dg.id = s.dst GROUP BY 1)")
    return ", ".join(parts)


@query(f"WITH {_SYM}, {_pagerank_sql(10)} SELECT id, round(r, 9) AS rank FROM r10")
def pagerank_fixed_iters(spark, sf):
    _, e, n = _graph(spark, sf)
    return _rounded(network.pagerank(network.symmetric(e), n, rounds=10, tolerance=0), "rank", places=9)


@query(
    f"WITH {GRAPH.replace('v AS', 'RECURSIVE v AS', 1)}, m AS MATERIALIZED (SELECT a.src, a.dst FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src), "
    "w AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT w.id, m.dst FROM w JOIN m ON m.src = w.c) SELECT id, min(c) AS component FROM w GROUP BY 1"
)
def mutual_components(spark, sf):
    _, e, n = _graph(spark, sf)
    return network.components(network.mutual(e), n)


@query(f"WITH {GRAPH} SELECT src, dst, pos FROM g WHERE pos < 4")
def adjacency_truncate(spark, sf):
    _, e, _ = _graph(spark, sf)
    return network.adjacency_truncated(e, 4).select("src", "dst", "pos")


@query(
    f"WITH {GRAPH.replace('v AS', 'RECURSIVE v AS', 1)}, h AS (SELECT vec_id AS source, vec_id AS id, 0 AS hop FROM embeddings UNION SELECT source, dst, hop + 1 FROM h JOIN g ON src = id WHERE hop < 30), "
    "hh AS MATERIALIZED (SELECT source, id, min(hop) AS hop FROM h GROUP BY 1, 2), sg AS (SELECT vec_id AS source, vec_id AS id, 0 AS hop, 1.0::DOUBLE AS n FROM embeddings "
    "UNION ALL SELECT sg.source, g.dst, sg.hop + 1, sum(n) FROM sg JOIN g ON src = sg.id JOIN hh ON hh.source = sg.source AND hh.id = g.dst AND hh.hop = sg.hop + 1 GROUP BY 1, 2, 3), sp AS MATERIALIZED (SELECT * FROM sg WHERE hop > 0), "
    "b AS (SELECT a.id, sum(a.n * c.n / w.n) AS b FROM sp a JOIN sp c ON c.source = a.id JOIN sp w ON w.source = a.source AND w.id = c.id AND w.hop = a.hop + c.hop GROUP BY 1) "
    "SELECT vec_id AS id, round(coalesce(b, 0) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2), 9) AS betweenness FROM embeddings LEFT JOIN b ON b.id = vec_id"
)
def betweenness(spark, sf):
    _, e, n = _graph(spark, sf)
    return _rounded(network.betweenness(e, n), "betweenness", places=9)


def _fold(alpha: float | None, most: int) -> str:
    bad = f"{d2('k', 'c.e')} < c.dist" if alpha is None else f"{alpha}::DOUBLE * {d2('k', 'c.e')} <= c.dist"
    keep = f"len(kept) < {most} AND len(list_filter(vecs, lambda k: {bad})) = 0"
    return (
        f"{V.replace('v AS', 'RECURSIVE v AS', 1)}, {ALL}, c AS MATERIALIZED (SELECT src, dst, dist, r, v.e FROM (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM p WHERE src <> dst) JOIN v ON v.vec_id = dst WHERE r <= 20), "
        f"f AS (SELECT vec_id AS src, 0::BIGINT AS r, []::BIGINT[] AS kept, []::DOUBLE[][] AS vecs FROM embeddings UNION ALL SELECT f.src, c.r, CASE WHEN {keep} THEN list_append(kept, c.dst) ELSE kept END, CASE WHEN {keep} THEN list_append(vecs, c.e) ELSE vecs END FROM f JOIN c ON c.src = f.src AND c.r = f.r + 1) "
        "SELECT src, unnest(range(0, len(kept)))::INTEGER AS pos, unnest(kept) AS dst FROM f WHERE r = 20"
    )


@query(f"WITH {_fold(None, 8)}")
def diversity_prune(spark, sf):
    base = _base(spark, sf)
    return walk.pruned_lists(knn.graph(base, 20), base, 8, None)


@query(f"WITH {_fold(1.2, 8)}")
def robust_prune(spark, sf):
    base = _base(spark, sf)
    return walk.pruned_lists(knn.graph(base, 20), base, 8, 1.2)


# greedy walks and pruning by their statistics


def _walk_sql(turns: int = 12) -> str:
    start = f"{_SYM}, {CENTRE}, en AS (SELECT vec_id FROM v, c ORDER BY {d2('e', 'c')}, vec_id LIMIT 1), s2 AS MATERIALIZED (SELECT s.src, s.dst, (row_number() OVER (PARTITION BY s.src ORDER BY p.dist, s.dst) - 1)::INTEGER AS pos FROM s JOIN p USING (src, dst))"
    parts = [start, "w0 AS MATERIALIZED (SELECT q.vec_id AS q_id, 0 AS step, en.vec_id AS node, p.dist FROM v q, en, p WHERE q.vec_id % 50 = 0 AND p.src = q.vec_id AND p.dst = en.vec_id)"]
    for i in range(turns):
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT q_id, {i + 1} AS step, dst AS node, d AS dist FROM (SELECT w.q_id, s2.dst, p.dist AS d, w.dist AS here, row_number() OVER (PARTITION BY w.q_id ORDER BY p.dist, s2.pos) AS r FROM w{i} w JOIN s2 ON s2.src = w.node JOIN p ON p.src = w.q_id AND p.dst = s2.dst) WHERE r = 1 AND d < here)")
    parts.append("w AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(turns + 1)) + ")")
    return ", ".join(parts)


_WALK = _walk_sql()
_STATS = "st AS MATERIALIZED (SELECT s2.src, s2.pos, s2.dst, coalesce(count_if(p.dist < w.dist), 0) AS adopted, coalesce(count_if(p.dist >= w.dist), 0) AS discarded FROM s2 LEFT JOIN w ON w.node = s2.src LEFT JOIN p ON p.src = w.q_id AND p.dst = s2.dst GROUP BY 1, 2, 3)"


def _linked(spark, sf):
    """(vectors, links of the neighbour graph both ways, in order of distance), which the graph's own distances give."""
    base, e, _ = _graph(spark, sf)
    both = e.select("src", "dst", "dist").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).dropDuplicates(["src", "dst"])
    return base, checkpointed(network.adjacency_truncated(both, 1 << 30).select("src", "pos", "dst"))


def _walked(spark, sf):
    base, edges = _linked(spark, sf)
    return base, edges, walk.steps(edges, base, _asked(base), vectors.medoid(base))


def _walk_stats(spark, sf):
    base, edges, path = _walked(spark, sf)
    stats = walk.edge_statistics(edges, base, _asked(base), path).withColumn("level", F.lit(0))
    return search.aligned(edges.withColumn("level", F.lit(0)), stats)


@query(f"WITH {_WALK} SELECT q_id, step, node, round(dist, 6) AS dist FROM w")
def greedy_path(spark, sf):
    return _rounded(_walked(spark, sf)[2], "dist")


@query(f"WITH {_WALK} SELECT q_id, arg_max(node, step) AS node, round(arg_max(dist, step), 6) AS dist FROM w GROUP BY 1")
def greedy_search(spark, sf):
    last = _walked(spark, sf)[2].groupBy("q_id").agg(F.max(F.struct("step", "node", "dist")).alias("m"))
    return last.select("q_id", "m.node", F.round("m.dist", 6).alias("dist"))


@query(f"WITH {_WALK} SELECT node, count(*)::BIGINT AS visits FROM w GROUP BY 1")
def greedy_path_visits(spark, sf):
    return traces.node_visits(_walked(spark, sf)[2])


@query(f"WITH {_WALK}, {_STATS} SELECT src, dst, adopted::BIGINT AS adopted, discarded::BIGINT AS discarded FROM st WHERE adopted + discarded > 0")
def greedy_edge_stats(spark, sf):
    return _walk_stats(spark, sf).where("adopted + discarded > 0").select("src", "dst", "adopted", "discarded")


_PRUNE = (
    f"{_WALK}, {_STATS}, ca AS (SELECT *, discarded::DOUBLE / adopted AS ratio, row_number() OVER (ORDER BY discarded::DOUBLE / adopted DESC, adopted + discarded DESC, discarded DESC, src, dst) AS rank FROM st WHERE adopted > 0), "
    "o AS (SELECT *, row_number() OVER (ORDER BY rank) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rank) AS own FROM ca) WHERE own = 1), "
    "ph AS (SELECT src, pos, dst, 0 AS phase, rank AS place FROM o WHERE turn <= greatest(1, ceil((SELECT count(*) FROM ca) * 0.1)) UNION ALL SELECT src, pos, dst, 1, pos FROM st WHERE adopted = 0 AND discarded > 0), "
    "cut AS MATERIALIZED (SELECT src, pos, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY phase, place, dst) AS n FROM ph) WHERE n <= 2)"
)


@query(f"WITH {_PRUNE} SELECT src, pos, dst FROM cut")
def prune_select(spark, sf):
    return refine.prune_selected(_walk_stats(spark, sf), 0.1).select("src", "pos", "dst")


@query(f"WITH {_PRUNE} SELECT src, (row_number() OVER (PARTITION BY src ORDER BY pos) - 1)::INTEGER AS pos, dst FROM s2 ANTI JOIN cut USING (src, dst)")
def prune_apply(spark, sf):
    stats = checkpointed(_walk_stats(spark, sf))
    return refine.without(stats, refine.prune_selected(stats, 0.1)).select("src", "pos", "dst")


@query(
    f"WITH {_PRUNE}, wo AS (SELECT * FROM ca WHERE rank <= floor((SELECT count(*) FROM ca) * 0.1)), one AS (SELECT src, pos, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pos) AS own FROM wo) WHERE own = 1) "
    "SELECT src, pos, dst FROM one UNION SELECT src, pos, dst FROM st WHERE adopted = 0 AND discarded > 0"
)
def prune_select_legacy(spark, sf):
    return refine.prune_ratio_legacy(_walk_stats(spark, sf), 0.1).select("src", "pos", "dst")


@query(f"WITH {_PRUNE} SELECT " + ", ".join(f"round(quantile_cont(ratio, {q}), 6) AS p{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM ca")
def ratio_quantiles(spark, sf):
    q = refine.quantiles(refine.prune_candidates(_walk_stats(spark, sf)), F.col("ratio"))
    return _rounded(q, *q.columns)


@query(
    f"WITH {_WALK}, {_STATS}, x AS (SELECT adopted::DOUBLE / 100 AS x FROM st WHERE adopted + discarded > 0) SELECT round(avg(x), 6) AS mean, round(median(x), 6) AS median, max(x) AS max, "
    "count_if(x > 0.01)::BIGINT AS over_1, count_if(x > 0.015)::BIGINT AS over_1_5, count_if(x > 0.02)::BIGINT AS over_2, count_if(x > 0.05)::BIGINT AS over_5 FROM x"
)
def impact_threshold_counts(spark, sf):
    stats = _walk_stats(spark, sf).where("adopted + discarded > 0").select((F.col("adopted") / 100).alias("impact_ratio"))
    return _rounded(refine.impact_summary(stats), "mean", "median")


@query("SELECT vec_id AS src, (vec_id * 7 + 1) % 500 AS dst FROM embeddings WHERE (((vec_id * 1000003 + (vec_id * 7 + 1) % 500)::HUGEINT * 2654435761) % 4294967296) < 214748364")
def edge_sample(spark, sf):
    edges = _base(spark, sf).select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 1) % 500).alias("dst"))
    return refine.sampled_edges(edges, 0.05)


@query()
def adopted_edge_sample(spark, sf):
    """A sample of the built graph's edges that seeds' traces adopted."""
    base, edges, _, g = _loaded(spark, sf)
    met = search.edge_seeds(search.traces(g, _seeds(base, refine.FAMILY["nsg"].seed_share), 32)).select("level", "src", "dst").distinct()
    return refine.sampled_edges(edges.join(met, ["level", "src", "dst"], "left_semi"), 0.05).select("level", "src", "pos", "dst")


# evaluation


POINTS = "pt AS (SELECT vec_id % 2 AS k, vec_id % 5 AS iter, ((vec_id * 37) % 1000) / 1000.0::DOUBLE AS recall, 1000.0::DOUBLE / (1 + ((vec_id * 37) % 1000) / 100.0::DOUBLE) + (vec_id * 7919) % 101 AS qps FROM embeddings)"


def _points(spark, sf):
    i = F.col("vec_id")
    r = (i * 37) % 1000
    return _base(spark, sf).select((i % 2).alias("k"), (i % 5).alias("iter"), (r / F.lit(1000.0)).alias("recall"), (1000 / (1 + r / 100) + (i * 7919) % 101).alias("qps"))


FRONT = f"{POINTS}, fr AS (SELECT k, iter, recall, qps FROM (SELECT *, max(qps) OVER (PARTITION BY k, iter ORDER BY recall DESC, qps DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pt) WHERE best IS NULL OR qps > best)"
LEVEL = (
    f"{FRONT}, nx AS (SELECT *, coalesce(lead(recall) OVER o, recall) AS r1, coalesce(lead(qps) OVER o, qps) AS q1 FROM fr WINDOW o AS (PARTITION BY k, iter ORDER BY recall, qps)), "
    f"lv AS (SELECT k, iter, level, coalesce(max(CASE WHEN level >= recall AND level <= r1 THEN CASE WHEN r1 = recall THEN qps ELSE qps + (q1 - qps) * (level - recall) / (r1 - recall) END END), 0) AS qps FROM nx, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in evaluate.LEVELS)}]) AS level) GROUP BY 1, 2, 3)"
)


@query(f"WITH {FRONT} SELECT k, iter, recall, round(qps, 6) AS qps FROM fr")
def pareto_frontier(spark, sf):
    return _rounded(evaluate.frontier(_points(spark, sf), ["k", "iter"]).select("k", "iter", "recall", "qps"), "qps")


def _levels(spark, sf):
    return evaluate.at_recalls(evaluate.frontier(_points(spark, sf), ["k", "iter"]), ["k", "iter"])


@query(f"WITH {LEVEL} SELECT k, iter, level, round(qps, 6) AS qps FROM lv")
def interp_at_recall(spark, sf):
    return _rounded(_levels(spark, sf), "qps")


@query(f"WITH {LEVEL}, it AS (SELECT DISTINCT k, iter FROM lv) SELECT * FROM (SELECT k, iter, row_number() OVER (PARTITION BY k ORDER BY iter DESC)::INTEGER AS age FROM it) WHERE age <= 2")
def latest_prev_iter(spark, sf):
    return evaluate.latest_and_previous(_levels(spark, sf).select("k", "iter").distinct(), ["k"])


@query(
    f"WITH {LEVEL}, it AS (SELECT DISTINCT k, iter FROM lv), ag AS (SELECT k, iter, row_number() OVER (PARTITION BY k ORDER BY iter DESC) AS age FROM it), "
    "y AS (SELECT lv.*, age FROM lv JOIN ag USING (k, iter) WHERE level >= 0.9 AND qps > 0) SELECT a.k, round(avg(a.qps / b.qps), 6) AS ratio FROM y a JOIN y b USING (k, level) WHERE a.age = 1 AND b.age = 2 GROUP BY 1"
)
def improvement_ratio(spark, sf):
    return _rounded(evaluate.improvement(_levels(spark, sf), ["k"]), "ratio")


# clusters


@query(
    f"WITH {V.replace('v AS', 'RECURSIVE v AS', 1)}, {ALL}, n AS MATERIALIZED (SELECT src, dst FROM p WHERE dist <= 1.4 * (1 + 1e-12)), co AS MATERIALIZED (SELECT src AS id FROM n GROUP BY 1 HAVING count(*) >= 5), "
    "l AS MATERIALIZED (SELECT n.src, n.dst FROM n JOIN co a ON a.id = n.src JOIN co b ON b.id = n.dst), w AS (SELECT id, id AS c FROM co UNION SELECT w.id, l.dst FROM w JOIN l ON l.src = w.c), "
    "cl AS MATERIALIZED (SELECT id, min(c) AS c FROM w GROUP BY 1), bo AS (SELECT n.dst AS id, min(cl.c) AS c FROM n JOIN cl ON cl.id = n.src GROUP BY 1) "
    "SELECT vec_id, coalesce(cl.c, bo.c, -1)::BIGINT AS cluster FROM embeddings LEFT JOIN cl ON cl.id = vec_id LEFT JOIN bo ON bo.id = vec_id"
)
def dbscan(spark, sf):
    return clusters.dbscan(_base(spark, sf), float(np.sqrt(1.4)), 5)


@query(
    f"WITH {V}, {ALL}, m AS (SELECT p.src, a.label AS own, b.label, sum(sqrt(p.dist)) AS t, count(*) AS n FROM p JOIN v a ON a.vec_id = p.src JOIN v b ON b.vec_id = p.dst GROUP BY 1, 2, 3), "
    "s AS (SELECT src, max(CASE WHEN own = label THEN t / greatest(n - 1, 1) END) AS a, max(CASE WHEN own = label THEN n END) AS n, min(CASE WHEN own <> label THEN t / n END) AS b FROM m GROUP BY 1) "
    "SELECT round(avg(CASE WHEN n > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s"
)
def silhouette(spark, sf):
    return _rounded(clusters.silhouette(_base(spark, sf)), "silhouette")


_CENTRES = "x AS (SELECT vec_id, label, unnest(range(0, 64)) AS dim, unnest(e) AS x FROM v), cm AS (SELECT label, dim, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2), cl AS (SELECT label, list(m ORDER BY dim) AS c FROM cm GROUP BY 1), "
_CENTRES += f"sq AS (SELECT vec_id, v.label, {d2('e', 'c')} AS sq FROM v JOIN cl USING (label))"


@query(
    f"WITH {V}, {_CENTRES}, gm AS (SELECT dim, avg(x) AS m FROM x GROUP BY 1), b AS (SELECT sum(n * (cm.m - gm.m) ** 2) AS b, count(DISTINCT label) AS k FROM cm JOIN gm USING (dim)), t AS (SELECT sum((x - m) ** 2) AS t FROM x JOIN gm USING (dim)), w AS (SELECT sum(sq) AS w, sum(sqrt(sq)) AS u, count(*) AS n FROM sq) "
    "SELECT round(b / (k - 1) / (w / (n - k)), 6) AS calinski_harabasz, round(t / (k - 1) / (u / (n - k)), 6) AS total_over_plain FROM b, t, w"
)
def calinski_harabasz(spark, sf):
    return _rounded(clusters.calinski_harabasz(_base(spark, sf)), "calinski_harabasz", "total_over_plain")


@query(
    f"WITH {V}, {_CENTRES}, s AS (SELECT label, avg(sqrt(sq)) AS s FROM sq GROUP BY 1), r AS (SELECT a.label, max((x.s + y.s) / sqrt({d2('a.c', 'b.c')})) AS r FROM cl a JOIN cl b ON a.label <> b.label JOIN s x ON x.label = a.label JOIN s y ON y.label = b.label GROUP BY 1) "
    "SELECT round(avg(r), 6) AS davies_bouldin FROM r"
)
def davies_bouldin(spark, sf):
    return _rounded(clusters.davies_bouldin(_base(spark, sf)), "davies_bouldin")


_U = "(((({} + {}) ::HUGEINT * 2654435761) % 4294967296)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE * 490"


_A, _B = _U.format("s_suppkey", 17), _U.format("((s_suppkey::HUGEINT * 2654435761) % 4294967296)", 1009)


@query(f"WITH i AS (SELECT s_suppkey AS id, least({_A}, {_B}) AS lo, greatest({_A}, {_B}) AS hi FROM supplier) SELECT id, count(*)::BIGINT AS stabs FROM i JOIN events ON value >= lo AND value <= hi GROUP BY 1")
def interval_stab(spark, sf):
    spans = textsets.intervals(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), F.col("id"), low=0.0, high=490.0)
    return textsets.stab_counts(spans, table(spark, sf, "events").select(F.col("value").alias("at")))


# searches, index construction and refinement: no SQL form; tests compare them with brute force


def _parts(spark, sf, family: str, **params):
    base = _base(spark, sf)
    edges, nodes = build.build(base, family, **params)
    return base, edges, nodes


def _loaded(spark, sf, family: str = "nsg", **params):
    base, edges, nodes = _parts(spark, sf, family, **(params or {"r": 16, "lc": 48}))
    return base, edges, nodes, search.opened(edges, nodes, base, family == "hcnng")


@query()
def beam_search(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    return search.knn_search(g, _asked(base), 10, 64)


@query()
def beam_search_sharded(spark, sf):
    base, edges, nodes = _parts(spark, sf, "nsg", r=16, lc=48)
    return build.sharded_search(edges, nodes, base, _asked(base), 10, 64)


@query()
def beam_search_rounds(spark, sf):
    base, edges, nodes = _parts(spark, sf, "nsg", r=16, lc=48)
    found = walk.beam_rounds(edges, base, _asked(base), nodes.where("is_entry").select(F.col("id").alias("vec_id")), 4)
    return found.select("q_id", "evaluations", F.inline("found"))


@query()
def hnsw_search(spark, sf):
    base, _, _, g = _loaded(spark, sf, "hnsw", m=8, efc=48)
    return search.knn_search(g, _asked(base), 10, 64)


@query()
def hcnng_search(spark, sf):
    base, _, _, g = _loaded(spark, sf, "hcnng", s=5, trees=6, leaf=100)
    return search.knn_search(g, _asked(base), 10, 64)


@query()
def self_excluding_search(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    return search.knn_search(g, _asked(base), 10, 64, exclude_self=True)


@query()
def beam_trace(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    return search.traces(g, _asked(base), 32)


@query()
def beam_edge_stats(spark, sf):
    base, edges, _, g = _loaded(spark, sf)
    return search.aligned(edges, search.edge_statistics(search.traces(g, _seeds(base, refine.FAMILY["nsg"].seed_share), 32)))


@query()
def edge_access_seeds(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    return search.edge_seeds(search.traces(g, _asked(base), 32)).groupBy("level", "src", "dst").agg(F.count("*").alias("seeds"))


@query()
def acer(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    return search.cost(search.traces(g, _asked(base), 32))


@query()
def hnsw_build(spark, sf):
    return _parts(spark, sf, "hnsw", m=8, efc=48)[1]


@query()
def nsg_build(spark, sf):
    return _parts(spark, sf, "nsg", r=16, lc=48)[1]


@query()
def vamana_build(spark, sf):
    return _parts(spark, sf, "vamana", r=16, lc=48, alpha=1.2)[1]


@query()
def hcnng_build(spark, sf):
    return _parts(spark, sf, "hcnng", s=5, trees=6, leaf=100)[1]


@query()
def index_size(spark, sf):
    return build.index_size(_parts(spark, sf, "nsg", r=16, lc=48)[1])


def _hop_core(spark, sf):
    """The 20 nearest nodes to each query and the links among them."""
    base, e, _ = _graph(spark, sf)
    core = knn.exact(base, _asked(base), 20).select("q_id", "b_id", "rank")
    a, b = core.select("q_id", F.col("b_id").alias("src")), core.select("q_id", F.col("b_id").alias("dst"))
    return core, a.join(e.select("src", "dst"), "src").join(b, ["q_id", "dst"])


@query(
    f"WITH {GRAPH.replace('v AS', 'RECURSIVE v AS', 1)}, k AS MATERIALIZED ({near(d2('q.e', 'b.e'), 20)}), l AS MATERIALIZED (SELECT a.q_id, g.src, g.dst FROM k a JOIN g ON g.src = a.b_id JOIN k b ON b.q_id = a.q_id AND b.b_id = g.dst), "
    "h AS (SELECT q_id, src, dst, 1 AS hop FROM l UNION SELECT h.q_id, h.src, l.dst, h.hop + 1 FROM h JOIN l ON l.q_id = h.q_id AND l.src = h.dst WHERE h.hop < 8) "
    "SELECT q_id, src, count(DISTINCT dst)::BIGINT AS reached FROM h GROUP BY 1, 2"
)
def hop_reachability(spark, sf):
    _, links = _hop_core(spark, sf)
    ids = {c: F.concat_ws(":", "q_id", c) for c in ("src", "dst")}
    graph = checkpointed(links.select("q_id", ids["src"].alias("src"), ids["dst"].alias("dst")))
    walked = network.hops(graph, graph.select(F.col("src").alias("id")).distinct(), most=8)
    # a node reaches itself if a circle leads back to it within the steps
    onward = walked.where("hop > 0").select("source", "id")
    circle = walked.where("hop < 8").join(graph.select(F.col("src").alias("id"), F.col("dst").alias("source")), ["id", "source"], "left_semi").select("source", F.col("source").alias("id"))
    both = onward.union(circle).distinct().groupBy("source").agg(F.count("*").alias("reached"))
    part = F.split("source", ":")
    return both.select(part[0].cast("long").alias("q_id"), part[1].cast("long").alias("src"), "reached")


@query()
def hop_deficit_edges(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    return refine.local_edges(g, _seeds(base, 0.1), refine.settings_for("nsg", ef_max=200, jump_max=2))


@query()
def connectivity_repair(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    true = checkpointed(refine.pseudo_truth(g, base, 20, 200))
    return refine.repairs(g, base, true, 20, 20)


@query()
def ef_tune(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    truth = checkpointed(knn.exact(base, _asked(base), 10))
    ef = refine.tuned_ef(g, _asked(base), truth, 10, 0.9, 10, 40, 10, 200)
    return spark.createDataFrame([(ef, *refine.recall_at(g, _asked(base), truth, 10, ef))], "ef int, recall double, evaluations double")


@query()
def recall_sweep(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    truth = checkpointed(knn.exact(base, _asked(base), 10))
    return spark.createDataFrame(refine.sweep(g, _asked(base), truth, 10, range(10, 161, 50), 0.995), "k int, ef int, recall double, evaluations double")


@query()
def edge_impact(spark, sf):
    base, _, _, g = _loaded(spark, sf)
    t = search.traces(g, _asked(base), 16)
    return refine.edge_impact(g, search.edge_seeds(t), base, knn.exact(base, _asked(base), 11), 10, 16)


def _refined(spark, sf, family: str, **params):
    base, edges, nodes = _parts(spark, sf, family, **params)
    truth = checkpointed(knn.exact(base, _asked(base), 20))
    return refine.refine(edges, nodes, base, _asked(base), truth, refine.FAMILY[family])


@query()
def refine_loop_nsg(spark, sf):
    return _refined(spark, sf, "nsg", r=16, lc=48)[1]


@query()
def refine_loop_hnsw(spark, sf):
    return _refined(spark, sf, "hnsw", m=8, efc=48)[1]


@query()
def refine_loop_hcnng(spark, sf):
    return _refined(spark, sf, "hcnng", s=5, trees=6, leaf=100)[1]


def _grown(spark, sf):
    """(edges, trees of the stated queries' searches marked by their true nearest vector)."""
    base, edges, _, g = _loaded(spark, sf)
    nearest = knn.exact(base, _asked(base), 1).select("q_id", F.col("b_id").alias("target"))
    return edges, checkpointed(traces.marked(search.trees(g, _asked(base), 16), 10, nearest))


@query()
def trace_tree_sizes(spark, sf):
    return traces.sizes(_grown(spark, sf)[1])


@query()
def trace_main_paths(spark, sf):
    return traces.main_paths(_grown(spark, sf)[1])


@query()
def trace_edge_visits(spark, sf):
    return traces.edge_visits(traces.main_paths(_grown(spark, sf)[1]))


@query()
def trace_inner_visits(spark, sf):
    return traces.inner_visits(_grown(spark, sf)[1])[1]


@query()
def trace_shortcuts(spark, sf):
    return traces.shortcuts(traces.main_paths(_grown(spark, sf)[1]), longest=3)


@query()
def trace_local_matrix(spark, sf):
    edges, t = _grown(spark, sf)
    return traces.local_matrix(t, edges)


@query()
def trace_local_links(spark, sf):
    edges, t = _grown(spark, sf)
    return traces.local_links(t, edges, jumps=2)


@query()
def implicit_item_factors(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = rows.groupBy(F.col("o_custkey").alias("id"), F.col("l_partkey").alias("term")).agg(F.sum("l_quantity").alias("tf"))
    weights = textsets.bm25(counts).select(F.col("id").cast("int").alias("user"), F.col("term").cast("int").alias("item"), F.col("weight").cast("float").alias("weight"))
    return vectors.mips_augmented(textsets.implicit_factors(weights, rank=8, rounds=3)[1])


# files, written and read back


def _file_sql(kind: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, 64::BIGINT AS dims, round(list_sum(list_transform(embedding, lambda x: {kind})), 4) AS total FROM embeddings"


def _round_trip(spark, sf, layout: str, scaled) -> DataFrame:
    path = new_path(spark, layout)
    vecfiles.write(_base(spark, sf).select("vec_id", F.transform("embedding", scaled).alias("embedding")), path, layout)
    back = vecfiles.read(spark, path, layout)
    return back.select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(metrics.total(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("total"))


def _layout_query(layout: str, sql: str, scaled) -> None:
    def run(spark, sf):
        return _round_trip(spark, sf, layout, scaled)

    run.__name__ = f"file_{layout}"
    query(_file_sql(sql))(run)


for _layout in ("fvecs", "fbin"):
    _layout_query(_layout, "x::DOUBLE", lambda x: x)
for _layout in ("ivecs", "ibin", "i8bin"):
    _layout_query(_layout, "trunc(x::DOUBLE * 100)", lambda x: (x.cast("double") * 100).cast("int"))
for _layout in ("bvecs", "u8bin"):
    _layout_query(_layout, "abs(trunc(x::DOUBLE * 100))", lambda x: F.abs((x.cast("double") * 100).cast("int")))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 100")
def file_row_range(spark, sf):
    """Rows 100 to 149 of a vector file: the range is the feature; no other bytes are read."""
    path = new_path(spark, "range")
    vecfiles.write(_base(spark, sf).select("vec_id", "embedding"), path, "fvecs")
    return vecfiles.read(spark, path, "fvecs", start=100, count=50).select("vec_id", F.round(metrics.total(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("total"))


@query(f"WITH {V} SELECT (dense_rank() OVER (ORDER BY q_id) - 1)::BIGINT AS q_id, rank, b_id, round(dist, 4) AS dist FROM ({near(d2('q.e', 'b.e'), 10)})")
def file_knn_result(spark, sf):
    base, path = _base(spark, sf), new_path(spark, "knn")
    results.write_knn(knn.exact(base, _asked(base), 10), path, 10)
    return _rounded(results.read_knn(spark, path), "dist", places=4)


@query("SELECT vec_id AS row_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS entries, round(list_sum(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x > 0)), 4) AS total FROM embeddings")
def file_sparse_matrix(spark, sf):
    path = new_path(spark, "csr")
    kept = F.filter(F.transform("embedding", lambda x, i: F.struct(i.cast("int").alias("i"), x.cast("float").alias("x"))), lambda s: s["x"] > 0)
    rows = _base(spark, sf).select(F.col("vec_id").alias("row_id"), F.transform(kept, lambda s: s["i"]).alias("idx"), F.transform(kept, lambda s: s["x"]).alias("val"))
    results.write_csr(rows, path, 64)
    back = results.read_csr(spark, path)
    return back.select("row_id", F.size("idx").cast("long").alias("entries"), F.round(metrics.total(F.transform("val", lambda x: x.cast("double"))), 4).alias("total"))


@query(f"WITH {V}, {_unrolled(0)} SELECT vec_id, cid FROM a0")
def file_ivf_index(spark, sf):
    base, path = _base(spark, sf), new_path(spark, "ivf")
    c = ivf.first_centroids(base, 16)
    results.write_ivf(c, ivf.assign(base, c), path, 0)
    return results.read_ivf(spark, path, 64)[1]


@query(f"WITH {GRAPH} SELECT src, pos, dst FROM g")
def file_graph_index(spark, sf):
    _, e, n = _graph(spark, sf)
    path = new_path(spark, "index")
    nodes = n.select("id", F.lit(0).alias("level"))
    results.write_index(e.withColumn("level", F.lit(0)), nodes, path, "nsg", {"n": n.count(), "r": 10, "dim": 64, "lc": 10, "entry": 0})
    edges, _, _ = results.read_index(spark, path, "nsg", n.count())
    return edges.select("src", "pos", "dst")

"""Text formats, result files and datasets, written from the driver's tables and read back, beside the SQL on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import knn
from ..sources import results, text
from .catalog import SETS, V, _asked, _base, _rounded, d2, near, query
from .iterate import new_path, table


def _lines(spark, name: str, rows: DataFrame) -> str:
    """The path of a text written from one string column."""
    path = new_path(spark, name)
    rows.write.text(path)
    return path


@query("SELECT 'w' || vec_id AS word, 64::BIGINT AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def text_word_vectors(spark, sf):
    values = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    path = _lines(spark, "words", _base(spark, sf).select(F.concat(F.lit("w"), "vec_id", F.lit(" "), values)))
    return text.glove(spark, path).select("word", F.size("embedding").cast("long").alias("dims"), F.round(metrics.total(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("total"))


@query("SELECT l_orderkey AS id, l_partkey AS term, count(*)::BIGINT AS tf FROM lineitem GROUP BY 1, 2")
def text_bag_of_words(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    head = spark.range(3).select(F.col("id").cast("string").alias("value"))
    return text.bag_of_words(spark, _lines(spark, "bag", head.union(counts.select(F.concat_ws(" ", "l_orderkey", "l_partkey", "n")))))


@query("SELECT l_suppkey AS user, l_partkey AS item, l_quantity::DOUBLE AS rating FROM lineitem WHERE l_quantity >= 3")
def text_ratings(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat_ws("::", "l_suppkey", "l_partkey", "l_quantity"))
    return text.ratings(spark, _lines(spark, "ratings", rows))


@query(f"WITH {SETS} SELECT least, most, items, count(*)::BIGINT AS sets FROM (SELECT min(item)::INTEGER AS least, max(item)::INTEGER AS most, count(*)::INTEGER AS items FROM m GROUP BY id) GROUP BY 1, 2, 3")
def text_transactions(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(" ", F.collect_list(F.col("l_partkey").cast("string"))).alias("value")).select("value")  # an order's own parts
    sets = text.transactions(spark, _lines(spark, "transactions", rows), least=5)
    shape = sets.select(F.array_min("items").alias("least"), F.array_max("items").alias("most"), F.size("items").alias("items"))
    return shape.groupBy("least", "most", "items").agg(F.count("*").alias("sets"))


@query("SELECT len(embedding)::BIGINT AS bits, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS ones, count(*)::BIGINT AS rows FROM embeddings GROUP BY 1, 2")
def text_bit_strings(spark, sf):
    rows = _base(spark, sf).select(F.array_join(F.transform(metrics.binarised(F.col("embedding")), lambda b: b.cast("int").cast("string")), ""))
    bits = text.bit_strings(spark, _lines(spark, "bits", rows))
    return bits.select(F.size("bits").cast("long").alias("bits"), F.size(F.filter("bits", lambda b: b)).cast("long").alias("ones")).groupBy("bits", "ones").agg(F.count("*").alias("rows"))


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS price FROM orders WHERE year(o_orderdate) = 1995")
def text_stocks(spark, sf):
    """Rows of one year from CSV files with a Date column."""
    path = new_path(spark, "stocks")
    table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("Date"), "o_orderkey", "o_totalprice").write.option("header", True).csv(path)
    return text.stocks(spark, path, 1995).select(F.col("o_orderkey").cast("long").alias("id"), F.round(F.col("o_totalprice").cast("double"), 2).alias("price"))


@query(f"WITH {V} SELECT (q.vec_id // 50)::BIGINT AS q_id, b.vec_id AS b_id, round({d2('q.e', 'b.e')}, 4) AS dist FROM v q, v b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id AND {d2('q.e', 'b.e')} < 1.4")
def file_range_result(spark, sf):
    base, path = _base(spark, sf), new_path(spark, "range-result")
    found = knn.within(base, _asked(base), 1.4, exclude_self=True).withColumn("q_id", F.expr("q_id div 50"))
    results.write_range(found, path, base.agg(F.max("vec_id")).first()[0] // 50 + 1)
    return _rounded(results.read_range(spark, path), "dist", places=4)


_BYTES = "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: abs(trunc(x::DOUBLE * 100))) AS e FROM embeddings)"


@query(f"WITH {_BYTES} {near(d2('q.e', 'b.e'), 10)}")
def knn_l2_bytes(spark, sf):
    """Squared distances of vectors of unsigned bytes, which are whole numbers."""
    bytes_of = F.transform("embedding", lambda x: F.abs((x.cast("double") * 100).cast("int")).cast("short"))
    base = _base(spark, sf).select("vec_id", bytes_of.alias("embedding"))
    return knn.exact(base, _asked(base), 10).select("q_id", "rank", "b_id", "dist")


@query(f"WITH {V} SELECT q_id, rank, b_id, round(dist, 6) AS dist FROM (SELECT q.vec_id AS q_id, b.vec_id AS b_id, {d2('q.e', 'b.e')} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d2('q.e', 'b.e')}, b.vec_id)::INTEGER AS rank FROM v q, (SELECT * FROM v ORDER BY vec_id LIMIT 100) b WHERE q.vec_id % 50 = 0) WHERE rank <= 10")
def knn_first_rows(spark, sf):
    """The operator that takes the first 100 rows as the base: the limit is the feature."""
    base = _base(spark, sf)
    return _rounded(knn.exact(base.orderBy("vec_id").limit(100), _asked(base), 10), "dist").select("q_id", "rank", "b_id", "dist")


@query(f"WITH {V} SELECT q.vec_id AS q_id, b.vec_id AS b_id, round({d2('q.e', 'b.e')}, 6) AS dist FROM v q, v b WHERE q.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 AND b.label IN (1, 3) AND {d2('q.e', 'b.e')} < 1.4")
def range_search_tracked(spark, sf):
    """Pairs within a distance whose base row is on a list of tracked rows."""
    base = _base(spark, sf)
    tracked = base.where("label in (1, 3) and vec_id % 50 <> 0").select("vec_id")
    return _rounded(knn.within(base.join(tracked, "vec_id", "left_semi"), _asked(base), 1.4), "dist")

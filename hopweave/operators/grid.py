"""Every query against every row, in bounded blocks, without the driver.

A query set of at most BLOCK_BYTES is broadcast, so that the rows stay where they are. A larger one, as where a table
meets itself, makes a grid: queries and rows are dealt to groups, and each cell of the grid is a task's group of both,
bounded whatever the tables' sizes. The plan is the same for any number of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors of a broadcast query set, and of either side of a cell, at most (about, for a cell).
BLOCK_BYTES = 16 << 20
#: Distances that are worked out at once, and pairs found that are held before they are closed.
PAIRS = 1 << 20

#: (query ids, query vectors, a batch of rows) -> a batch of what is found, or nothing.
Each = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], pa.RecordBatch | None]


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """An Arrow list column without nulls, all rows of one length, as a matrix of doubles (or kind)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def pieces(ids: np.ndarray, q: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    wide = max(1, min(len(ids), 1024))
    deep = max(1, PAIRS // wide)
    for i in range(0, len(ids), wide):
        for j in range(0, batch.num_rows, deep):
            yield ids[i : i + wide], q[i : i + wide], batch.slice(j, deep)


def met(rows: DataFrame, queries: DataFrame, each: Each | None, schema: str, closing: Callable[[pa.Table], pa.Table] | None = None, whole: Callable | None = None) -> DataFrame:
    """What `each` finds, for every query (vec_id, embedding) and row (vec_id, embedding, ...); null embeddings take no part.

    closing is applied to what a task found of a broadcast set, or a cell found, before it is shuffled. whole, instead of
    each: (query ids, query vectors, batches of rows) -> a table, for what must be known of a cell's earlier pieces.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long")).where("embedding is not null")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding is not null")
    n, dim = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]
    target = pa.schema(list(zip(names, kinds, strict=True)))

    def found(ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> pa.Table:
        out, size = [], 0
        for b in batches:
            for part in pieces(ids, q, b):
                got = each(*part)
                if got is not None and got.num_rows:
                    out.append(got), (size := size + got.num_rows)
                if closing and size > PAIRS:
                    out = closing(pa.Table.from_batches(out)).to_batches()
                    size = 0
        table = pa.Table.from_batches(out) if out else target.empty_table()
        return closing(table) if closing and out else table

    found = whole or found
    if n * (dim or 0) * 8 <= BLOCK_BYTES:
        held = asked.toArrow()
        shared = spark.sparkContext.broadcast((held.column(0).to_numpy(), matrix(held.column(1))))  # its size was checked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from found(*shared.value, batches).to_batches()

        cores = spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < cores:  # few files: their rows are long work
            rows = rows.repartition(cores)
        return rows.mapInArrow(run, schema)
    groups = -(-n * dim * 8 // BLOCK_BYTES)
    cells = max(-(-rows.count() * dim * 8 // BLOCK_BYTES), -(-spark.sparkContext.defaultParallelism // groups))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    dealt = lambda k: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(k).cast("long"))
    left = asked.withColumn("_a", dealt(groups)).withColumn("_g", every(cells))
    right = rows.withColumn("_g", dealt(cells)).withColumn("_a", every(groups))
    right = right.select([F.col(c).alias(f"r{c}") for c in right.columns])  # a table that meets itself needs names of its own

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return target.empty_table()
        return found(x.column("vec_id").to_numpy(), matrix(x.column("embedding")), iter(y.rename_columns([c[1:] for c in y.column_names]).drop_columns(["_a", "_g"]).to_batches(max_chunksize=4096)))

    return left.groupBy("_a", "_g").cogroup(right.groupBy("r_a", "r_g")).applyInArrow(cell, schema)


def met_by_key(rows: DataFrame, queries: DataFrame, key: str, each: Each, schema: str, closing: Callable[[pa.Table], pa.Table], side: int = 1 << 14) -> DataFrame:
    """met() where a query meets the rows of equal `key` alone; a key's rows and queries beyond `side` make a grid of their own.

    queries has a row for each of a query's keys. Null keys meet nothing.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    empty = pa.schema([(n, {"long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)]).empty_table()

    def sized(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count("*") / side).alias(n))

    parts = sized(rows, "_r").join(sized(queries, "_q"), key)  # a row for each key
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    left = queries.select("vec_id", "embedding", key).join(parts, key).withColumn("_a", dealt("_q")).withColumn("_g", every("_r")).drop("_q", "_r")
    right = rows.select("vec_id", "embedding", key).join(parts, key).withColumn("_g", dealt("_r")).withColumn("_a", every("_q")).drop("_q", "_r")
    right = right.select([F.col(c).alias(f"r{c}") for c in right.columns])

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return empty
        out = []
        for b in y.rename_columns([c[1:] for c in y.column_names]).combine_chunks().to_batches():
            for part in pieces(x.column("vec_id").to_numpy(), matrix(x.column("embedding")), b):
                out.append(each(*part))
        return closing(pa.Table.from_batches(out))

    return left.groupBy(key, "_a", "_g").cogroup(right.groupBy(f"r{key}", "r_a", "r_g")).applyInArrow(cell, schema)


def nearest_of(table: pa.Table, k: int, by: str = "q_id", then: str = "b_id") -> pa.Table:
    """The k rows of each query of least (dist, row)."""
    q, b, d = (table.column(c).to_numpy() for c in (by, then, "dist"))
    order = np.lexsort((b, d, q))
    q = q[order]
    first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return table.take(pa.array(order[place < k]))

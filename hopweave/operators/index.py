"""One handle for an index of any family: build, save, load, search, size, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import results
from . import build, ivf, search


class GraphIndex:
    """hnsw, nsg, vamana or hcnng over (vec_id, embedding)."""

    def __init__(self, family: str, **params):
        if family not in build.FAMILIES:
            raise ValueError(f"unknown family {family!r}; one of {', '.join(build.FAMILIES)}")
        self.family, self.params, self.found = family, params, None

    def build(self, base: DataFrame) -> GraphIndex:
        self.base = base
        self.edges, self.nodes = build.build(base, self.family, **self.params)
        return self

    def save(self, path: str) -> None:
        spark = self.base.sparkSession
        meta = spark.createDataFrame([(self.family, {k: float(v) for k, v in self.params.items()})], "family string, params map<string,double>")
        results.save_index(self.edges, self.nodes, meta, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, base: DataFrame) -> GraphIndex:
        edges, nodes, meta = results.load_index(spark, path)
        row = meta.first()
        out = cls(row.family, **row.params)
        out.base, out.edges, out.nodes = base, edges, nodes
        return out

    def search(self, queries: DataFrame, k: int, ef: int) -> DataFrame:
        """q_id, rank, b_id, dist: in one broadcast shard, or where the shards lie."""
        random = self.family == "hcnng"
        if self.nodes.select("shard").distinct().count() <= 1:
            self.found = search.knn_search(search.load(self.edges, self.nodes, self.base, random), queries, k, ef)
        else:
            self.found = build.sharded_search(self.edges, self.nodes, self.base, queries, k, ef, random)
        return self.found.select("q_id", "rank", "b_id", "dist")

    def comparisons_and_clear(self) -> int:
        """Distances evaluated by the last search."""
        from pyspark.sql import functions as F

        if self.found is None:
            return 0
        total = self.found.groupBy("q_id").agg(F.max("evaluations").alias("e")).agg(F.sum("e")).first()[0] or 0
        self.found = None
        return total

    def index_size(self) -> int:
        return build.index_size(self.edges).first()[0]


class InvertedIndex:
    """Inverted file of `cells` lists after `rounds` of k-means."""

    def __init__(self, cells: int, rounds: int):
        self.cells, self.rounds = cells, rounds

    def build(self, base: DataFrame) -> InvertedIndex:
        self.base = base
        self.centroids = ivf.train(base, self.cells, self.rounds)
        self.assigned = ivf.assign(base, self.centroids)
        return self

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        return ivf.probe(self.base, self.assigned, self.centroids, queries, k, probes)

    def index_size(self) -> int:
        return ivf.index_size(self.assigned, self.centroids).first()[0]

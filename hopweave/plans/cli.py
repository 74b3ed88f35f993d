"""Command line: python -m hopweave build | refine | groundtruth | dataset. Exit codes: 0, 1 (no input), 2 (bad option)."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import build, evaluate, knn, refine
from ..sources import datasets, results, vecfiles
from .ship import shipped


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (vec_id, embedding) or a vector file."""
    if path.rstrip("/").rsplit(".", 1)[-1] in vecfiles.LAYOUTS:
        return vecfiles.read(spark, path)
    return spark.read.parquet(path).select("vec_id", "embedding")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("hopweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="HNSW, NSG and HCNNG indexes of a vector table")
    b.add_argument("--base", required=True)
    b.add_argument("--out-root", required=True)
    for name, value in (("hnsw-m", 16), ("hnsw-efc", 96), ("nsg-r", 64), ("nsg-efc", 256), ("hcnng-s", 7), ("hcnng-t", 15), ("hcnng-ls", 1250)):
        b.add_argument(f"--{name}", type=int, default=value)
    r = sub.add_parser("refine", help="alternate prune and add rounds over a saved index")
    for name in ("base", "query", "index", "out", "log-csv"):
        r.add_argument(f"--{name}", required=True)
    r.add_argument("--gt", help="neighbours table; exact search makes one if absent")
    r.add_argument("--family", choices=sorted(refine.FAMILY), required=True)
    r.add_argument("--iterations", type=int, default=int(os.environ.get("HOPWEAVE_ITERATIONS", 0)) or None)
    r.add_argument("--k", type=int, default=20)
    r.add_argument("--prune-ratio", type=float)
    r.add_argument("--seed-share", type=float)
    g = sub.add_parser("groundtruth", help="exact neighbours as ivecs")
    for name in ("base", "query", "out"):
        g.add_argument(name)
    g.add_argument("k", type=int)
    g.add_argument("--metric", default="squared_l2")
    d = sub.add_parser("dataset", help="split a vector table and save it with exact neighbours")
    d.add_argument("--vectors", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--test-share", type=float, default=0.1)
    d.add_argument("--metric", default="squared_l2")
    d.add_argument("--count", type=int, default=100)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)  # exits with 2 on a bad option
    spark = SparkSession.builder.getOrCreate()
    shipped(spark)
    try:
        base = vectors(spark, a.vectors if a.command == "dataset" else a.base)
    except Exception as e:
        print(f"cannot read the vectors: {e}".splitlines()[0])
        return 1
    if a.command == "build":
        families = {"hnsw": {"m": a.hnsw_m, "efc": a.hnsw_efc}, "nsg": {"r": a.nsg_r, "lc": a.nsg_efc}, "hcnng": {"s": a.hcnng_s, "trees": a.hcnng_t, "leaf": a.hcnng_ls}}
        for family, params in families.items():
            edges, nodes = build.build(base, family, **params)
            meta = spark.createDataFrame([(family, {k: float(v) for k, v in params.items()})], "family string, params map<string,double>")
            results.save_index(edges, nodes, meta, f"{a.out_root}/{family}")
            print(f"{family}: {edges.count()} edges")
    elif a.command == "refine":
        query = vectors(spark, a.query)
        truth = spark.read.parquet(a.gt) if a.gt else knn.exact(base, query, a.k)
        edges, nodes, meta = results.load_index(spark, a.index)
        chosen = {"rounds": a.iterations, "prune_ratio": a.prune_ratio, "seed_share": a.seed_share}
        settings = refine.settings_for(a.family, **{k: v for k, v in chosen.items() if v is not None})
        refined, log = refine.refine(edges, nodes, base, query, truth, settings, a.k)
        results.save_index(refined, nodes, meta, a.out)
        evaluate.append_log(log.coalesce(1), a.log_csv)
    elif a.command == "groundtruth":
        from pyspark.sql import functions as F

        found = knn.exact(base, vectors(spark, a.query), a.k, a.metric)
        rows = found.groupBy(F.col("q_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b_id"))), lambda s: s["b_id"]).alias("embedding"))
        vecfiles.write(rows, a.out, "ivecs")
    else:
        datasets.prepare(base, a.out, a.test_share, a.metric, a.count)
    return 0

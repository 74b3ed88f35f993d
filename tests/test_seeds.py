"""Edge statistics, insertion and the edge sample come from the operator's seeds and real edges."""

from hopweave.operators import refine, search, vectors
from hopweave.plans import catalog

SF = "/root/testdata/sf0.001"


def test_statistics_and_links_are_over_seeds(spark):
    base, edges, _, g = catalog._loaded(spark, SF)
    of = lambda share: base.join(vectors.seeds(base, share), "vec_id", "left_semi")
    trace = search.traces(g, of(0.2), 32).cache()
    want = {(r.src, r.dst): (r.adopted, r.discarded) for r in search.edge_statistics(trace).collect()}
    got = {(r.src, r.dst): (r.adopted, r.discarded) for r in catalog.QUERIES["beam_edge_stats"](spark, SF).where("adopted + discarded > 0").collect()}
    assert got == want
    local = refine.local_edges(g, of(0.1), refine.settings_for("nsg", ef_max=200, jump_max=2))
    assert sorted(map(tuple, catalog.QUERIES["hop_deficit_edges"](spark, SF).collect())) == sorted(map(tuple, local.collect()))


def test_sampled_edges_are_adopted_edges(spark):
    base, edges, _, g = catalog._loaded(spark, SF)
    trace = search.traces(g, base.join(vectors.seeds(base, 0.2), "vec_id", "left_semi"), 32)
    adopted = {(r.src, r.dst) for r in trace.where("adopted = 1").collect()}
    got = {(r.src, r.dst) for r in catalog.QUERIES["adopted_edge_sample"](spark, SF).collect()}
    assert got and got <= adopted and len(got) < 0.1 * len(adopted)
    assert got <= {(r.src, r.dst) for r in edges.collect()}

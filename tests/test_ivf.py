"""The wide inverted-file queries keep the recall that the index is for."""

import pytest

from hopweave.operators import knn
from hopweave.plans import catalog


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_wide_probes_reach_the_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    base = catalog._base(spark, path)
    truth = knn.exact(base, catalog._asked(base), 10)
    assert knn.recall(catalog.QUERIES["ivf_probe_search_wide"](spark, path), truth, 10).first()[0] >= 0.9

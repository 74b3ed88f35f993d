"""The registered refinement loops run with their family's own settings."""

import pytest

from hopweave.operators import refine
from hopweave.plans import catalog


@pytest.mark.parametrize("family", sorted(refine.FAMILY))
def test_loops_take_the_family_settings(spark, monkeypatch, family):
    seen = []
    monkeypatch.setattr(refine, "refine", lambda *a, **k: seen.append(a[5]) or (None, None))
    catalog.QUERIES[f"refine_loop_{family}"](spark, "/root/testdata/sf0.001")
    assert seen == [refine.FAMILY[family]]

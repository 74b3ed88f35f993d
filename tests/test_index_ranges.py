"""Graph files are read in ranges of lists."""

import numpy as np
import pytest

from hopweave.sources import results


@pytest.mark.parametrize("family", ["hnsw", "nsg", "vamana", "hcnng"])
def test_lists_of_any_length_are_read_in_ranges(spark, tmp_path, monkeypatch, family):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(results, "LISTED", 7)
    monkeypatch.setattr(results, "WINDOW", 64)
    tops = [(int(rng.integers(0, 3)) if family == "hnsw" else 0) for _ in range(50)]
    rows = [(level, i, pos, int(v)) for i, top in enumerate(tops) for level in range(top + 1) for pos, v in enumerate(rng.choice(50, int(rng.integers(0, 40)), replace=False))]
    edges = spark.createDataFrame(rows, "level int, src long, pos int, dst long")
    nodes = spark.createDataFrame(list(enumerate(tops)), "id long, level int")
    head = {k: 5 for k, _ in results.HEADERS[family]}
    path = str(tmp_path / family)
    results.write_index(edges, nodes, path, family, head)
    e, n, got = results.read_index(spark, path, family, 50)
    assert got == head and sorted(map(tuple, e.collect())) == sorted(rows)
    assert sorted(map(tuple, n.collect())) == [(i, top, "entry" in head and i == 5) for i, top in enumerate(tops)]
    held = e.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(x > 0 for x in held) > 1  # more than one task has lists
    with open(path, "rb") as f:
        raw = f.read()
    with open(path, "wb") as f:
        f.write(raw[:-2])
    if rows[-1][1] == 49:
        with pytest.raises(Exception, match="ends"):
            results.read_index(spark, path, family, 50)[0].collect()

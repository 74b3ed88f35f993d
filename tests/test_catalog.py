"""Every query of the catalog on the smallest tables: against its SQL where it has one."""

import os

import duckdb
import pyarrow as pa
import pytest

from hopweave.plans import catalog, cell_queries, format_queries, graph_queries  # noqa: F401

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def rows(table: pa.Table):
    """Column names and rows, of Arrow tables: nulls are nulls and whole numbers whole on both sides."""

    def cell(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, list):
            return str([cell(v) for v in x])
        return f"{x:.6f}".replace("-0.000000", "0.000000") if isinstance(x, float) else str(x)

    table = table.select(sorted(table.column_names))
    return table.column_names, sorted(tuple(map(cell, r.values())) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, SF).toArrow()) == rows(con.execute(catalog.ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

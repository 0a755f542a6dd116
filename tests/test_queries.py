"""Every query of the catalogue runs at sf0.001, and gives what its SQL gives in DuckDB."""

import math
import os

import duckdb
import pytest

from tickloom import plans

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def rows(frame):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        return None if v is None or isinstance(v, float) and math.isnan(v) or v != v else v

    columns = sorted(frame.columns)
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(small):
    held = duckdb.connect()
    for t in TABLES:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return held


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, small, name):
    if not os.path.isdir(small):
        pytest.skip("no test data here")
    found = plans.QUERIES[name](spark, small).toPandas()
    if name in plans.SQL:
        wanted = duck.execute(plans.SQL[name]).fetchdf()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)

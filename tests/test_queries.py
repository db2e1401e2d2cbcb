"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

from tessella import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    import numpy as np
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.6g}"
    if isinstance(v, (int, np.integer)) and not isinstance(v, bool):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(int(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


#: Work by steps, which tests/test_marquardt.py, tests/test_surfaces.py, tests/test_planes.py and tests/test_poles.py hold against plain versions.
WITHOUT_SQL = {"peak_fits", "joint_focus", "split_layers", "front_growth", "corner_links", "pole_clusters", "merged_poles", "pole_layers", "periodic_tiles"}


def test_every_other_query_has_sql():
    assert set(registry.queries()) - WITHOUT_SQL == set(registry.oracle_sql())


def test_entry_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())

"""Every library query == its DuckDB SQL, at sf0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from pricelens import plans
from pricelens.sources.tables import TABLES, table_path

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_DIR, t)}')")
    return c


def _rows(df_cols, records):
    cols = sorted(df_cols)
    def norm(v):
        if v is None or v != v:  # NULL, NaN and NaT
            return None
        if isinstance(v, float):
            return round(v, 9)
        if hasattr(v, "tolist"):
            return tuple(v.tolist())
        if isinstance(v, list):
            return tuple(v)
        return v
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_DIR).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.to_dict("records")) == _rows(want.columns, want.to_dict("records"))

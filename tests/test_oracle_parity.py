"""Every registered query matches its DuckDB oracle (rows, columns, values) on the smallest fixture."""

import os

import pytest

os.environ.setdefault("ORACLE_STRICT", "1")  # doubles must be bit-identical to the SQL oracle

import __spark_entry__ as E  # noqa: E402
import oracle_harness as H  # noqa: E402
from paths import SF_SMALL  # noqa: E402

NAMES = sorted(E.oracle_sql())  # model and stream queries have property tests of their own


@pytest.fixture(scope="module")
def duck():
    return H.duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    r = H.compare(spark, name, SF_SMALL, duck, verbose=True)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and sum(r.n_rows for r in rows) == 1000

"""Every registered query with an oracle must equal DuckDB on sf0.01."""
import pytest

import __spark_entry__ as E
from tidewell.plans.catalog import QUERIES
from tidewell.plans.oracle_sql import ORACLE
from tools.check_oracle import canon

from .conftest import SF_ORACLE

NAMES = sorted(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_ORACLE)
    cols, rows = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    dcols, drows = canon([d[0] for d in cur.description], cur.fetchall())
    assert cols == dcols
    assert len(rows) == len(drows)
    assert rows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "ship_year" in df.columns


def test_rows_only_queries_run(spark):
    for name, fn in E.queries().items():
        if name in QUERIES and name not in ORACLE:
            assert fn(spark, SF_ORACLE).count() >= 0, name

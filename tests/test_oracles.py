"""Every registered query against its DuckDB oracle on the smallest scale
factor (the driver runs the same comparison at sf0.01)."""

import pytest

from assay.plans import registry
from assay.plans.compare import compare, diff_rows
from paths import SF_SMALL

registry.load_all()
WITH_ORACLE = sorted(registry.ORACLE)
WITHOUT_ORACLE = sorted(set(registry.QUERIES) - set(registry.ORACLE))


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_query_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    r = compare(df, duck, registry.ORACLE[name])
    assert r["schema_match"], (r["spark_cols"], r["oracle_cols"])
    assert r["rows_spark"] == r["rows_oracle"]
    assert r["value_match"], diff_rows(r)


@pytest.mark.parametrize("name", WITHOUT_ORACLE)
def test_query_without_oracle_runs(spark, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert df.columns


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)

"""Every query of the core library against its SQL."""

import pytest

from stemma import bindings

from .conftest import DATA, SMALL

SQL = bindings.oracle_sql()


@pytest.mark.parametrize("name", sorted(bindings.queries()))
def test_query(spark, same_rows, name):
    df = bindings.queries()[name](spark, SMALL)
    if name in SQL:
        same_rows(df, SQL[name], SMALL)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["evidence_display", "quality_grid", "relationships", "same_as_verdicts", "linkage_tiers", "undo_change_sets"])
def test_larger(spark, same_rows, name):
    same_rows(bindings.queries()[name](spark, DATA), SQL[name], DATA)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

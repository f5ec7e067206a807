"""Every registered core query against its SQL on the smallest tables."""

import pytest
from conftest import DATA, same, shuffled

from weftline.plans import queries as core

Q, SQL = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = same(Q[name](spark, str(DATA)), duck.sql(SQL[name]))
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_others_have_rows(spark, name):
    assert Q[name](spark, str(DATA)).count() > 0


def test_search_hits_shuffles_the_hits_chunks_only(spark):
    chunks = spark.read.parquet(f"{DATA}/chunks.parquet").count()
    hits = Q["search_hits"](spark, str(DATA))
    assert 0 < shuffled(hits)[0] < chunks / 2 and 0 < hits.count() < chunks / 4

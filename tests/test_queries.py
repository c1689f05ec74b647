"""Every registered query of the library against DuckDB, on the smallest tables."""

import pytest

from conftest import assert_same
from mediasift.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [k for k, (_, sql) in REGISTRY.items() if sql])
def test_matches_sql(spark, name):
    run, sql = REGISTRY[name]
    assert_same(spark, run, sql, SF)


@pytest.mark.parametrize("name", [k for k, (_, sql) in REGISTRY.items() if not sql])
def test_rows_only(spark, name):
    assert REGISTRY[name][0](spark, SF).count() > 0


def test_stream_gives_the_batch_result(spark):
    from mediasift.operators.index import upsert
    from mediasift.plans.queries import _hash_vector, _index_rows
    from mediasift.plans.views import view
    from mediasift.sources.store import INDEX

    batch = _index_rows(upsert(spark.createDataFrame([], INDEX), _hash_vector(view(spark, SF, "listing"))))
    assert sorted(REGISTRY["stream_upsert"][0](spark, SF).collect()) == sorted(batch.collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query with a SQL oracle gives the oracle's rows on the smallest tables."""

import oracle
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from carelake.plans.catalog import REGISTRY


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.oracle])
def test_matches_oracle(spark, con, name):
    q = REGISTRY[name]
    assert oracle.compare(q.build(spark, SMALL), con, q.oracle) is None


@pytest.mark.parametrize("name", ["embed_corpus", "vector_topk_probed", "search_recall", "rf_train_eval"])
def test_rows_only(spark, name):
    assert REGISTRY[name].build(spark, SMALL).count() > 0


def test_driver_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

import pytest
from compare import oracle_rows, rows_of
from conftest import SF

from fotonflow.plans.catalogue import ORACLES, QUERIES


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle_rows(ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "fold" in n))
def test_fold_equals_oracle_on_more_rows(spark, name):
    assert rows_of(QUERIES[name](spark, SF.replace("0.001", "0.01"))) == oracle_rows(ORACLES[name], SF.replace("0.001", "0.01"))


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 500


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["event_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]

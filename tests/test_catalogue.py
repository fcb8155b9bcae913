import pytest

from strata.plans.catalogue import ORACLES, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_checks_find_the_damage_and_nothing_else(spark):
    out = QUERIES["crc_check"](spark, SF).collect()
    assert {r.ok for r in out} == {True, False} and all(r.ok == (r.page_id % 7 != 3) for r in out)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", ["ahocorasick", "corpus_pipeline", "strata.llm"])
def test_entry_without_the_training_data_package(missing):
    """Another process, in which a module cannot be imported: the other queries are there all the same."""
    import pathlib
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=pathlib.Path(__file__).parents[1], check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


def test_scan_prunes_columns_and_pushes_bounds(spark):
    from strata.operators import resolve
    from strata.plans.fixtures import kv_orders

    df = resolve.scan(kv_orders(spark, SF), "12", "5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in plan and "o_totalprice" not in plan
    assert "Exchange" in plan and plan.count("Exchange hashpartitioning") == 1

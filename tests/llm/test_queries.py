import pytest

from strata.llm.queries import ORACLES, QUERIES

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_nothing_else_imports_this_package():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "strata"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


@pytest.mark.parametrize("name", ["op4_bitplane_tokens", "op5_simhash_variants"])
def test_whole_table(name, spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES[name](spark, SF).count() == n

import pytest

from brindle import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(name, against_sql, sf_dir):
    against_sql(catalog.QUERIES[name], catalog.SQL[name], sf_dir)


def test_salting_moves_load_without_changing_it(spark, sf_dir):
    plain = catalog.QUERIES["reducer_load"](spark, sf_dir).collect()
    salted = catalog.QUERIES["salted_reducer_load"](spark, sf_dir).collect()
    assert sum(r["records"] for r in plain) == sum(r["records"] for r in salted) > 0
    assert len(salted) == catalog.REDUCERS


def test_entry_imports_and_lists_every_query(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

"""The registered queries of the corpus operators against their SQL, and the guard of the entry point."""

import pytest
from rows import rows

import __spark_entry__ as entry
from labelq.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_all_are_registered():
    names = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 11)} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())

import pytest

import __spark_entry__ as entry
from genoframe.plans import problems
from oracle import DATA, connect, difference

PARTS = [p for p in entry._PARTS if ".llm" not in p.__name__]
NAMES = sorted(n for p in PARTS for n in p.ORACLE)
#: Positions of called kinds seldom coincide in the tables: at 0.001 and 0.01 these give no row.
EMPTY = {"altered_calls", "personal_population_calls"}


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert not difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], f"{DATA}/sf0.001")


def test_twins_have_rows_to_compare():
    larger = connect(f"{DATA}/sf0.01")
    sql = entry.oracle_sql()
    counts = {n: larger.execute(f"select count(*) from ({sql[n]})").fetchone()[0] for n in NAMES}
    assert {n for n, k in counts.items() if not k} == EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert problems.QUERIES

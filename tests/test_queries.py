import pytest

from tessella.registry import ORACLES, QUERIES
from tests.compare import connection, difference

FOLDER = "/root/testdata/sf0.001"
#: Queries that SQL cannot express; other tests hold them against hand-made cases or numpy.
BEYOND_SQL = {"VE4", "VE9", "VE11", "RS7_full", "RS8_full", "RS9_full", "RS10_full", "RS10_davies_bouldin", "RS10_auc", "RS11_full"}


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_has_sql_or_another_test():
    assert set(QUERIES) - set(ORACLES) == BEYOND_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    found = difference(spark, name, QUERIES[name], ORACLES[name], FOLDER, con)
    assert found is None or found.endswith("no rows"), found


@pytest.mark.parametrize("name", sorted(n for n in BEYOND_SQL if n.startswith("VE") and n != "VE9"))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())

import pytest

from citeweave.plans.registry import load
from tests.compare import canonical, connect

BASE = "/root/testdata/sf0.001"
SLOW = {"kg_communities", "kg_label_propagation", "deep_answers", "survey_themes", "sectioned_answers"}
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def duck():
    return connect(BASE)


def test_names_are_consistent():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 80


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, BASE).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, BASE).count() > 0

"""Every registered query against its SQL, and the entry points."""

import pytest

import __spark_entry__ as entry
from lifetrack.session import release
from lifetrack.plans import catalogue
from tests.oracle import compare, connect

#: At the smaller size some group is always large, at the larger one hardly any.
FOLDERS = [f"/root/testdata/sf{sf}" for sf in ("0.001", "0.01")]


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in FOLDERS}


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("folder", FOLDERS, ids=lambda f: f.rsplit("/", 1)[1])
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, connections, name, folder):
    verdict, _, _ = compare(spark, connections[folder], folder, catalogue.QUERIES[name], catalogue.ORACLES[name])
    release(spark)
    assert verdict == ""

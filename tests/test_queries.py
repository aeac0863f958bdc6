"""Every registered query against its SQL on the smallest tables."""

import pytest

from oracle import connect, same_rows
from papyra.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    same_rows(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys, papyra.plans.registry, papyra.sources.shards, papyra.streaming.incremental; assert not any(m.startswith('papyra.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)

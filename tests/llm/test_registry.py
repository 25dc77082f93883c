import re

import pytest

import __spark_entry__ as driver
from seamstat.llm import registry
from seamstat.sources.scratch import shared_folder
from workload.compare import connect, differences

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    numbers = [int(m[1]) for name in registry.QUERIES if (m := re.match(r"op(\d+)_", name))]
    assert set(numbers) <= set(range(1, 14)) and len(numbers) == len(set(numbers)) and "pipeline" in registry.QUERIES
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    assert len(got) and differences(got, connect(SMALL).execute(registry.SQL[name]).df()) == ""


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: "file:/shared-by-all")})

    assert shared_folder(Cluster) == "file:/shared-by-all"

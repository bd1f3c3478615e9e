"""The odd documents as tables."""

import pytest
from odd_cases import SCHEMA, TEXTS

from attrix.llm.common import ship


@pytest.fixture(scope="session")
def odd(spark):
    ship(spark)
    rows = [(i, t, "en", "s", 1, "x", "x", "x", "x", "x", "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.where("false")

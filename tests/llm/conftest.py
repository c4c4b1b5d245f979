import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import tables  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return tables.docs(spark).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return tables.docs(spark, [])

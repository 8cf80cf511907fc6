"""Every query of the catalog against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__  # noqa: F401  (finds the package)
import check_oracle
from cohortspark.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_agrees(spark, con, name):
    ok, note = check_oracle.compare(spark, con, SF, name)
    assert ok, note

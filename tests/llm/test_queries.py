"""The queries of this package that have SQL, against it, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from faultline.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF_DIR = os.environ.get("FAULTLINE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR) is None

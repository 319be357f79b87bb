"""The permutation query with the operator's 10,000 shuffles."""

import os

import pytest

import attestor.plans.queries_scores  # noqa: F401
from attestor.plans.registry import QUERIES

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="the tables are not there")


def test_p_values_are_of_ten_thousand_shuffles(spark):
    beyond = [r["p_value"] * 10_000 for r in QUERIES["perm_test"](spark, PATH).collect()]
    assert len(beyond) == 5 and all(abs(b - round(b)) < 1e-6 for b in beyond)
    assert any(round(b) % 50 for b in beyond)

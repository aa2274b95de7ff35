"""Filters on the class ladder."""

import pytest

from tallyspark.plans import registry


@pytest.mark.parametrize("name, more", [("D22_unclassified", 0), ("D19_unbooked_loans", 3), ("N6_loan_lists", 0)])
def test_a_filter_on_the_ladder_does_not_repeat_it(spark, sf, name, more):
    patterns = lambda q: registry.QUERIES[q](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert patterns(name) <= patterns("C00_classify") + more

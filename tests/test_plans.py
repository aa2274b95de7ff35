"""Plans: every pattern of the ladder and the detectors runs once a row, however many figures are asked of it."""

import pytest

from tallyspark.plans import registry


def patterns(spark, sf, name):
    return registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")


@pytest.mark.parametrize("name, more", [("A03_J06_buckets", 0), ("A05_net_totals", 0), ("A04_account_months", 3), ("A10_consolidated", 3), ("R01_flags", 20)])
def test_the_ladder_is_evaluated_once(spark, sf, name, more):
    assert patterns(spark, sf, name) <= patterns(spark, sf, "C00_classify") + more

"""Recognised days whose nearest balances do not add up to the printed totals."""

import pytest

from tallyspark.sources import cascades as X


@pytest.mark.parametrize("late", [False, True])
def test_a_days_first_or_last_balances_are_taken_where_the_totals_say_so(spark, late):
    days = (("01/02/2024", 900.0), ("02/02/2024", 200.0), ("03/02/2024", 260.0))
    texts = [(1, "Bal B/F 1,000.00"), (1, "Total Debit 2 800.00 Total Credit 60.00")]
    for day, balance in days:
        pair = [(2, f"{day} READ {balance:,.2f}"), (2, f"{day} WRONG {balance + 500:,.2f}")]
        texts += pair[::-1] if late else pair
    lines = spark.createDataFrame([("f-scan", p, k, t) for k, (p, t) in enumerate(texts)], "file string, page int, line int, text string")
    rows = X.islam_read(lines)[0].orderBy("line").collect()
    assert [(r.description, r.debit, r.credit, r.balance) for r in rows] == [("READ", 100.0, 0.0, 900.0), ("READ", 700.0, 0.0, 200.0), ("READ", 0.0, 60.0, 260.0)]

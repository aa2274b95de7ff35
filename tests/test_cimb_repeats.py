"""Rows printed again are one; rows that are equal because amounts between them cancel out are all kept."""

import pytest

from tallyspark.sources import cascades as X

#: Day, credit less debit and balance in the order of time; the third and the fifth equal the first.
MOVES = ((1, 100, 1100), (1, -100, 1000), (1, 100, 1100), (1, -100, 1000), (1, 100, 1100), (2, 50, 1150), (2, 30, 1180), (3, 20, 1200))


def cell(day, text, move, balance):
    money = lambda v: f"{v:,.2f}" if v > 0 else None
    return [f"{day:02d}/03/2024", text, "R", money(-move), money(move), money(balance)]


def rows_of(spark, printed, found):
    cells = spark.createDataFrame([("f", 1, k, x) for k, x in enumerate(printed)], "file string, page int, row int, cells array<string>")
    lines = spark.createDataFrame([("f", 1, 1, "CLOSING BALANCE / BAKI PENUTUP 1,200.00")], "file string, page int, line int, text string")
    return [(r.description, r.credit - r.debit, r.balance) for r in X.cimb(lines, cells, found).where("NOT marker").orderBy("seq").collect()]


@pytest.mark.parametrize("forward, found", [(False, False), (False, True), (True, True)])
def test_equal_rows_of_the_balance_chain_stay(spark, forward, found):
    rows = [cell(d, f"row {k}", m, b) for k, (d, m, b) in enumerate(MOVES)]
    again = lambda rs: [[r[0], "again", *r[2:]] for r in rs]
    # every row again right behind it, and two rows again as a page's first ones
    order, at = (rows, 7) if forward else (rows[::-1], 3)
    printed = [x for k, r in enumerate(order) for x in ([*again(order[at - 2 : at]), r] if k == at else [r]) + again([r])]
    assert rows_of(spark, printed, found) == [(f"row {k}", float(m), float(b)) for k, (_, m, b) in enumerate(MOVES)]


def test_equal_rows_of_text_stay(spark):
    texts = ["TARIKH PENYATA : 05/03/2024", "OPENING BALANCE 1,000.00", *(f"{d:02d}/03/2024 row {k} {abs(m):.2f} {b:,.2f}" for k, (d, m, b) in reversed(list(enumerate(MOVES))))]
    lines = spark.createDataFrame([("f", 1, k, t) for k, t in enumerate(texts)], "file string, page int, line int, text string")
    got = [(r.credit - r.debit, r.balance) for r in X.cimb(lines).where("NOT marker").orderBy("seq").collect()]
    assert got == [(float(m), float(b)) for _, m, b in MOVES]

"""Ambank: what its lines cost on long tables, and what a page without rows says for its file."""

from tallyspark.sources import markers as K

SCHEMA = "file string, page int, line int, text string"


def test_lines_are_read_once_and_followed_page_by_page(spark):
    plan = K.ambank(spark.createDataFrame([("f", 1, 1, "05-Jan X 1.00 2.00")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    windows = [x for x in plan.splitlines() if "Window [" in x]
    below = plan[plan.index("Aggregate [") :].splitlines()
    assert len(windows) > 3 and all(", page#" in x.split("], [")[1] for x in below if "Window [" in x)


def test_a_first_page_without_rows_gives_year_and_opening(spark):
    lines = [
        ("a", 1, 1, "Statement Date : 01/02/2024 - 29/02/2024"), ("a", 1, 2, "Opening Balance"), ("a", 1, 3, "100.00"), ("a", 2, 1, "Statement Date : 01/02/2023 - 28/02/2023"), ("a", 2, 2, "29-Feb PAID 130.00"), ("a", 2, 3, "30-Feb NEVER 9.00 9.00"),
        ("a", 2, 4, "MORE 8.00"), ("a", 3, 1, "Balance Brought Fwd 120.00"), ("a", 3, 2, "01 Mar X 110.00"), ("b", 1, 1, "Hello"), ("b", 2, 1, "Statement Date / Tarikh Penyata : 31/01/2024"), ("b", 2, 2, "05-Jan LOST 1.00 2.00"),
    ]
    rows = K.ambank(spark.createDataFrame(lines, SCHEMA)).orderBy("file", "seq").collect()
    assert [(r.file, r.seq, r.page, str(r.dt), r.description, r.debit, r.credit, r.balance, r.marker) for r in rows] == [
        ("a", 1, 3, "2024-02-01", "Balance Brought Fwd", 0.0, 0.0, 120.0, True), ("a", 2, 2, "2024-02-29", "PAID", 0.0, 30.0, 130.0, False), ("a", 3, 3, "2024-03-01", "X", 10.0, 0.0, 110.0, False),
    ]

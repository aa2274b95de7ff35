"""Plans: what words and their lines cost on long tables."""

from tallyspark.sources import words as W

SCHEMA = "file string, page int, x0 double, y0 double, x1 double, text string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(*lines) -> list:
    return [(*at, x + 14.0 * i, float(y), x + 14.0 * i + 12, t) for at, x, y, text in lines for i, t in enumerate(text.split(" "))]


def test_lines_are_cut_out_of_their_page_without_a_second_grouping(spark):
    lined = W.visual_lines(spark.createDataFrame([("f", 1, 20.0, 100.0, 32.0, "a")], SCHEMA), 2.0)
    assert plan(lined).count("Aggregate [") == 1
    made = [("f", 1, 9.0, 10.0, 9.5, "b"), ("f", 1, 1.0, 12.0, 2.0, "a"), ("f", 1, 5.0, 13.5, 6.0, "c"), ("f", 1, 0.0, 13.5, 1.0, "d"), ("f", 1, 0.0, 10.0, 1.0, " ")]
    got = lambda anchored: [(r.line, r.y, [w.text for w in r.words]) for r in W.visual_lines(spark.createDataFrame(made, SCHEMA), 2.0, anchored).orderBy("line").collect()]
    assert got(True) == [(1, 10.0, ["a", "b"]), (2, 13.5, ["d", "c"])]
    assert got(False) == [(1, 10.0, ["a", "b"]), (2, 13.5, ["d", "c"])]


def test_an_amount_is_read_once(spark):
    read = {"1.OO": 1.0, "o.5O": 0.5, "(5.00)": -5.0, "5.00-": -5.0, "(5.00": 5.0, "RM 5.00": 5.0, "5,000.00.": 5000.0, "|.50": None, ".50|": 0.5, "|1.50": 1.5, "1234": None, "PAY.ME": None, "": None}
    got = spark.createDataFrame([(t,) for t in read], "t string").select("t", W.affin_money(W.c("t")).alias("v"))
    assert {r.t: r.v for r in got.collect()} == read
    assert plan(got).count("RLIKE") + plan(got).count("regexp_extract") <= 4
    assert plan(W.affin(spark.createDataFrame([("f", 1, 20.0, 100.0, 32.0, "a")], SCHEMA))).count("RLIKE") <= 8


def test_rakyat_reads_words_once_and_joins_nothing(spark):
    parsed = plan(W.rakyat(spark.createDataFrame([("f", 1, 20.0, 100.0, 32.0, "a")], SCHEMA)))
    assert parsed.count("LogicalRDD") == 1 and "Join" not in parsed


def test_rakyat_takes_an_opening_from_a_page_without_rows(spark):
    page = lambda file, n, *lines: words(*(((file, n), x, y, t) for x, y, t in lines))
    head, sums = (20, 10, "TARIKH DATE"), (20, 90, "OPENING BALANCE")
    row = lambda y, day, text, balance: [(20, y, day), (100, y, "4321"), (150, y, text), (512, y, balance)]
    made = page("a", 1, head, *row(40, "02/02/2024", "TWO", "80.00")) + page("a", 2, head, *row(40, "01/02/2024", "ONE", "90.00"), (300, 60, "7.00"), (400, 70, "8.00"))
    made += page("a", 3, head, sums, (20, 100, "77.50 1.00 2.00 80.00")) + page("a", 4, (20, 90, "OPENING BALANCE"), (20, 100, "1.00 1.00 1.00 1.00")) + page("b", 1, head, *row(40, "01/02/2024", "ALONE", "5.00"))
    rows = W.rakyat(spark.createDataFrame(made, SCHEMA)).orderBy("file", "seq").collect()
    assert [(r.file, r.seq, r.page, r.description, r.debit, r.credit, r.balance, r.opening) for r in rows] == [("a", 1, 2, "ONE", 7.0, 8.0, 90.0, 77.5), ("a", 2, 1, "TWO", 10.0, 0.0, 80.0, 77.5), ("b", 1, 1, "ALONE", 0.0, 0.0, 5.0, None)]

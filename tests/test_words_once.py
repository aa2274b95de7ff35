"""Plans: words are put into lines once, whatever a layout asks of them."""

import pytest

from tallyspark.sources import markers as K
from tallyspark.sources import words as W


@pytest.mark.parametrize("parse", [K.agro, W.muamalat])
def test_words_are_read_once(spark, parse):
    words = spark.createDataFrame([("f", 1, 20.0, 100.0, 32.0, "01/02/24", 760.0)], "file string, page int, x0 double, y0 double, x1 double, text string, width double")
    assert parse(words)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_totals_of_a_page_without_rows_and_tops_count(spark):
    word = lambda page, x, y, text: [("f", page, x + 14.0 * i, float(y), x + 14.0 * i + 12, t) for i, t in enumerate(text.split(" "))]
    made = word(1, 20, 100, "01/02/24 BEGINNING BALANCE") + word(1, 400, 100, "100.00") + word(1, 20, 120, "02/02/24 PAID") + word(1, 400, 120, "70.00")
    tops = word(2, 20, 10, "Aktiviti Akaun Anda") + word(2, 200, 30, "GOES ON") + word(3, 20, 10, "Aktiviti Akaun Anda") + word(3, 200, 30, "AND ON")
    totals = word(4, 20, 10, "TOTAL DEBIT 31.00") + word(4, 20, 30, "TOTAL CREDIT .00")
    rows = K.agro(spark.createDataFrame(made + tops + totals, "file string, page int, x0 double, y0 double, x1 double, text string")).orderBy("seq").collect()
    assert [(r.description, r.debit, r.marker, r.check) for r in rows] == [("BEGINNING BALANCE", 0.0, True, "#"), ("PAID | GOES ON | AND ON", 30.0, False, "#")]

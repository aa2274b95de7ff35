"""Folds over long files, and what their steps compute in Python as Spark does."""

from tallyspark.sources import cascades as X
from tallyspark.sources import words as W


def test_a_long_file_is_folded_without_a_list_of_its_rows(spark):
    rows = spark.range(200_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' END AS file", "id AS seq", "array(id) AS kept", "CAST(id AS DOUBLE) AS v")
    done = W.folded(rows, ("seq",), ("v",), (0.0,), {"sum": "double"}, lambda s, v: ((s[0] + v,), (s[0] + v,)))
    assert "collect_list" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert done.where("sum <> CASE WHEN file = 'a' THEN seq * (seq + 2) / 4 ELSE (seq + 1) * (seq + 1) / 4 END OR kept[0] <> seq").count() == 0
    assert done.count() == 200_000 and W.folded(rows.limit(0), ("seq",), ("v",), (0.0,), {"sum": "double"}, lambda s, v: (s, s)).count() == 0


def test_cents_are_rounded_as_spark_does(spark):
    values = [0.005, -0.005, 1.005, 2.675, -2.675, 1e17 + 0.5, 123456789.125, -0.001, 0.0, 1e-9, 1e300, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 2) AS r").collect()
    assert [r.r for r in got] == [W.cents(v) for v in values]


def test_details_are_cut_in_python_as_in_spark(spark):
    texts = ["", "x", "Fund  Trf a DR", "aDR DR", "IBG DR x", "CHQé CHQ", "KRENTAS rentas,x", "OD INT CHARGE OD  INTEREST x", "CASHX CASH"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X._cut_at_details(X.c("t")).alias("p")).collect()
    assert [r.p for r in got] == [X._pieces(t) for t in texts]

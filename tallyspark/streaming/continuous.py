"""Continuous forms of the batch operators, on Structured Streaming with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import flagged

#: A return comes within five business days, so events may wait a week.
LATE = "7 days"


def stamped(tx: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP (a watermark takes no TIMESTAMP_NTZ)."""
    return tx.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATE)


def dedupe_stream(tx: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return stamped(tx).dropDuplicatesWithinWatermark(list(keys))


def daily_totals(tx: DataFrame) -> DataFrame:
    """Rows and sums per account and day, closed once the watermark has passed."""
    w = stamped(tx).groupBy(F.window("ts", "1 day"), "account_no")
    return w.agg(F.count("*").alias("n"), F.sum("credit").cast("double").alias("credits"), F.sum("debit").cast("double").alias("debits")).select("account_no", F.to_date("window.start").alias("dt"), "n", "credits", "debits")


def repeats(tx: DataFrame, length: str = "7 days", step: str = "1 day", least: int = 3) -> DataFrame:
    """Sliding windows in which an account has one description on three or more rows."""
    w = stamped(tx).groupBy(F.window("ts", length, step), "account_no", "description")
    return w.agg(F.count("*").alias("n")).where(F.col("n") >= least).select("account_no", "description", F.col("window.start").cast("date").alias("first_day"), "n")


def sessions(tx: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Bursts of activity of an account: sessions that end after a gap."""
    w = stamped(tx).groupBy(F.session_window("ts", gap), "account_no")
    return w.agg(F.count("*").alias("n")).select("account_no", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def detector_totals(tx: DataFrame) -> DataFrame:
    """Detector counts per day."""
    from ..operators.detect import DETECTORS

    w = flagged(stamped(tx)).groupBy(F.window("ts", "1 day"))
    return w.agg(*(F.count_if(k).alias(k) for k in DETECTORS)).select(F.to_date("window.start").alias("dt"), *DETECTORS)


def pair_stream(out: DataFrame, back: DataFrame) -> DataFrame:
    """J07's candidates as an interval join of two streams: equal account and cents, credit within nine days."""
    o = out.select(F.col("row_order").alias("dr"), "account_no", F.col("ts").cast("timestamp").alias("dr_ts"), F.round(F.col("debit") * 100).cast("bigint").alias("cents")).withWatermark("dr_ts", LATE)
    b = back.select(F.col("row_order").alias("cr"), F.col("account_no").alias("b_account"), F.col("ts").cast("timestamp").alias("cr_ts"), F.round(F.col("credit") * 100).cast("bigint").alias("b_cents")).withWatermark("cr_ts", LATE)
    return o.join(b, F.expr("account_no = b_account AND cents = b_cents AND cr_ts >= dr_ts AND cr_ts <= dr_ts + interval 9 days")).select("account_no", "dr", "cr", "dr_ts", "cr_ts")

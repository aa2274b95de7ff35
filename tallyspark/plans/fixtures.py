"""Deterministic projections of the driver's tables into transactions; one SQL text for Spark and for the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENT = """
b AS (
 SELECT o_orderkey AS row_order, o_custkey % 10 AS account_no, CAST(o_orderdate AS DATE) AS dt,
  CASE WHEN o_orderstatus='F' OR (o_orderstatus='P' AND o_orderkey % 2 = 0) THEN 'CR' ELSE 'DR' END AS side,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN FLOOR(o_totalprice/10000)*10000 + 10000 ELSE o_totalprice END AS DECIMAL(18,2)) AS amount,
  CASE CAST(o_orderkey % 16 AS INT)
   WHEN 0 THEN 'EPF DPE CONTRIBUTION'  WHEN 1 THEN 'PERKESO SOCSO PAYMENT' WHEN 2 THEN 'STAFF SALARY JAN' WHEN 3 THEN 'LHDN CP204'
   WHEN 4 THEN 'IBG TRANSFER OUT'      WHEN 5 THEN 'IBG INWARD RETURN'     WHEN 6 THEN 'CDM CASH DEPOSIT' WHEN 7 THEN 'HSE CHQ DEPOSIT'
   WHEN 8 THEN 'RETURN CHQ'            WHEN 9 THEN 'LOAN REPAYMENT'        WHEN 10 THEN 'SERVICE TAX 8%'  WHEN 11 THEN 'OPENING BALANCE'
   WHEN 12 THEN 'FOREX USD 1,000'
   WHEN 15 THEN CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'HRDF LEVY' WHEN 1 THEN 'CREDIT REVERSAL' WHEN 2 THEN 'CASH CHQ DR' WHEN 3 THEN 'CLRG CHQ DR' ELSE 'LOAN DISB' END
   ELSE CONCAT('PAYMENT TO SUPPLIER ', CAST(o_custkey % 37 AS VARCHAR(10)), ' SDN BHD') END AS description
 FROM {orders}),
c AS (SELECT *, CASE WHEN side='CR' THEN amount ELSE CAST(0 AS DECIMAL(18,2)) END AS credit,
                CASE WHEN side='DR' THEN amount ELSE CAST(0 AS DECIMAL(18,2)) END AS debit FROM b),
statement AS (SELECT *, CASE WHEN row_order % 11 = 0 THEN NULL ELSE 50000 +
   SUM(credit-debit) OVER (PARTITION BY account_no ORDER BY dt,row_order ROWS UNBOUNDED PRECEDING) END AS balance FROM c)"""

RETURNS = """,
statement_returns AS (
 SELECT row_order, account_no, dt, credit, debit, description FROM statement
 UNION ALL
 SELECT row_order + 100000000, account_no, dt + CAST(row_order % 11 AS INT), debit, CAST(0 AS DECIMAL(18,2)),
   CASE WHEN CAST(FLOOR(row_order/16) AS BIGINT) % 2 = 0 THEN 'IBG INWARD RETURN' ELSE 'MISC CREDIT' END
 FROM statement WHERE debit > 0 AND description = 'IBG TRANSFER OUT' AND row_order % 3 = 0
 UNION ALL
 SELECT row_order + 200000000, account_no, dt + CAST(row_order % 11 + 1 AS INT), debit, CAST(0 AS DECIMAL(18,2)), 'MISC CREDIT'
 FROM statement WHERE debit > 0 AND description = 'IBG TRANSFER OUT' AND row_order % 15 = 0)"""

ACTIVITY = """
activity AS (SELECT event_id AS row_order, user_id AS account_no, CAST(ts AS DATE) AS dt, ts, event_type AS description,
  CAST(CASE WHEN event_type IN ('purchase','signup') THEN value ELSE 0 END AS DECIMAL(18,2)) AS credit,
  CAST(CASE WHEN event_type IN ('purchase','signup') THEN 0 ELSE value END AS DECIMAL(18,2)) AS debit FROM {events})"""

#: Text as it comes from statements: padded descriptions, amounts and dates in mixed notation.
MESSY = """,
messy AS (SELECT row_order, account_no, dt, side, amount, credit, debit, balance, description,
  CASE row_order % 4 WHEN 0 THEN CONCAT('  ', description, '   REF  ', CAST(row_order AS VARCHAR(20)), ' ') WHEN 1 THEN CONCAT(description, ' * 12345678') WHEN 2 THEN NULL ELSE description END AS raw_text,
  CASE row_order % 8 WHEN 0 THEN CONCAT('(', CAST(amount AS VARCHAR(30)), ')') WHEN 1 THEN CONCAT(CAST(amount AS VARCHAR(30)), '-') WHEN 2 THEN CONCAT('RM ', CAST(amount AS VARCHAR(30)))
    WHEN 3 THEN 'abc' WHEN 4 THEN CONCAT(CAST(amount AS VARCHAR(30)), '+') WHEN 5 THEN '' WHEN 6 THEN NULL ELSE CONCAT('1,', CAST(100 + row_order % 800 AS VARCHAR(10)), '.50') END AS raw_amount,
  CASE row_order % 5 WHEN 0 THEN CAST(dt AS VARCHAR(10)) WHEN 1 THEN CONCAT(SUBSTRING(CAST(dt AS VARCHAR(10)), 9, 2), '/', SUBSTRING(CAST(dt AS VARCHAR(10)), 6, 2), '/', SUBSTRING(CAST(dt AS VARCHAR(10)), 1, 4))
    WHEN 2 THEN CONCAT(SUBSTRING(CAST(dt AS VARCHAR(10)), 9, 2), '-', SUBSTRING(CAST(dt AS VARCHAR(10)), 6, 2), '-', SUBSTRING(CAST(dt AS VARCHAR(10)), 1, 4)) WHEN 3 THEN 'n/a' ELSE NULL END AS raw_date
  FROM statement)"""


def _frame(spark: SparkSession, sf_dir: str, body: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "events") if f"{{{t}}}" in body}
    return spark.sql(f"WITH {body} SELECT * FROM {name}", **used)


def _month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("dt", "yyyy-MM"))


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month(_frame(spark, sf_dir, STATEMENT, "statement"))


def statement_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, STATEMENT + RETURNS, "statement_returns")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, STATEMENT + MESSY, "messy")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, ACTIVITY, "activity")


def sql(select: str, *parts: str, more: str = "") -> str:
    """The check's SQL: the projections, ``st`` with a month, further CTEs and the query itself."""
    body = "".join(parts or (STATEMENT,)).replace("{orders}", "orders").replace("{events}", "events")
    month = ", st AS (SELECT *, strftime(dt, '%Y-%m') AS month FROM statement)" if "statement AS" in body else ""
    return f"WITH {body}{month}{', ' + more if more else ''} {select}"

"""Queries of detectors, dedupe, classification, patterns and pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import detect as D
from ..operators import ledger as L
from ..operators import monthly as M
from . import sqltext as T
from .fixtures import ACTIVITY, RETURNS, STATEMENT, activity, sql, statement, statement_returns
from .scalars import FP, WEEK

c = F.col
COMPANIES, RELATED = ("SUPPLIER 11",), ("SUPPLIER 22",)


def classified(spark, d):
    return D.classify(L.with_party(statement(spark, d)), COMPANIES, RELATED)


def detector(name):
    def run(spark, d):
        return D.flagged(statement(spark, d)).where(name).select("row_order", "account_no", "month", "side9")

    return run


QUERIES = {
    **{k: detector(k) for k in D.DETECTORS},
    "D01_round_credits": lambda s, d: D.round_credits(statement(s, d)).select("row_order", c("credit").cast("double").alias("credit")),
    "D02_large_credits": lambda s, d: D.large_credits(statement(s, d)).select("row_order", c("credit").cast("double").alias("credit")),
    "D03_J05_high_value_credits": lambda s, d: D.high_value_credits(statement(s, d)).select("row_order", c("credit").cast("double").alias("credit"), F.round("eod_average", 2).alias("eod_average")),
    "D04_D20_totals": lambda s, d: D.totals(statement(s, d), "account_no"),
    "D19_unbooked_loans": lambda s, d: D.unbooked_loans(classified(s, d).withColumn("description", F.when(c("row_order") % 5 == 0, F.concat("description", F.lit(" FINANCING"))).otherwise(c("description")))).select("row_order"),
    "D20_channel_blind": lambda s, d: D.channel_blind(statement(s, d)),
    "D21_small_payroll": lambda s, d: D.small_payroll(statement(s, d)),
    "D22_unclassified": lambda s, d: D.booked(classified(s, d)).where(c("primary").isNull() & (F.greatest("credit", "debit") >= R.LISTED_UNCLASSIFIED)).select("row_order", "description", F.greatest("credit", "debit").cast("double").alias("amount")),
    "D23_balance_rows": lambda s, d: statement(s, d).where(D.has(R.BALANCE_ROW)).select("row_order", "description"),
    "D25_high_value_rows": lambda s, d: D.high_value(statement(s, d), 100000).groupBy("account_no").agg(F.count_if("is_high_value").alias("n"), F.count("*").alias("rows")),
    "D26_round_share": lambda s, d: D.round_share(statement(s, d), "account_no"),
    "D27_large_transactions": lambda s, d: statement(s, d).where(F.greatest("credit", "debit") >= 250000).select("row_order", F.when(c("credit") > 0, "CR").otherwise("DR").alias("way"), F.greatest("credit", "debit").cast("double").alias("amount")).orderBy(F.desc("amount"), "row_order"),
    "D28_round_transactions": lambda s, d: D.round_rows(statement(s, d)).select("row_order", "signed"),
    "D29_D30_company_trace": lambda s, d: D.token_hits(statement(s, d), "SUPPLIER PAYMENT HOLDINGS SDN BHD", 2).select("row_order", c("hits").cast("bigint").alias("hits")),
    "D31_D32_director_benefit": lambda s, d: D.director_benefit(statement(s, d).withColumn("party", F.concat(F.lit("PERSON "), (c("row_order") % 20).cast("string"), F.lit(" BIN X"))).withColumn("description", F.when(c("row_order") % 60 == 0, "HP LOAN CAR LOAN").otherwise(c("description")))),
    "D33_salary_recipients": lambda s, d: D.salary_recipients(statement(s, d).withColumn("party", F.concat(F.lit("P"), (c("row_order") % 16).cast("string")))),
    "C00_classify": lambda s, d: classified(s, d).select("row_order", "side9", "primary"),
    "U01_X01_dedupe": lambda s, d: L.dedupe(statement(s, d).unionByName(statement(s, d).where("row_order % 3 = 0").withColumn("row_order", c("row_order") + 1000000000))).select("row_order", "fp"),
    "U02_U03_dedupe_keys": lambda s, d: L.first_of(statement(s, d).select("row_order", "dt", "debit", "credit", "description").unionByName(statement(s, d).where("row_order % 2 = 0").select((c("row_order") + 1000000000).alias("row_order"), "dt", "debit", "credit", "description")), "dt", "debit", "credit").select("row_order"),
    "U04_ordered_unique": lambda s, d: L.first_of(statement(s, d), F.lower("description"), "account_no").select("row_order", "description", "account_no"),
    "U05_duplicate_rows": lambda s, d: L.duplicate_rows(activity(s, d).withColumn("credit", F.round("credit", -2)).withColumn("debit", F.round("debit", -2))).select("row_order", "copies"),
    "U06_duplicate_merchants": lambda s, d: L.duplicate_merchants(activity(s, d).withColumn("credit", F.round("credit", -2)).withColumn("debit", F.round("debit", -2))).select("row_order", "copies"),
    "W08_spikes": lambda s, d: M.spikes(activity(s, d)),
    "W09_rapid_days": lambda s, d: M.rapid_days(activity(s, d)),
    "W10_next_gap": lambda s, d: M.next_gap(statement(s, d)).select("row_order", c("gap").cast("bigint").alias("gap")),
    "J07_return_candidates": lambda s, d: L.return_candidates(statement_returns(s, d)).select("account_no", "dr", "cr", "days"),
    "J07_paired_returns": lambda s, d: L.pair_returns(statement_returns(s, d)),
    "J09_unkeyworded_pairs": lambda s, d: L.unkeyworded(statement_returns(s, d)).select("account_no", "dr", "cr", "days"),
    "A28_pattern_summary": lambda s, d: L.pattern_summary(statement(s, d)),
    "S01_S05_report_order": lambda s, d: L.report_order(statement(s, d)).select("dt", "row_order").select(c("dt").cast("string").alias("dt"), "row_order"),
}

_fl = f"{T.FLAGGED}"
_cl = f"{T.LEDGER}, {T.classified(COMPANIES, RELATED)}"
_act = "ac AS (SELECT row_order, account_no, dt, description, round(credit, -2) AS credit, round(debit, -2) AS debit FROM activity)"
_merchant = r"trim(regexp_replace(regexp_replace(regexp_replace(upper(description), '\b\d{2,}\b', ' ', 'g'), '[^A-Z ]', ' ', 'g'), ' +', ' ', 'g'))"
_cand = f"""cand AS (SELECT o.account_no, o.row_order AS dr, b.row_order AS cr, b.description AS cr_text, CAST(CASE WHEN b.dt <= o.dt THEN 0 ELSE {WEEK.format(d='b.dt')} - {WEEK.format(d='o.dt')} END AS BIGINT) AS days
 FROM statement_returns o JOIN statement_returns b ON o.account_no = b.account_no AND b.credit > 0 AND abs(o.debit - b.credit) <= 0.01 AND b.dt >= o.dt AND b.dt <= o.dt + 9
 WHERE o.debit > 0 AND {T.has(R.OUTWARD_TRANSFER, 'o.description')} AND NOT {T.has(R.RETURN_WORDS, 'o.description')})"""

SQL = {
    **{k: sql(f"SELECT row_order, account_no, month, side9 FROM fl WHERE side9 = '{s}' AND {p}", more=_fl) for k, (p, s) in T.DETECT.items()},
    "D01_round_credits": sql("SELECT row_order, CAST(credit AS DOUBLE) AS credit FROM st WHERE credit >= 10000 AND CAST(round(credit * 100) AS BIGINT) % 1000000 = 0"),
    "D02_large_credits": sql("SELECT row_order, CAST(credit AS DOUBLE) AS credit FROM st WHERE credit >= 100000"),
    "D03_J05_high_value_credits": sql("SELECT row_order, CAST(credit AS DOUBLE) AS credit, round(a, 2) AS eod_average FROM st JOIN (SELECT account_no, month, CAST(sum(eod) AS DOUBLE) / count(*) AS a FROM eod GROUP BY ALL) m USING (account_no, month) WHERE a > 0 AND CAST(credit AS DOUBLE) > a * 3", more=T.EOD),
    "D04_D20_totals": sql(" UNION ALL ".join(f"SELECT account_no, '{k}' AS detector, count(*) FILTER (side9 = '{s}' AND {p}) AS n, CAST(coalesce(sum({'credit' if s == 'CR' else 'debit'}) FILTER (side9 = '{s}' AND {p}), 0) AS DOUBLE) AS amount FROM fl GROUP BY account_no" for k, (p, s) in T.DETECT.items()), more=_fl),
    "D19_unbooked_loans": sql(f"SELECT row_order FROM (SELECT * REPLACE (CASE WHEN row_order % 5 = 0 THEN description || ' FINANCING' ELSE description END AS description) FROM cl) WHERE \"primary\" IS NULL AND {T.has(R.LOAN_SHAPED)} AND NOT {T.has(R.LOAN_NOISE)} AND greatest(credit, debit) > 0", more=_cl),
    "D20_channel_blind": sql(f"SELECT *, cheque_debits >= 500000 AND cheque_debits / gross_debits >= 0.1 AS blind FROM (SELECT CAST(coalesce(sum(debit) FILTER ({T.has(R.CHEQUE_LIKE)}), 0) AS DOUBLE) AS cheque_debits, CAST(sum(debit) AS DOUBLE) AS gross_debits FROM st WHERE debit > 0)"),
    "D21_small_payroll": sql(f"SELECT salaries, salaries > 0 AND salaries <= 30000 AS small FROM (SELECT CAST(coalesce(sum(debit) FILTER ({T.SALARY} AND debit > 0), 0) AS DOUBLE) AS salaries FROM st)"),
    "D22_unclassified": sql('SELECT row_order, description, CAST(greatest(credit, debit) AS DOUBLE) AS amount FROM cl WHERE "primary" IS NULL AND greatest(credit, debit) >= 10000', more=_cl),
    "D23_balance_rows": sql("SELECT row_order, description FROM st WHERE description = 'OPENING BALANCE'"),
    "D25_high_value_rows": sql("SELECT account_no, count(*) FILTER (credit >= 100000 OR debit >= 100000) AS n, count(*) AS rows FROM st GROUP BY 1"),
    "D26_round_share": sql("SELECT account_no, s AS round_share, s > 0.25 AS suspicious FROM (SELECT account_no, CAST(count(*) FILTER ((credit <> 0 AND credit % 1000 = 0) OR (debit <> 0 AND debit % 1000 = 0)) AS DOUBLE) / count(*) AS s FROM st GROUP BY 1)"),
    "D27_large_transactions": sql("SELECT row_order, CASE WHEN credit > 0 THEN 'CR' ELSE 'DR' END AS way, CAST(greatest(credit, debit) AS DOUBLE) AS amount FROM st WHERE greatest(credit, debit) >= 250000 ORDER BY amount DESC, row_order"),
    "D28_round_transactions": sql("SELECT row_order, CAST(CASE WHEN credit > 0 THEN credit ELSE -debit END AS DOUBLE) AS signed FROM st WHERE greatest(credit, debit) >= 10000 AND least(CAST(greatest(credit, debit) AS DOUBLE) % 10000, 10000 - CAST(greatest(credit, debit) AS DOUBLE) % 10000) <= 0.01"),
    "D29_D30_company_trace": sql("SELECT row_order, CAST(2 AS BIGINT) AS hits FROM st WHERE description LIKE 'PAYMENT TO SUPPLIER %'"),
    "D31_D32_director_benefit": sql("SELECT 'PERSON ' || CAST(row_order % 20 AS VARCHAR) || ' BIN X' AS party, coalesce(bool_or(row_order % 60 = 0 AND debit > 0), false) AS benefit FROM st GROUP BY 1"),
    "D33_salary_recipients": sql(f"SELECT * FROM (SELECT 'P' || CAST(row_order % 16 AS VARCHAR) AS party, count(*) FILTER ({T.SALARY}) AS salary_rows, CAST(coalesce(sum(debit) FILTER ({T.SALARY}), 0) AS DOUBLE) AS salary, CAST(sum(debit) AS DOUBLE) AS paid FROM st WHERE debit > 0 GROUP BY 1) WHERE salary_rows >= 2 AND salary >= 0.5 * paid"),
    "C00_classify": sql('SELECT row_order, side9, "primary" FROM cl', more=_cl),
    "U01_X01_dedupe": sql("SELECT row_order, fp FROM (SELECT min(row_order) AS row_order, fp FROM f GROUP BY fp)", more=f"f AS (SELECT row_order, {FP} AS fp FROM st)"),
    "U02_U03_dedupe_keys": sql("SELECT row_order FROM st QUALIFY row_number() OVER (PARTITION BY dt, debit, credit ORDER BY row_order) = 1"),
    "U04_ordered_unique": sql("SELECT row_order, description, account_no FROM st QUALIFY row_number() OVER (PARTITION BY lower(description), account_no ORDER BY row_order) = 1"),
    "U05_duplicate_rows": sql("SELECT * FROM (SELECT row_order, count(*) OVER (PARTITION BY dt, upper(description), CASE WHEN credit > 0 THEN credit ELSE debit END) AS copies FROM ac) WHERE copies > 1", ACTIVITY, more=_act),
    "U06_duplicate_merchants": sql(f"SELECT * FROM (SELECT row_order, count(*) OVER (PARTITION BY account_no, dt, {_merchant}, CASE WHEN credit > 0 THEN 'CR' ELSE 'DR' END, greatest(credit, debit)) AS copies FROM ac) WHERE copies > 1", ACTIVITY, more=_act),
    "W08_spikes": sql("""SELECT row_order, account_no, direction, amount, baseline, CASE WHEN amount >= 3 * baseline THEN 'spike' ELSE 'drop' END AS kind FROM (
 SELECT *, median(amount) OVER (PARTITION BY account_no, direction ORDER BY dt, amount DESC, row_order ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS baseline FROM (
 SELECT row_order, account_no, dt, 'CR' AS direction, CAST(credit AS DOUBLE) AS amount FROM activity WHERE credit > 0 UNION ALL SELECT row_order, account_no, dt, 'DR', CAST(debit AS DOUBLE) FROM activity WHERE debit > 0))
 WHERE baseline >= 100 AND (amount >= 3 * baseline OR amount <= 0.33 * baseline)""", ACTIVITY),
    "W09_rapid_days": sql(f"""SELECT account_no, merchant, CAST(dt AS VARCHAR) AS dt, count(*) OVER (PARTITION BY account_no, merchant) AS flagged_days FROM (
 SELECT DISTINCT d.* FROM dd d JOIN st7 s ON d.account_no = s.account_no AND d.merchant = s.merchant AND d.dt BETWEEN s.dt AND s.dt + 6)""", ACTIVITY,
        more=f"dd AS (SELECT DISTINCT account_no, {_merchant} AS merchant, dt FROM activity), st7 AS (SELECT a.account_no, a.merchant, a.dt FROM dd a JOIN dd b ON a.account_no = b.account_no AND a.merchant = b.merchant AND b.dt BETWEEN a.dt AND a.dt + 6 GROUP BY ALL HAVING count(*) >= 3)"),
    "W10_next_gap": sql("SELECT * FROM (SELECT row_order, CAST(lead(dt) OVER (PARTITION BY account_no, description ORDER BY dt, row_order) - dt AS BIGINT) AS gap FROM st) WHERE gap <= 30"),
    "J07_return_candidates": sql("SELECT account_no, dr, cr, days FROM cand WHERE days <= 5", STATEMENT, RETURNS, more=_cand),
    "J09_unkeyworded_pairs": sql(f"SELECT account_no, dr, cr, days FROM cand WHERE days <= 5 AND NOT {T.has(R.INWARD_RETURN, 'cr_text')}", STATEMENT, RETURNS, more=_cand),
    "A28_pattern_summary": sql(f"SELECT count(*) AS rows, count(*) FILTER (greatest(credit, debit) >= 100000) AS high_value, count(*) FILTER (greatest(credit, debit) >= 10000 AND greatest(credit, debit) % 10000 = 0) AS rounds, count(*) FILTER ({T.SALARY}) AS salary, count(*) FILTER (k > 1) AS duplicates FROM (SELECT *, count(*) OVER (PARTITION BY dt, upper(description), CASE WHEN credit > 0 THEN credit ELSE debit END) AS k FROM st)"),
    "S01_S05_report_order": sql("SELECT CAST(dt AS VARCHAR) AS dt, row_order FROM st ORDER BY 1, 2"),
}

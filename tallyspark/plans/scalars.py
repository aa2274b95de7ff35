"""Queries of the scalar functions, over the whole statement in mixed notation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ledger as L
from . import sqltext as T
from .fixtures import MESSY, STATEMENT, messy, sql, statement

c = F.col
M = (STATEMENT, MESSY)
NORM = r"trim(regexp_replace(coalesce(raw_text, ''), '\s+', ' ', 'g'))"


def f01(spark, d):
    return messy(spark, d).select("row_order", S.normalize_text(c("raw_text")).alias("text"))


def f02(spark, d):
    return messy(spark, d).select("row_order", S.to_amount(c("raw_amount")).alias("value"))


def f03(spark, d):
    return messy(spark, d).select("row_order", S.to_date(c("raw_date")).cast("string").alias("day"))


def f04(spark, d):
    day = S.to_date(c("raw_date"))
    return messy(spark, d).select("row_order", F.date_format(day, "dd-MMM-yy").alias("shown"))


def f05(spark, d):
    year = F.regexp_extract("raw_date", r"(\d{4})", 1)
    rows = messy(spark, d).where(F.coalesce(year, F.lit("")) != "")
    return rows.groupBy("account_no").agg(F.min_by(year, "row_order").alias("default_year"))


def f07(spark, d):
    text = F.concat(F.coalesce("description", F.lit("")), F.when(c("row_order") % 3 == 0, "  - LOCAL CHEQUES  1.00").when(c("row_order") % 3 == 1, " / Protected by PIDM").otherwise(" ;"))
    return statement(spark, d).select("row_order", S.strip_footer(text).alias("text"))


def f08(spark, d):
    return statement(spark, d).select("row_order", S.signed_amount(c("credit"), c("debit")).cast("double").alias("signed"), S.row_side(c("credit"), c("debit")).alias("side9"), S.positive(c("credit") - c("debit")).cast("double").alias("positive"))


def f11(spark, d):
    end = F.date_add("dt", (c("row_order") % 20 - 2).cast("int"))
    return statement(spark, d).select("row_order", S.business_days(c("dt"), end).alias("days"))


def f12(spark, d):
    return statement(spark, d).select("row_order", S.is_round(c("amount").cast("double")).alias("is_round"), S.round_debit(c("debit")).alias("round_debit"))


def f13(spark, d):
    return messy(spark, d).select("row_order", S.merchant_key(c("raw_text")).alias("merchant"), S.party_name(c("raw_text")).alias("party"))


NAMES = """nm AS (SELECT row_order, CASE row_order % 9 WHEN 0 THEN 'ABC SDN B' WHEN 1 THEN 'abc trading sb' WHEN 2 THEN 'JAN FEB' WHEN 3 THEN 'ALI BIN ABU' WHEN 4 THEN '010 MAZAA (M) SDN BHD' WHEN 5 THEN '12345' WHEN 6 THEN 'LOAN REPAYMENT'
  WHEN 7 THEN NULL ELSE 'SUPPLIER ' || CAST(row_order % 37 AS VARCHAR(10)) || ' SDN. BHD.' END AS name FROM st)"""


def names(spark, d):
    k = c("row_order") % 9
    name = F.when(k == 0, "ABC SDN B").when(k == 1, "abc trading sb").when(k == 2, "JAN FEB").when(k == 3, "ALI BIN ABU").when(k == 4, "010 MAZAA (M) SDN BHD").when(k == 5, "12345").when(k == 6, "LOAN REPAYMENT").when(k == 8, F.concat(F.lit("SUPPLIER "), (c("row_order") % 37).cast("string"), F.lit(" SDN. BHD.")))
    return statement(spark, d).select("row_order", name.alias("name"))


def f15(spark, d):
    return names(spark, d).select("row_order", S.company_suffix(c("name")).alias("suffix"), S.company_root(c("name")).alias("root"))


def f17(spark, d):
    return names(spark, d).select("row_order", S.no_counterparty(c("name")).alias("drop_it"), S.has_corporate_suffix(c("name")).alias("corporate"), S.is_person(c("name")).alias("person"), S.unknown_label(c("name")).alias("unknown"))


def f20(spark, d):
    return names(spark, d).select("row_order", S.own_party(c("name"), F.lit(""), ["MAZAA", "SUPPLIER 1", "ABC"]).alias("own"))


def f21(spark, d):
    text = F.when(c("row_order") % 3 == 0, F.concat(F.lit("JOMPAY "), c("row_order").cast("string"))).when(c("row_order") % 3 == 1, F.concat(F.lit("jompay bill payment "), c("description"))).otherwise(c("description"))
    return statement(spark, d).select("row_order", S.bill_code_only(text).alias("code_only"))


def f27(spark, d):
    return L.with_fingerprint(statement(spark, d)).select("row_order", "fp")


def f29(spark, d):
    return statement(spark, d).select("row_order", S.money(c("amount")).alias("shown"), c("month"))


FP = """sha256(concat_ws('|', CAST(dt AS VARCHAR), trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')), printf('%.2f', CAST(debit AS DOUBLE)), printf('%.2f', CAST(credit AS DOUBLE)), CASE WHEN balance IS NULL THEN '' ELSE printf('%.2f', CAST(balance AS DOUBLE)) END, CAST(account_no AS VARCHAR)))"""
WEEK = "(CAST(floor(({d} - DATE '1990-01-01') / 7.0) AS BIGINT) * 5 + least(({d} - DATE '1990-01-01') % 7 + 1, 5))"
STOP = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(S.MONTH_WORDS + S.PURPOSE_WORDS)) + ")"
FOOT = ", ".join(f"nullif(instr(upper(s), '{m}'), 0)" for m in S.FOOTERS)
UP = r"upper(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g')))"

QUERIES = {
    "F01_normalize_text": f01, "F02_safe_amount": f02, "F03_normalize_date": f03, "F04_display_date": f04, "F05_default_year": f05, "F07_strip_footer": f07,
    "F08_F10_signed_amount_side": f08, "F11_business_days": f11, "F12_F31_round_numbers": f12, "F13_F14_merchant_and_party": f13, "F15_F19_suffix_and_root": f15,
    "F17_F18_F22_name_predicates": f17, "F20_own_party": f20, "F21_bill_code_only": f21, "F27_fingerprint": f27, "F29_F32_money_and_month": f29,
}
SQL = {
    "F01_normalize_text": sql(f"SELECT row_order, {NORM} AS text FROM messy", *M),
    "F02_safe_amount": sql(r"""SELECT row_order, CASE WHEN b LIKE '(%)' OR b LIKE '%-' THEN -abs(v) WHEN b LIKE '%+' THEN abs(v) ELSE v END AS value FROM (
 SELECT row_order, b, coalesce(try_cast(regexp_replace(regexp_replace(regexp_replace(b, '^\(|\)$', '', 'g'), '[+-]$', ''), '[^0-9.\-]', '', 'g') AS DOUBLE), 0) AS v FROM (SELECT row_order, trim(coalesce(raw_amount, '')) AS b FROM messy))""", *M),
    "F03_normalize_date": sql("SELECT row_order, CAST(CAST(coalesce(try_strptime(trim(raw_date), '%Y-%m-%d'), try_strptime(trim(raw_date), '%d/%m/%Y'), try_strptime(trim(raw_date), '%d-%m-%Y')) AS DATE) AS VARCHAR) AS day FROM messy", *M),
    "F04_display_date": sql("SELECT row_order, strftime(coalesce(try_strptime(trim(raw_date), '%Y-%m-%d'), try_strptime(trim(raw_date), '%d/%m/%Y'), try_strptime(trim(raw_date), '%d-%m-%Y')), '%d-%b-%y') AS shown FROM messy", *M),
    "F05_default_year": sql(r"SELECT account_no, min_by(regexp_extract(raw_date, '(\d{4})', 1), row_order) AS default_year FROM messy WHERE regexp_extract(coalesce(raw_date, ''), '(\d{4})', 1) <> '' GROUP BY 1", *M),
    "F07_strip_footer": sql(rf"""SELECT row_order, trim(regexp_replace(CASE WHEN least({FOOT}) IS NULL THEN s ELSE substr(s, 1, least({FOOT}) - 1) END, '[\s\-=/,:;|]+$', '')) AS text FROM (
 SELECT row_order, trim(regexp_replace(description || CASE row_order % 3 WHEN 0 THEN '  - LOCAL CHEQUES  1.00' WHEN 1 THEN ' / Protected by PIDM' ELSE ' ;' END, '\s+', ' ', 'g')) AS s FROM st)"""),
    "F08_F10_signed_amount_side": sql(f"SELECT row_order, CAST(CASE WHEN credit > 0 THEN credit WHEN debit > 0 THEN -debit END AS DOUBLE) AS signed, {T.SIDE9} AS side9, CAST(greatest(credit - debit, 0) AS DOUBLE) AS positive FROM st"),
    "F11_business_days": sql(f"SELECT row_order, CASE WHEN e <= dt THEN 0 ELSE CAST({WEEK.format(d='e')} - {WEEK.format(d='dt')} AS BIGINT) END AS days FROM (SELECT *, dt + CAST(row_order % 20 - 2 AS INT) AS e FROM st)"),
    "F12_F31_round_numbers": sql("SELECT row_order, amount >= 10000 AND least(CAST(amount AS DOUBLE) % 10000, 10000 - CAST(amount AS DOUBLE) % 10000) <= 0.01 AS is_round, debit >= 1000 AND CAST(round(debit * 100) AS BIGINT) % 10000 = 0 AS round_debit FROM st"),
    "F13_F14_merchant_and_party": sql(rf"SELECT row_order, trim(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(raw_text, '')), '\b\d{{2,}}\b', ' ', 'g'), '[^A-Z ]', ' ', 'g'), ' +', ' ', 'g')) AS merchant, {T.party('raw_text')} AS party FROM messy", *M),
    "F15_F19_suffix_and_root": sql(r"""SELECT row_order, CASE name WHEN 'ABC SDN B' THEN 'ABC SDN BHD' WHEN 'abc trading sb' THEN 'ABC TRADING SDN BHD' WHEN '010 MAZAA (M) SDN BHD' THEN '010 MAZAA (M) SDN BHD' ELSE CASE WHEN name IS NULL THEN 'UNKNOWN' ELSE replace(name, ' SDN. BHD.', ' SDN BHD') END END AS suffix,
 CASE WHEN regexp_full_match(r, '\d+') THEN '' ELSE r END AS root FROM (SELECT row_order, name, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(name, '')), '\([^)]*\)', ' ', 'g'), '\b(?:SDN\.?\s*BHD\.?|SENDIRIAN BERHAD|BERHAD|BHD\.?|ENTERPRISES?|TRADING|CORPORATION|GROUP|HOLDINGS|INDUSTRIES)', '', 'g'), '[^A-Z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')), '^(?:\d+\s+)+', '') AS r FROM nm)""", more=NAMES),
    "F17_F18_F22_name_predicates": sql(rf"""SELECT row_order, NOT regexp_matches({UP}, '[A-Z]') OR length({UP}) <= 2 OR len(list_filter(string_split({UP}, ' '), lambda t: t NOT IN {STOP})) = 0 AS drop_it,
 coalesce(regexp_matches(name, '{T.CORPORATE}', 'i') OR regexp_matches(name, '[A-Z]{{2,}}\s+(?:\([^)]*\)\s+)?(?:SDN\.?(?:\s+BH?\.?)?|SB)\s*$', 'i'), false) AS corporate, coalesce(regexp_matches(name, '(?:^|\s)(?:BIN|BINTI|A/L|A/P)(?:\s|$)', 'i'), false) AS person, {UP} IN ('', 'UNKNOWN', 'UNNAMED', 'N/A', 'NONE', '-') OR starts_with({UP}, 'BANK_CLEARING_') OR starts_with({UP}, 'UNKNOWN ') AS unknown FROM nm""", more=NAMES),
    "F20_own_party": sql("SELECT row_order, coalesce(contains(upper(name), 'MAZAA') OR contains(upper(name), 'SUPPLIER 1') OR (length(name) >= 6 AND (contains('MAZAA', upper(name)) OR contains('SUPPLIER 1', upper(name)))), false) AS own FROM nm", more=NAMES),
    "F21_bill_code_only": sql(r"SELECT row_order, row_order % 3 = 0 OR (row_order % 3 = 1 AND len(list_filter(regexp_split_to_array(upper('jompay bill payment ' || description), '[^A-Z0-9]+'), lambda t: regexp_full_match(t, '[A-Z]{2,}') AND t NOT IN ('JOMPAY', 'BILL', 'PAYMENT', 'PAYMENTS', 'AT', 'DIO', 'DEBIT', 'CREDIT', 'TRANSFER', 'TRANSFERS', 'TXN', 'REF', 'FR'))) = 0) AS code_only FROM st"),
    "F27_fingerprint": sql(f"SELECT row_order, {FP} AS fp FROM st"),
    "F29_F32_money_and_month": sql("SELECT row_order, format('RM {:,.2f}', CAST(amount AS DOUBLE)) AS shown, month FROM st"),
}

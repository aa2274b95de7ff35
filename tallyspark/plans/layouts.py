"""Queries of statement layouts and of parties in bank texts, over lines printed from the statement's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import related as R
from ..sources import bankparties as B
from ..sources import layouts as Y
from . import sqltext as T
from .accounts import DROP, LED, UNK
from .fixtures import sql, statement

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, text: str | None = None) -> None:
    QUERIES[name] = fn
    if text:
        SQL[name] = text


#: Bank, text as the bank prints it, and the party in it.
PRINTED = (
    ("Agro Bank", "DUITNOW/INSTANT CR ALPHA WORKS SND B REF 123", "ALPHA WORKS SDN BHD"),
    ("Agro Bank", "OUTWARD IBG DEBIT | RPP | 12345 | BETA TRADING SDN", "BETA TRADING SDN BHD"),
    ("Agro Bank", "FPX PAYMENT TOTAL DEBIT", "UNKNOWN"),
    ("Agro Bank", "X CDM CA DEPOSIT 1", "CDM CA DEPOSIT"),
    ("Ambank", "DuitNow TRF / MISC CREDIT, ALI BIN ABU INV 12, x", "ALI BIN ABU"),
    ("Ambank", "DuitNow TRF / MISC CREDIT, 123", "DUITNOW"),
    ("Ambank", "DEBIT TRANSFER, , x", "DEBIT TRANSFER"),
    ("Ambank", "Inward clearing 1", "CHEQUE"),
    ("Ambank", "JomPAY / X, TENAGA NASIONAL, 99", "TENAGA NASIONAL"),
    ("Ambank", "HELLO", "UNKNOWN"),
    ("Bank Islam", "1234 INW DuitNow Transfer ALPHA WORKS SDN BHD lunch", "ALPHA WORKS SDN BHD"),
    ("Bank Islam", "1234 INW DuitNow Transfer ALI BIN ABU lunch money", "ALI BIN ABU"),
    ("Bank Islam", "1234 SERVICE CHARGE", "BANK / SYSTEM"),
    ("Bank Islam", "1234PROFITPAID", "PROFITPAID"),
    ("Bank Islam", "1234 eSPICK INW BETA SD 123", "BETA SDN BHD"),
    ("Bank Islam", "9 1234 CDB CA TRF IBG GAMMA BERH 123456", "GAMMA BERHAD"),
    ("Bank Islam", "NOTHING HERE", "UNKNOWN"),
    ("Bank Rakyat", "12345 DUITNOW TRANSFER ALI BIN ABU GAJI JAN", "ALI BIN ABU"),
    ("Bank Rakyat", "IBG CREDIT ALPHA SDN. BHD. INV 1", "ALPHA SDN BHD"),
    ("Bank Rakyat", "PAYMENT TO BETA BERHAD X", "BETA BHD"),
    ("Bank Rakyat", "CDM CASH DEPOSIT", "CASH DEPOSIT"),
    ("Maybank", "TRANSFER FR A/C ALPHA WORKS SDN B * 123", "ALPHA WORKS SDN BHD"),
    ("Maybank", "PAYMENT FR A/C EPF DPE * 0000", "EPF DPE"),
    ("Maybank", "PAYMENT FR A/C 123_A * BETA TRADING", "BETA TRADING"),
    ("Maybank", "PAYMENT FR A/C INV_12 GAMMA ENTERPR * 9", "GAMMA ENTERPRISE"),
    ("Maybank", "CASH DEPOSIT X", "CASH DEPOSIT"),
    ("Maybank", "DUITNOW TO A/C A & B TRADING 1234567", "A & B TRADING"),
    ("Maybank", "SOMETHING", "UNKNOWN"),
    ("OCBC", "PYMT TO APPROVED ALPHA GAS SDN B DUITNOW", "ALPHA GAS SDN BHD"),
    ("OCBC", "DUITNOW(INST TRF) DR ALI BIN ABU DESC: X REF: 1", "ALI BIN ABU"),
    ("OCBC", "DUITNOW SC REF: 1", "UNKNOWN"),
    ("Public Bank (PBB)", "DUITNOW TRSF CR 123 ALI BIN ABU RENTAL X", "ALI BIN ABU"),
    ("Public Bank (PBB)", "DEP-ECP 1 X9 MBB ALPHA WORKS S/B CIM 1", "ALPHA WORKS SDN BHD"),
    ("Public Bank (PBB)", "MISC DR 1", "MISC DEBIT"),
    ("Public Bank (PBB)", "DR-ECP 000001 X BETA SDN BHD 9", "BETA SDN BHD"),
    ("Public Bank (PBB)", "LOCAL CHEQUE 1", "CHEQUE"),
    ("UOB Bank", "X PBB ALPHA WORKS||MBB BETA WORKS SDN B", "BETA WORKS SDN BHD"),
    ("UOB Bank", "DuitNow/Instant Trf C123456 GAMMA GAMMA 1", "GAMMA 1"),
    ("UOB Bank", "OD INT CHARGE", "BANK CHARGES"),
    ("UOB Bank", "Fund Trf EB DELTA TRADING|X", "DELTA TRADING"),
)


def printed(s, d) -> DataFrame:
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in PRINTED)), (c("row_order") % len(PRINTED) + 1).cast("int"))
    return statement(s, d).select("row_order", pick(0).alias("bank"), pick(1).alias("description"))


add("F34_bank_parties", lambda s, d: printed(s, d).select("row_order", B.bank_party(c("bank"), c("description")).alias("party")), sql(f"SELECT row_order, CASE row_order % {len(PRINTED)} " + " ".join(f"WHEN {k} THEN '{p[2]}'" for k, p in enumerate(PRINTED)) + " END AS party FROM st"))


def spelled(s, d) -> DataFrame:
    base = F.element_at(F.array(*map(F.lit, ("ALPHA", "BRAVO", "CHARLIE"))), (c("row_order") % 3 + 1).cast("int"))
    cut = F.when(c("row_order") % 7 < 4, "HARDWARE").otherwise("HARDWAR")
    return statement(s, d).select("row_order", c("account_no").alias("file"), F.lit("Maybank").alias("bank"), F.concat(F.lit("TRANSFER FR A/C SUPPLIER "), base, F.lit(" "), cut, F.lit(" SDN BHD * 12")).alias("description"))


add("N11_annotate", lambda s, d: B.annotate(spelled(s, d)).select("row_order", "party_raw", "party"), sql("""SELECT row_order, party_raw, arg_max(party_raw, (n, length(party_raw))) OVER (PARTITION BY account_no, base) AS party FROM (
 SELECT *, count(*) OVER (PARTITION BY account_no, party_raw) AS n FROM (SELECT row_order, account_no, row_order % 3 AS base,
 'SUPPLIER ' || CASE row_order % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BRAVO' ELSE 'CHARLIE' END || CASE WHEN row_order % 7 < 4 THEN ' HARDWARE' ELSE ' HARDWAR' END || ' SDN BHD' AS party_raw FROM st))"""))

TARGETS = (("SUPPLIER SDN BHD",), ("STAFF SALARY",), ("SUPPLIER BHD",))
_side = lambda side, col: f"SELECT '{side}' AS side, party, {col} AS amount, row_number() OVER (ORDER BY {col} DESC, party) AS rank FROM al WHERE {col} > 0 AND NOT {UNK} AND NOT {DROP} AND NOT regexp_matches(party, '\\bBILL\\b|\\bCHARGE', 'i') QUALIFY rank <= 10"
_al = "al AS (SELECT CASE WHEN party LIKE 'PAYMENT TO SUPPLIER %' THEN 'SUPPLIER SDN BHD' WHEN party = 'STAFF SALARY JAN' THEN 'STAFF SALARY' ELSE party END AS party, round(sum(credits), 2) AS credits, round(sum(debits), 2) AS debits FROM lg GROUP BY 1)"
add("N10_top_party_view", lambda s, d: R.top_party_view(statement(s, d), s.createDataFrame(list(TARGETS), "target string")), sql(f"{_side('payer', 'credits')} UNION ALL {_side('payee', 'debits')}", more=f"{T.LEDGER}, {LED}, {_al}"))

# --- printed pages ----------------------------------------------------------------------------------------------

#: Rows of one file and year with a running balance above zero; every page holds nine of them.
RUN = """run AS (SELECT *, CAST(account_no AS VARCHAR(10)) || '-' || CAST(year(dt) AS VARCHAR(4)) AS file, row_number() OVER w AS k, count(*) OVER (PARTITION BY account_no, year(dt)) AS n,
 CAST(1000000000 + sum(credit - debit) OVER w AS DECIMAL(18,2)) AS bal FROM st WINDOW w AS (PARTITION BY account_no, year(dt) ORDER BY dt, row_order))"""


def numbered(s, d) -> DataFrame:
    return s.sql(f"WITH {RUN.replace('FROM st', 'FROM {st}')} SELECT *, CAST(floor((k - 1) / 9) AS INT) AS p FROM run", st=statement(s, d))


def pages(rows: DataFrame, *texts) -> DataFrame:
    """Lines ``(file, page, line, text)`` of every row's texts; null texts print nothing."""
    per = rows.select("file", (c("p") + 1).alias("page"), c("k").alias("k"), F.posexplode(F.array(*texts)).alias("i", "text"))
    return per.where("text IS NOT NULL").select("file", "page", (c("k") * 100 + c("i")).alias("line"), "text")


money = lambda col: F.format_number(col, 2)


def alliance_lines(s, d) -> DataFrame:
    r = numbered(s, d)
    day = F.date_format("dt", "ddMMyy")
    return pages(
        r,
        F.when(c("k") % 9 == 1, "PAGE 1 OF 9"),
        F.when((c("k") == 1) & (c("account_no") % 2 == 0), F.concat(day, F.lit(" BEGINNING BALANCE "), money(c("bal") - c("credit") + c("debit")))),
        F.concat_ws(" ", day, "description", F.when(c("k") % 5 != 0, F.concat_ws(" ", money("amount"), money("bal")))),
        F.when(c("k") % 4 == 0, F.concat(F.lit("LINE "), c("k").cast("string"))),
        F.when(c("k") % 9 == 0, "The items and balances shown above will be deemed correct"),
        F.when(c("k") % 9 == 0, "lost 1.00 2.00"),
    )


_known = "CASE WHEN k % 5 <> 0 THEN CAST(bal AS DOUBLE) END"
add(
    "P07_alliance",
    lambda s, d: Y.alliance(alliance_lines(s, d)).withColumn("dt", c("dt").cast("string")).withColumn("seq", c("seq").cast("bigint")).withColumn("page", c("page").cast("bigint")),
    sql(
        f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY k, o) AS seq, CAST(floor((k - 1) / 9) + 1 AS BIGINT) AS page, CAST(CASE WHEN year(dt) < 2000 THEN dt + INTERVAL 100 YEAR ELSE dt END AS DATE)::VARCHAR AS dt, description,
 round(CASE WHEN marker THEN 0 WHEN step IS NOT NULL THEN greatest(-step, 0) ELSE coalesce(amount, 0) END, 2) AS debit, round(CASE WHEN marker OR step IS NULL THEN 0 ELSE greatest(step, 0) END, 2) AS credit, balance, marker FROM (
 SELECT *, balance - CASE WHEN account_no % 2 = 0 THEN last_value(balance IGNORE NULLS) OVER (PARTITION BY file ORDER BY k, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS step FROM (
 SELECT file, account_no, k, 1 AS o, dt, CASE WHEN k % 5 = 0 THEN regexp_replace(description, ' (CR|DR)$', '') ELSE description END || CASE WHEN k % 4 = 0 THEN ' LINE ' || k ELSE '' END AS description, CASE WHEN k % 5 <> 0 THEN CAST(amount AS DOUBLE) END AS amount, {_known} AS balance, false AS marker FROM run
 UNION ALL SELECT file, account_no, k, 0, dt, 'BEGINNING BALANCE', NULL, CAST(bal - credit + debit AS DOUBLE), true FROM run WHERE k = 1 AND account_no % 2 = 0))""",
        more=RUN,
    ),
)


def public_lines(s, d) -> DataFrame:
    r = numbered(s, d)
    top, end = c("k") % 9 == 1, (c("k") % 9 == 0) | (c("k") == c("n"))
    return pages(
        r,
        F.when(c("k") == 1, F.concat(F.lit("Statement Date 31 Dec "), F.year("dt").cast("string"))),
        F.when(top, "header that is lost"),
        F.when(top, F.concat(F.date_format("dt", "dd/MM"), F.lit(" Balance B/F 1.00"))),
        F.when(top, F.concat(F.lit("CARRIED "), c("p").cast("string"))),
        F.concat_ws(" ", F.when(top | (c("k") % 2 == 0) | c("description").startswith("CREDIT"), F.date_format("dt", "dd/MM")), "description", money("amount"), money("bal")),
        F.when(c("k") % 4 == 0, F.concat(F.lit("REF "), c("k").cast("string"))),
        F.when(end & (c("p") % 3 != 0), "Balance C/F 1.00"),
        F.when(end, F.concat(F.lit("Page "), c("p").cast("string"))),
    )


add(
    "P15_W13_public_bank",
    lambda s, d: Y.public_bank(public_lines(s, d)).withColumn("dt", c("dt").cast("string")).withColumn("seq", c("seq").cast("bigint")).withColumn("page", c("page").cast("bigint")),
    sql(
        """SELECT file, k AS seq, CAST(p + 1 AS BIGINT) AS page, CAST(last_value(CASE WHEN k % 9 = 1 OR k % 2 = 0 OR starts_with(description, 'CREDIT') THEN dt END IGNORE NULLS) OVER (PARTITION BY file ORDER BY k) AS VARCHAR) AS dt,
 text AS description, round(CASE WHEN step IS NOT NULL THEN greatest(-step, 0) WHEN regexp_matches(upper(text), '\\bCR\\b|^DEP|CREDIT') THEN 0 ELSE amount END, 2) AS debit,
 round(CASE WHEN step IS NOT NULL THEN greatest(step, 0) WHEN regexp_matches(upper(text), '\\bCR\\b|^DEP|CREDIT') THEN amount ELSE 0 END, 2) AS credit, balance, false AS marker FROM (
 SELECT *, balance - lag(balance) OVER (PARTITION BY file ORDER BY k) AS step, description || CASE WHEN k % 4 = 0 THEN ' REF ' || k ELSE '' END || CASE WHEN k % 9 = 0 AND k < n AND p % 3 <> 0 THEN ' CARRIED ' || (p + 1) ELSE '' END AS text FROM (
 SELECT file, k, n, dt, description, CAST(amount AS DOUBLE) AS amount, CAST(bal AS DOUBLE) AS balance, CAST(floor((k - 1) / 9) AS BIGINT) AS p FROM run))""",
        more=RUN,
    ),
)


def ocbc_lines(s, d) -> DataFrame:
    r = numbered(s, d)
    return pages(
        r,
        F.when((c("k") == 1) & (c("account_no") % 2 == 0), F.concat(F.lit("Balance B/F "), money(c("bal") - c("credit") + c("debit")))),
        F.concat_ws(" ", F.upper(F.date_format("dt", "dd MMM yyyy")), "description", money("amount"), money("bal")),
        F.when(c("k") % 4 == 0, "REF: A B C D E"),
        F.when(c("k") % 4 == 0, "DESC: X"),
        F.when(c("k") % 9 == 0, "TRANSACTION SUMMARY"),
        F.when(c("k") % 9 == 0, F.concat(F.upper(F.date_format("dt", "dd MMM yyyy")), F.lit(" LOST 1.00 2.00"))),
    )


_said = "' ' || description || ' '"
_dr, _cr = f"contains({_said}, ' DR ')", f"(contains({_said}, 'CREDIT') OR contains({_said}, ' CR '))"
add(
    "P17_ocbc",
    lambda s, d: Y.ocbc(ocbc_lines(s, d)).withColumn("dt", c("dt").cast("string")).withColumn("seq", c("seq").cast("bigint")).withColumn("page", c("page").cast("bigint")),
    sql(
        f"""SELECT file, k AS seq, CAST(floor((k - 1) / 9) + 1 AS BIGINT) AS page, CAST(dt AS VARCHAR) AS dt, description || CASE WHEN k % 4 = 0 THEN ' REF: A B C D' ELSE '' END AS description,
 CASE WHEN {_cr} AND NOT {_dr} THEN 0.0 WHEN {_dr} OR contains(description, 'DEBIT') THEN amount WHEN step < 0 THEN amount ELSE 0.0 END AS debit,
 CASE WHEN {_cr} AND NOT {_dr} THEN amount WHEN {_dr} OR contains(description, 'DEBIT') THEN 0.0 WHEN step > 0 THEN amount ELSE 0.0 END AS credit, balance, false AS marker FROM (
 SELECT file, k, dt, description, CAST(amount AS DOUBLE) AS amount, CAST(bal AS DOUBLE) AS balance, CASE WHEN k > 1 OR account_no % 2 = 0 THEN CAST(credit - debit AS DOUBLE) END AS step FROM run)""",
        more=RUN,
    ),
)

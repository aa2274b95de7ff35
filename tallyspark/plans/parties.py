"""Queries of related parties and of the report's assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import flags as G
from ..operators import ledger as L
from ..operators import monthly as M
from ..operators import related as R
from . import sqltext as T
from .accounts import LED, RP
from .detectors import COMPANIES, RELATED, classified
from .fixtures import sql, statement

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, text: str | None = None) -> None:
    QUERIES[name] = fn
    if text:
        SQL[name] = text


def people(s, d):
    name = F.element_at(F.array(*map(F.lit, ("ALI BIN ABU", "SITI BINTI OMAR", "LEE A/L RAO"))), (c("row_order") % 3 + 1).cast("int"))
    return statement(s, d).withColumn("description", F.when(c("row_order") % 13 == 0, F.concat(F.lit("1 ADVANCE 2 "), name, F.lit(" 3"))).otherwise(c("description")))


wide = lambda k: T.has(R.WIDE[k]) + (f" AND NOT {T.has(R.NOT_EPF)}" if k == "epf" else "")
_cl = f"{T.LEDGER}, {T.classified(COMPANIES, RELATED)}"
add("F06_artifacts", lambda s, d: statement(s, d).select("row_order", R.artifact(F.when(c("row_order") % 4 == 0, F.concat("description", F.lit(" Baki  Legar"))).when(c("row_order") % 4 == 1, "未過賬").otherwise(c("description"))).alias("artifact"), R.artifact_reason(F.when(c("row_order") % 3 == 0, F.concat("description", F.lit(" Silahantar  x Base  lending\trate"))).otherwise(c("description"))).alias("reason")), sql("SELECT row_order, row_order % 4 < 2 AS artifact, CASE WHEN row_order % 3 = 0 THEN 'Footer/header text leaked into transaction description' ELSE '' END AS reason FROM st"))
add("F16_expand_suffix", lambda s, d: statement(s, d).select("row_order", R.expand_suffix(F.when(c("row_order") % 3 == 0, "ABC SDN B").when(c("row_order") % 3 == 1, "Abc (M) SB").otherwise("ABC BHD")).alias("name")), sql("SELECT row_order, CASE row_order % 3 WHEN 0 THEN 'ABC SDN BHD' WHEN 1 THEN 'Abc (M) SDN BHD' ELSE 'ABC BHD' END AS name FROM st"))
add("D24_statutory_patterns", lambda s, d: R.statutory_patterns(statement(s, d)), sql(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({wide(k)}) AS n, CAST(coalesce(sum(CASE WHEN debit > 0 THEN debit ELSE credit END) FILTER ({wide(k)}), 0) AS DOUBLE) AS amount FROM st" for k in R.WIDE)))
add("A32_gross_debits", lambda s, d: R.gross_debits(statement(s, d)), sql("SELECT CAST(coalesce(sum(debit), 0) AS DOUBLE) AS gross_debits FROM st"))
add("A24_N6_party_groups", lambda s, d: R.party_groups(statement(s, d), s.createDataFrame([("supplier 1 ",)], "name string"), s.createDataFrame([("SUPPLIER 2",), ("SALARY",), ("SUPPLIER 1",)], "name string")), sql("""SELECT kind, listed, count(*) AS n, CAST(sum(credit) AS DOUBLE) AS credits, CAST(sum(debit) AS DOUBLE) AS debits FROM (SELECT credit, debit, CASE WHEN contains(description, 'SUPPLIER 1 ') THEN 'own' WHEN contains(description, 'SUPPLIER 2') OR contains(description, 'SUPPLIER 1') OR contains(description, 'SALARY') THEN 'related' ELSE 'other' END AS kind,
 CASE WHEN contains(description, 'SUPPLIER 1 ') THEN 'SUPPLIER 1 ' WHEN contains(description, 'SUPPLIER 1') THEN 'SUPPLIER 1' WHEN contains(description, 'SUPPLIER 2') THEN 'SUPPLIER 2' WHEN contains(description, 'SALARY') THEN 'SALARY' ELSE '' END AS listed FROM st) GROUP BY ALL"""))
add("A23_N9_align_to_targets", lambda s, d: R.align_to_targets(L.ledger(statement(s, d)).select("party", "n", "credits", "debits"), s.createDataFrame([("SUPPLIER SDN BHD",), ("STAFF SALARY",), ("SUPPLIER BHD",)], "target string")), sql("SELECT CASE WHEN party LIKE 'PAYMENT TO SUPPLIER %' THEN 'SUPPLIER SDN BHD' WHEN party = 'STAFF SALARY JAN' THEN 'STAFF SALARY' ELSE party END AS party, CAST(sum(n) AS BIGINT) AS n, round(sum(credits), 2) AS credits, round(sum(debits), 2) AS debits FROM lg GROUP BY 1", more=f"{T.LEDGER}, {LED}"))
add("R05_candidates", lambda s, d: R.candidates(statement(s, d), s.createDataFrame([("RETURN CHQ",)], "party string")), sql("SELECT party, debits, credits, signals, score, CASE WHEN score >= 3 AND (s1 OR s4) THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r2 WHERE score > 0 AND party NOT LIKE '% SDN BHD' AND party <> 'RETURN CHQ'", more=f"{T.LEDGER}, {RP}"))
add("R06_N1_N4_keyword_people", lambda s, d: R.keyword_people(people(s, d)), sql("SELECT person, count(*) AS n, CAST(sum(debit) AS DOUBLE) AS debits, CAST(sum(credit) AS DOUBLE) AS credits FROM (SELECT *, CASE row_order % 3 WHEN 0 THEN 'ALI BIN ABU' WHEN 1 THEN 'SITI BINTI OMAR' ELSE 'LEE A/L RAO' END AS person FROM st WHERE row_order % 13 = 0 QUALIFY row_number() OVER (PARTITION BY account_no, dt, row_order % 3, amount, side ORDER BY row_order) = 1) GROUP BY 1"))
add("E07_N7_display_names", lambda s, d: R.display_names(people(s, d).where("row_order % 13 = 0").select(F.regexp_replace("description", "1 ADVANCE 2 | 3$", "").alias("name"), c("row_order").alias("place")).unionByName(s.createDataFrame([("ALI ABU", 10**12), ("SITI OMAR", 10**12)], "name string, place long")).withColumn("report", F.lit("r"))), sql("SELECT 'r' AS report, name FROM (VALUES ('ALI BIN ABU'), ('SITI BINTI OMAR'), ('LEE A/L RAO')) v(name)"))
add("R09_sync_flags", lambda s, d: R.sync_flags(G.flags(G.summary(classified(s, d))), 2, 20000.0, 0, 0.0))
add("N12_company_choice", lambda s, d: R.company_choice(statement(s, d).select(c("account_no").cast("string").alias("file"), F.when(c("row_order") % 3 == 0, "ACME SDN BHD").when(c("row_order") % 3 == 1, "ACME SDN BHD").otherwise("PAYMENT").alias("name"), (c("row_order") % 3 == 2).alias("in_text"))), sql("SELECT DISTINCT CAST(account_no AS VARCHAR) AS file, 'ACME SDN BHD' AS company FROM st"))
add("N5_flexible_values", lambda s, d: statement(s, d).select("row_order", F.when(c("row_order") % 2 == 0, "n/a").otherwise(c("amount").cast("string")).alias("a"), c("debit").cast("string").alias("b")).select("row_order", R.flexible("a", "b").alias("value")), sql("SELECT row_order, CAST(CASE WHEN row_order % 2 = 0 THEN debit ELSE amount END AS DOUBLE) AS value FROM st"))
add("N6_loan_lists", lambda s, d: R.loan_lists(classified(s, d)), sql("SELECT row_order, CASE \"primary\" WHEN 'C10' THEN 'disbursement' ELSE 'repayment' END AS kind, CAST(greatest(credit, debit) AS DOUBLE) AS amount FROM cl WHERE \"primary\" IN ('C10', 'C11')", more=_cl))
add("R12_assembly", lambda s, d: R.assembly({"monthly": M.monthly(statement(s, d)), "ledger": L.ledger(statement(s, d)), "large": D.large_credits(statement(s, d)), "top": L.top_parties(statement(s, d))}).select(c("place").cast("bigint").alias("place"), "section", "rows"), sql("SELECT CAST(0 AS BIGINT) AS place, 'monthly' AS section, (SELECT count(*) FROM (SELECT DISTINCT account_no, month FROM st)) AS rows UNION ALL SELECT 1, 'ledger', (SELECT count(*) FROM lg) UNION ALL SELECT 2, 'large', (SELECT count(*) FROM st WHERE credit >= 100000) UNION ALL SELECT 3, 'top', (SELECT sum(least(k, 10)) FROM (SELECT side, count(DISTINCT party) AS k FROM pt GROUP BY side))", more=f"{T.LEDGER}, {LED}"))

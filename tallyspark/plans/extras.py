"""Queries of names, forensics, reports, sources and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import forensics as X
from ..operators import ledger as L
from ..operators import monthly as M
from ..operators import names as N
from ..operators import report as P
from ..operators.flags import flags, summary
from ..sources import statements as Z
from ..streaming import continuous as C
from . import sqltext as T
from .detectors import classified
from .fixtures import ACTIVITY, activity, sql, statement

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, text: str | None = None) -> None:
    QUERIES[name] = fn
    if text:
        SQL[name] = text


# --- forensics on relations made from the pages table's keys ---------------------------------------------------

META_SQL = """meta AS (SELECT page_id AS file_id, 'BANK' || CAST(page_id % 5 AS VARCHAR) AS bank, CASE WHEN page_id % 17 = 0 THEN 'Canva' WHEN page_id % 11 = 0 THEN 'Other' ELSE 'Core' || CAST(page_id % 5 AS VARCHAR) END AS creator,
 CASE WHEN page_id % 13 = 0 THEN 'iLovePDF' ELSE 'Engine' END AS producer, DATE '2024-01-01' AS created, DATE '2024-01-01' + CAST(page_id % 40 AS INT) AS modified, CAST(page_id % 6 AS INT) AS eofs, CAST(page_id % 7 + 1 AS INT) AS pages, CAST(1000 + page_id % 91 * 100 * CASE WHEN page_id % 29 = 0 THEN 50 ELSE 1 END AS BIGINT) AS file_size,
 CAST(1000 AS INT) AS text_a, CAST(1000 - page_id % 300 AS INT) AS text_b FROM pages),
spans AS (SELECT page_id AS file_id, k AS page, CASE WHEN (page_id + k) % 3 = 0 THEN 'word' || CAST(k AS VARCHAR) ELSE CAST(page_id % 97 AS VARCHAR) || '.5' || CAST(k % 10 AS VARCHAR) END AS text, 'F' || CAST((page_id * k) % CASE WHEN page_id % 4 = 0 THEN 12 ELSE 2 END AS VARCHAR) AS font, CAST(9 + k % 2 AS DOUBLE) AS size, CAST(page_id % 2 AS INT) AS color,
 CAST((k * 7) % 50 AS DOUBLE) AS x0, CAST((k * 11) % 60 AS DOUBLE) AS y0, CAST((k * 7) % 50 + 20 AS DOUBLE) AS x1, CAST((k * 11) % 60 + 10 AS DOUBLE) AS y1, (page_id + k) % 9 <> 0 AS visible FROM pages, (SELECT unnest(range(0, 14)) AS k))"""


def meta(spark: SparkSession, d: str) -> DataFrame:
    i = c("page_id")
    return spark.read.parquet(f"{d}/pages.parquet").select(
        i.alias("file_id"), F.concat(F.lit("BANK"), (i % 5).cast("string")).alias("bank"), F.when(i % 17 == 0, "Canva").when(i % 11 == 0, "Other").otherwise(F.concat(F.lit("Core"), (i % 5).cast("string"))).alias("creator"),
        F.when(i % 13 == 0, "iLovePDF").otherwise("Engine").alias("producer"), F.to_date(F.lit("2024-01-01")).alias("created"), F.date_add(F.to_date(F.lit("2024-01-01")), (i % 40).cast("int")).alias("modified"), (i % 6).cast("int").alias("eofs"), (i % 7 + 1).cast("int").alias("pages"),
        (1000 + i % 91 * 100 * F.when(i % 29 == 0, 50).otherwise(1)).alias("file_size"), F.lit(1000).alias("text_a"), (1000 - i % 300).cast("int").alias("text_b"),
    )


def spans(spark: SparkSession, d: str) -> DataFrame:
    i, k = c("page_id"), c("k")
    s = lambda x: x.cast("string")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("k")).select(
        i.alias("file_id"), k.cast("bigint").alias("page"), F.when((i + k) % 3 == 0, F.concat(F.lit("word"), s(k))).otherwise(F.concat(s(i % 97), F.lit(".5"), s(k % 10))).alias("text"), F.concat(F.lit("F"), s((i * k) % F.when(i % 4 == 0, 12).otherwise(2))).alias("font"), (9 + k % 2).cast("double").alias("size"), (i % 2).cast("int").alias("color"),
        ((k * 7) % 50).cast("double").alias("x0"), ((k * 11) % 60).cast("double").alias("y0"), ((k * 7) % 50 + 20).cast("double").alias("x1"), ((k * 11) % 60 + 10).cast("double").alias("y1"), ((i + k) % 9 != 0).alias("visible"),
    )


L1_SQL = """l1 AS (SELECT file_id, 'L1' AS layer, 'HIGH' AS severity, 'editor in metadata' AS message FROM meta WHERE creator = 'Canva' OR producer = 'iLovePDF'
 UNION ALL SELECT file_id, 'L1', CASE WHEN modified - created > 30 THEN 'HIGH' ELSE 'MEDIUM' END, 'changed after creation' FROM meta WHERE modified - created > 1
 UNION ALL SELECT file_id, 'L1', CASE WHEN eofs > 3 THEN 'HIGH' ELSE 'MEDIUM' END, 'several file ends' FROM meta WHERE eofs > 2)"""
ROLL = "SELECT file_id, CASE max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS findings, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'HIGH') AS high FROM l1 GROUP BY file_id"
MONEY = r"regexp_matches(text, '^[\d,]+\.\d{2}$')"
fsql = lambda q, *more: f"WITH {', '.join((META_SQL, *more))} {q}"

add("L1_metadata", lambda s, d: X.metadata_layer(meta(s, d)), fsql("SELECT * FROM l1", L1_SQL))
add("L2_A31_fonts", lambda s, d: X.font_layer(spans(s, d)), fsql(f"""SELECT file_id, 'L2' AS layer, 'HIGH' AS severity, 'money in mixed styles' AS message FROM (SELECT file_id, CAST(max(n) AS DOUBLE) / sum(n) AS s FROM (SELECT file_id, font, color, count(*) AS n FROM spans WHERE {MONEY} GROUP BY ALL) GROUP BY 1) WHERE s < 0.85
 UNION ALL SELECT file_id, 'L2', 'MEDIUM', 'many fonts' FROM spans GROUP BY 1 HAVING count(DISTINCT font) > 8"""))
add("A31_rare_styles", lambda s, d: X.rare_styles(spans(s, d)), fsql("SELECT file_id, font, size, chars, round(share, 6) AS share FROM (SELECT *, CAST(chars AS DOUBLE) / sum(chars) OVER (PARTITION BY file_id) AS share FROM (SELECT file_id, font, size, CAST(sum(length(text)) AS BIGINT) AS chars FROM spans GROUP BY ALL)) WHERE share < 0.05"))
add("L3_overlaps", lambda s, d: X.overlap_layer(spans(s, d).withColumn("page", c("page") % 3)), fsql(f"""SELECT DISTINCT a.file_id, 'L3' AS layer, 'HIGH' AS severity, 'overlapping text' AS message FROM spans a JOIN spans b ON a.file_id = b.file_id AND a.page % 3 = b.page % 3 AND a.text <> b.text
 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) >= 0.3 AND (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.3
 UNION ALL SELECT file_id, 'L3', 'HIGH', 'hidden amounts' FROM spans WHERE NOT visible AND {MONEY} GROUP BY 1 HAVING count(*) >= 2"""))


def page_rows(s, d):
    i = c("file_id")
    return spans(s, d).select("file_id", "page", F.when((i + c("page")) % 23 == 0, 300).otherwise(200).alias("width"), F.lit(400).alias("height"), F.when((i * c("page")) % 31 == 1, 0).otherwise(10).alias("chars"), F.lit(1).alias("images"))


add("L4_L7_pages", lambda s, d: X.page_layer(page_rows(s, d)), fsql("""SELECT file_id, 'L4' AS layer, 'MEDIUM' AS severity, 'page sizes differ' AS message FROM spans WHERE (file_id + page) % 23 = 0 GROUP BY 1 UNION ALL SELECT file_id, 'L7', 'MEDIUM', 'pages without text' FROM spans WHERE (file_id * page) % 31 = 1 GROUP BY 1"""))
add("L5_engines", lambda s, d: X.engine_layer(meta(s, d)), fsql("SELECT file_id, 'L5' AS layer, CASE WHEN pages >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'readers disagree' AS message FROM meta WHERE text_b / 1000.0 < 0.85"))


def profiles(s):
    return s.createDataFrame([(f"BANK{k}", f"core{k}", "Engine") for k in range(4)], "bank string, creator string, producer string")


add("L6_profiles", lambda s, d: X.profile_layer(meta(s, d), profiles(s)), fsql("SELECT file_id, 'L6' AS layer, 'MEDIUM' AS severity, 'unknown creator' AS message FROM meta WHERE bank <> 'BANK4' AND creator <> 'Core' || right(bank, 1) UNION ALL SELECT file_id, 'L6', 'MEDIUM', 'unknown producer' FROM meta WHERE bank <> 'BANK4' AND producer <> 'Engine'"))
add("L8_arithmetic", lambda s, d: X.arithmetic_layer(M.verify_running(statement(s, d).withColumn("balance", F.when((c("row_order") % 500 == 1) & (c("account_no") < 5), c("balance") + 1).otherwise(c("balance")))).withColumn("file_id", c("account_no"))), sql("SELECT account_no AS file_id, 'L8' AS layer, 'HIGH' AS severity, 'balances do not add up' AS message FROM st WHERE row_order % 500 = 1 AND account_no < 5 AND balance IS NOT NULL GROUP BY 1"))
add("J11_batch_comparison", lambda s, d: X.batch_comparison(meta(s, d)), fsql("""SELECT file_id, bank, creator <> top_creator AS creator_differs, producer <> top_producer AS producer_differs, page_size > 3 * mid AS size_differs FROM (SELECT *, CAST(file_size AS DOUBLE) / pages AS page_size FROM meta)
 JOIN (SELECT bank, median(CAST(file_size AS DOUBLE) / pages) AS mid FROM meta GROUP BY 1) USING (bank) JOIN (SELECT bank, arg_min(creator, (-n, creator)) AS top_creator FROM (SELECT bank, creator, count(*) AS n FROM meta GROUP BY ALL) GROUP BY 1) USING (bank)
 JOIN (SELECT bank, arg_min(producer, (-n, producer)) AS top_producer FROM (SELECT bank, producer, count(*) AS n FROM meta GROUP BY ALL) GROUP BY 1) USING (bank)"""))
add("A29_severity", lambda s, d: X.roll_up(X.metadata_layer(meta(s, d))), fsql(ROLL, L1_SQL))
add("S06_priority", lambda s, d: X.priority(X.metadata_layer(meta(s, d))), fsql("SELECT * FROM l1 ORDER BY CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, file_id, layer, message LIMIT 10", L1_SQL))
add("N13_findings", lambda s, d: X.flatten_findings(X.metadata_layer(meta(s, d)), ("several file ends",)), fsql("SELECT * FROM l1 WHERE message <> 'several file ends'", L1_SQL))
add("R11_integrity", lambda s, d: P.integrity_rows(X.roll_up(X.metadata_layer(meta(s, d)))), fsql(f"SELECT file_id, CASE risk WHEN 'LOW' THEN 'CLEAN' WHEN 'MEDIUM' THEN 'REVIEW' ELSE 'SUSPICIOUS' END AS integrity, findings FROM ({ROLL})", L1_SQL))
add("P20_visual_lines", lambda s, d: X.visual_lines(spans(s, d).withColumn("page", c("page") % 2)).select("file_id", "page", c("line").cast("bigint").alias("line"), "y0"), fsql("""SELECT file_id, page, CAST(line AS BIGINT) AS line, min(y0) AS y0 FROM (SELECT *, sum(new) OVER (PARTITION BY file_id, page ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING) AS line FROM (
 SELECT file_id, page % 2 AS page, x0, y0, CASE WHEN y0 - lag(y0) OVER (PARTITION BY file_id, page % 2 ORDER BY y0, x0) <= 3 THEN 0 ELSE 1 END AS new FROM spans)) GROUP BY ALL"""))

# --- reports ----------------------------------------------------------------------------------------------------


def keyed(s, d):
    m = M.monthly(statement(s, d)).join(M.monthly_eod(statement(s, d)), ["account_no", "month"])
    keys = ("gross_credits", "eod_lowest", "eod_highest", "eod_average")
    return m.select(c("account_no").alias("report_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("key"), c(k).alias("value")) for k in keys))).alias("k")).select("report_id", "k.*")


add("A30_merge_reports", lambda s, d: P.merge_reports(keyed(s, d)), sql("""SELECT 'gross_credits' AS key, 'sum' AS kind, round(sum(gross_credits), 2) AS value FROM j UNION ALL SELECT 'eod_lowest', 'min', round(min(eod_lowest), 2) FROM j UNION ALL SELECT 'eod_highest', 'max', round(max(eod_highest), 2) FROM j UNION ALL SELECT 'eod_average', 'mean', round(sum(eod_average) / count(*), 2) FROM j""",
    more=f"{T.MONTHLY}, {T.EOD}, j AS (SELECT * FROM mo JOIN (SELECT account_no, month, CAST(min(eod) AS DOUBLE) AS eod_lowest, CAST(max(eod) AS DOUBLE) AS eod_highest, CAST(sum(eod) AS DOUBLE) / count(*) AS eod_average FROM eod GROUP BY ALL) USING (account_no, month))"))
add("X03_X04_union_sections", lambda s, d: P.union_sections(statement(s, d).where("side = 'CR'").select("row_order", "description"), statement(s, d).where("side = 'DR'").select("row_order", F.lower("description").alias("description"), F.lit("dr").alias("origin")), keys=("description",), order="row_order").select("row_order", "origin"), sql("SELECT row_order, CASE WHEN side = 'DR' THEN 'dr' END AS origin FROM st QUALIFY row_number() OVER (PARTITION BY lower(description) ORDER BY row_order) = 1"))
add("O01_O02_F28_F33_sections", lambda s, d: P.documents(statement(s, d), "monthly").select("account_no", "section", F.length("sha256").cast("bigint").alias("digits")), sql("SELECT DISTINCT account_no, 'monthly' AS section, CAST(64 AS BIGINT) AS digits FROM st"))
add("O06_round_trip", lambda s, d: P.import_sections(P.documents(statement(s, d), "monthly")), sql("SELECT account_no, 'monthly' AS section, month, count(*) AS n, CAST(sum(credit) AS DOUBLE) AS credits, CAST(sum(debit) AS DOUBLE) AS debits FROM st GROUP BY ALL"))
add("N15_changed", lambda s, d: P.changed(P.documents(statement(s, d), "monthly"), P.documents(statement(s, d).where("account_no <> 2 OR row_order % 97 <> 1"), "monthly")), sql("SELECT DISTINCT account_no, 'monthly' AS section, CASE WHEN account_no = 2 AND EXISTS (SELECT 1 FROM st WHERE account_no = 2 AND row_order % 97 = 1) THEN 'EDITED' ELSE 'UNCHANGED' END AS status FROM st"))
add("O05_N14_aliases", lambda s, d: P.import_aliases(P.export_aliases(statement(s, d).select(F.lower("description").alias("alias"), S.party_name(c("description")).alias("canonical")))), sql("SELECT DISTINCT lower(description) AS alias, party AS canonical FROM pt", more=T.LEDGER))
add("R13_risk_sheet", lambda s, d: P.risk_sheet(summary(classified(s, d)), P.low_months(M.monthly(statement(s, d)))))
add("R14_correct_months", lambda s, d: P.correct_months(M.monthly(statement(s, d)).select("account_no", "month", F.when(c("account_no") == 4, c("closing") + 5).otherwise(c("closing")).alias("closing")), M.monthly(statement(s, d))), sql("SELECT account_no, month, closing, account_no = 4 AND closing IS NOT NULL AS corrected FROM mo", more=T.MONTHLY))

# --- names ------------------------------------------------------------------------------------------------------


def raw_names(s, d):
    k = c("row_order") % 6
    base = F.concat(F.lit("SUPPLIER "), F.element_at(F.array(*map(F.lit, ("ALPHA", "BRAVO", "CHARLIE", "DELTA"))), (c("row_order") % 4 + 1).cast("int")))
    return statement(s, d).select(F.when(k == 0, F.concat(base, F.lit(" HARDWARE SDN BHD"))).when(k == 1, F.concat(base, F.lit(" HARDWARE SDN B"))).when(k == 2, F.concat(base, F.lit(" HARDWAR SDN BHD"))).when(k == 3, "AHMAD BIN ABDULLAH").when(k == 4, "AHMAD BIN ABDULLA").otherwise(F.concat(F.lit("DUITNOW TRANSFER TO "), base, F.lit(" HARDWARE INV 1234"))).alias("name"))


add("F23_F24_clean_names", lambda s, d: N.clean_map(raw_names(s, d)))
add("E01_E02_E04_aliases", lambda s, d: N.aliases(raw_names(s, d).withColumn("name", N.cleaned(c("name"))), rules=N.RULES))
add("E03_merge_rounds", lambda s, d: N.merge_rounds(raw_names(s, d).withColumn("name", N.cleaned(c("name")))))
add("E05_overrides", lambda s, d: N.with_overrides(L.with_party(statement(s, d)).select("row_order", "party"), s.createDataFrame([("staff salary jan", "PAYROLL"), ("RETURN CHQ", "RETURNS")], "alias string, canonical string"), "party").select("row_order", "resolved"), sql("SELECT row_order, CASE party WHEN 'STAFF SALARY JAN' THEN 'PAYROLL' WHEN 'RETURN CHQ' THEN 'RETURNS' ELSE party END AS resolved FROM pt", more=T.LEDGER))
add("E06_resolve", lambda s, d: N.resolve(statement(s, d).withColumn("p1", F.when(c("row_order") % 3 == 0, "acme ")).withColumn("p2", F.when(c("row_order") % 2 == 0, "Unknown").otherwise(F.when(c("row_order") % 5 == 0, "beta"))), ("p1", "p2")).select("row_order", "party", "matched"), sql("SELECT row_order, CASE WHEN row_order % 3 = 0 THEN 'ACME' WHEN row_order % 2 <> 0 AND row_order % 5 = 0 THEN 'BETA' ELSE party END AS party, row_order % 3 = 0 OR (row_order % 2 <> 0 AND row_order % 5 = 0) AS matched FROM pt", more=T.LEDGER))
add("N1_N3_person_in_text", lambda s, d: statement(s, d).withColumn("t", F.concat(F.lit("ADVANCE ALI BIN ABU "), c("description"))).select("row_order", N.person_in_text(F.concat(F.lit("1 ALI BIN ABU 2 "), c("description"))).alias("person"), N.names_in_text(F.lit("ABU ALI"), c("t")).alias("named")), sql("SELECT row_order, 'ALI BIN ABU' AS person, true AS named FROM st"))

add("M9_party_names", lambda s, d: statement(s, d).select("row_order", c("description").alias("d"), F.element_at(F.array(*map(F.lit, ("", "A/L", "123", "Ali", "Ali Abu", "55 Acme SDN B 9", "tm unifi"))), (c("row_order") % 7 + 1).cast("int")).alias("x")).select("row_order", N.suspicious_short(c("x")).alias("short"), N.canonical_party(c("x")).alias("party")), sql("SELECT row_order, row_order % 7 < 4 AS short, CASE row_order % 7 WHEN 1 THEN 'A/L' WHEN 3 THEN 'ALI' WHEN 4 THEN 'ALI ABU' WHEN 5 THEN 'ACME SDN BHD' WHEN 6 THEN 'UNIFI' ELSE 'UNKNOWN' END AS party FROM st"))
add("N8_own_display_name", lambda s, d: N.own_display_name(statement(s, d), "Supplier 11"), sql("SELECT CASE WHEN count(*) FILTER (contains(description, 'SUPPLIER 11 SDN BHD')) > 0 THEN 'Supplier 11 SDN BHD' ELSE 'Supplier 11' END AS display FROM st"))
PAIRS = [("ALPHA HARDWARE SDN BHD", "ALPHA HARDWAR SDN BHD", 1, 1, 0, 1), ("ALI BIN ABU", "ALI ABU", 0, 1, 0, 1), ("AHMAD BIN ABDULLAH", "AHMAD BIN ABDULLA", 1, 1, 1, 1), ("ALPHA WORKS", "ALPHA WORKS CASH", 0, 1, 0, 1), ("ALPHA WORKS", "ALPHA WORKS NORTH GATE", 0, 1, 0, 0), ("ONE TWO THREE", "ONE TWO THREE LOAN", 0, 1, 0, 0)]


def name_pairs(s, d):
    """Every pair of a list, judged by the rules, once for each row of the statement's days."""
    @F.pandas_udf("similar int, equivalent int, person int, follows int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(int(N.similar(x, y)), int(N.equivalent(x, y)), int(N.similar_person(x, y)), int(N.contained(x, y))) for x, y in zip(a, b)], columns=["similar", "equivalent", "person", "follows"])

    k = (c("row_order") % len(PAIRS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in PAIRS)), k)
    return statement(s, d).select("row_order", run(pick(0), pick(1)).alias("r")).select("row_order", "r.*")


add("F26_F30_M3_M4_name_pairs", name_pairs, sql("SELECT row_order, " + ", ".join(f"CAST(CASE row_order % {len(PAIRS)} " + " ".join(f"WHEN {k} THEN {p[i]}" for k, p in enumerate(PAIRS)) + f" END AS INTEGER) AS {n}" for i, n in ((2, "similar"), (3, "equivalent"), (4, "person"), (5, "follows"))) + " FROM st"))

# --- sources ----------------------------------------------------------------------------------------------------


def printed(s, d):
    return statement(s, d).select(c("account_no").cast("string").alias("file"), F.row_number().over(Window.partitionBy("account_no").orderBy("dt", "row_order")).alias("line"), "dt", "description", c("amount").cast("double").alias("amount"), F.when(c("row_order") % 4 == 0, c("side")).alias("side"), c("balance").cast("double").alias("balance"))


add("P06_P17_canonical", lambda s, d: Z.canonical(printed(s, d)).withColumn("dt", c("dt").cast("string")), sql("""SELECT file, line, CAST(dt AS VARCHAR) AS dt, description, CASE WHEN sd = 'CR' THEN amount ELSE 0.0 END AS credit, CASE WHEN sd = 'DR' THEN amount ELSE 0.0 END AS debit, balance FROM (SELECT CAST(account_no AS VARCHAR) AS file, row_number() OVER w AS line, dt, description, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
 coalesce(CASE WHEN row_order % 4 = 0 THEN side END, CASE WHEN CAST(balance AS DOUBLE) - lag(CAST(balance AS DOUBLE)) OVER w < 0 THEN 'DR' ELSE 'CR' END) AS sd FROM st WINDOW w AS (PARTITION BY account_no ORDER BY dt, row_order))"""))
add("P18_control_totals", lambda s, d: Z.control_total_choice(statement(s, d).groupBy(c("account_no").cast("string").alias("file")).agg(F.sum("credit").cast("double").alias("c"), F.sum("debit").cast("double").alias("d")).select("file", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), v.alias("value")) for r, v in (("o", F.lit(100.0)), ("o", F.lit(7.0)), ("c", c("c")), ("c", F.lit(3.0)), ("d", c("d")), ("e", F.round(F.lit(100.0) + c("c") - c("d"), 2)), ("e", F.lit(1.0)))))).alias("x")).select("file", "x.*")).select("file", "o", "c", "d", "e"), sql("SELECT CAST(account_no AS VARCHAR) AS file, 100.0::DOUBLE AS o, CAST(sum(credit) AS DOUBLE) AS c, CAST(sum(debit) AS DOUBLE) AS d, round(100.0 + CAST(sum(credit) AS DOUBLE) - CAST(sum(debit) AS DOUBLE), 2) AS e FROM st GROUP BY account_no"))
add("P19_account_number", lambda s, d: Z.account_number(statement(s, d).select(c("account_no").cast("string").alias("file"), F.when(c("row_order") % 50 == 0, F.concat(F.lit("Account No: 5123-4567-890"), c("account_no").cast("string"))).otherwise(F.lit("none")).alias("text"))), sql("SELECT DISTINCT CAST(account_no AS VARCHAR) AS file, '51234567890' || CAST(account_no AS VARCHAR) AS account_no FROM st WHERE row_order % 50 = 0"))
add("P21_outlier_balances", lambda s, d: Z.outlier_balances(printed(s, d)).select("file", "line"), sql("""SELECT file, line FROM (SELECT CAST(account_no AS VARCHAR) AS file, row_number() OVER (PARTITION BY account_no ORDER BY dt, row_order) AS line, CAST(balance AS DOUBLE) AS balance FROM st) JOIN (SELECT CAST(account_no AS VARCHAR) AS file, quantile_disc(CAST(balance AS DOUBLE), 0.5 ORDER BY x DESC) AS mid FROM st GROUP BY 1) USING (file) WHERE balance IS NULL OR abs(balance - mid) <= 1500000""".replace("quantile_disc(CAST(balance AS DOUBLE), 0.5 ORDER BY x DESC)", "list_sort(list(CAST(balance AS DOUBLE)) FILTER (balance IS NOT NULL))[CAST(floor(count(balance) / 2.0) AS INT) + 1]")))
add("P22_nearest_balances", lambda s, d: Z.nearest_balances(statement(s, d).where("balance is not null").groupBy(c("account_no").cast("string").alias("file"), "dt").agg(F.sort_array(F.collect_list(c("balance").cast("double"))).alias("candidates"))))
add("F35_first_pattern", lambda s, d: statement(s, d).select("row_order", Z.first_pattern(c("description"), [("SALARY|EPF|SOCSO", "Payroll"), ("CHQ", "Cheque"), ("PAYMENT", "Payment")]).alias("category")), sql("SELECT row_order, CASE WHEN regexp_matches(description, 'SALARY|EPF|SOCSO') THEN 'Payroll' WHEN contains(description, 'CHQ') THEN 'Cheque' WHEN contains(description, 'PAYMENT') THEN 'Payment' ELSE 'Other' END AS category FROM st"))
add("Q_data_quality", lambda s, d: Z.quality_counts(statement(s, d).withColumn("file", c("account_no").cast("string"))), sql("SELECT CAST(account_no AS VARCHAR) AS file, count(*) AS rows, CAST(0 AS BIGINT) AS invalid_dates, CAST(0 AS BIGINT) AS missing_keys, CAST(0 AS BIGINT) AS both_sides FROM st GROUP BY 1"))

# --- streams ----------------------------------------------------------------------------------------------------


def run_stream(spark: SparkSession, d: str, build) -> DataFrame:
    """Drain the events through a stream into a written table and read it back."""
    base = N.shared_folder(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet")
    events.write.parquet(f"{base}/in")  # a stream reads a folder that files land in
    live = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    tx = live.select(c("event_id").alias("row_order"), c("user_id").alias("account_no"), "ts", c("event_type").alias("description"), F.when(c("event_type").isin("purchase", "signup"), c("value")).otherwise(0).cast("decimal(18,2)").alias("credit"), F.when(c("event_type").isin("purchase", "signup"), 0).otherwise(c("value")).cast("decimal(18,2)").alias("debit"))
    out = build(tx)
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


CLOSED = "(SELECT max(ts) - INTERVAL 7 DAY FROM activity)"
add("ST1_daily_totals", lambda s, d: run_stream(s, d, C.daily_totals).withColumn("dt", c("dt").cast("string")), sql(f"SELECT account_no, CAST(dt AS VARCHAR) AS dt, count(*) AS n, CAST(sum(credit) AS DOUBLE) AS credits, CAST(sum(debit) AS DOUBLE) AS debits FROM activity GROUP BY account_no, dt HAVING CAST(dt + 1 AS TIMESTAMP) <= {CLOSED}", ACTIVITY))
add("ST2_dedupe", lambda s, d: run_stream(s, d, lambda t: C.dedupe_stream(t, ("row_order",)).select("row_order", "account_no")), sql("SELECT row_order, account_no FROM activity", ACTIVITY))
add("ST3_repeats", lambda s, d: run_stream(s, d, C.repeats))
add("ST4_sessions", lambda s, d: run_stream(s, d, C.sessions))
add("ST5_detectors", lambda s, d: run_stream(s, d, C.detector_totals))

"""Queries of the layouts with balance markers, on words and lines printed from the statement's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import markers as K
from .fixtures import sql
from .layouts import RUN, money, numbered, pages
from .wordlayouts import DEC, PAGE, at, first_row, last_row, placed, plain

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, text: str) -> None:
    QUERIES[name] = fn
    SQL[name] = text


def agro_words(s, d) -> DataFrame:
    r = numbered(s, d).withColumn("said", F.when(c("k") == 1, "BEGINNING BALANCE").when(c("k") % 13 == 0, "FPX PAYMENT X").otherwise(F.replace("description", F.lit("BALANCE"), F.lit("FEE"))))
    sums = r.where("k > 1").groupBy(c("file").alias("s_file")).agg(F.sum("debit").alias("dr"), F.sum("credit").alias("cr"))
    r = r.join(sums, c("file") == c("s_file"), "left")
    ends, wrong = c("k") == c("n"), F.when(c("account_no") % 3 == 0, 1).otherwise(0)
    return placed(
        r,
        (30, -40, F.when(first_row(), "Aktiviti Akaun Anda")), (200, -20, F.when(first_row() & (c("k") > 1), F.concat(F.lit("OVER "), c("p").cast("string")))),
        (20, 0, F.concat(F.substring(F.date_format("dt", "dd/MM/yyyy"), 1, 6), F.substring(F.date_format("dt", "yyyy"), 3, 2))), (90, 0, c("said")), (at("k", 300), 1, money("amount")), (at("k", 400), 1, money("bal")),
        (90, 6, F.when(c("k") % 4 == 0, F.concat(F.lit("NOTE "), c("k").cast("string"), F.lit(" .50-")))), (90, 9, F.when(last_row(), "Peti Surat")), (200, 12, F.when(last_row(), "lost")),
        (20, 30, F.when(ends, F.concat(F.lit("TOTAL DEBIT "), money(F.coalesce("dr", F.lit(0)) + wrong)))), (20, 35, F.when(ends, F.concat(F.lit("TOTAL CREDIT "), money(F.coalesce("cr", F.lit(0)))))),
    )


_said = "CASE WHEN k % 13 = 0 THEN 'FPX PAYMENT X' ELSE replace(replace(description, 'BALANCE', 'FEE'), ' 0 SDN', ' SDN') END || CASE WHEN k % 4 = 0 THEN ' | NOTE ' || k ELSE '' END"
add(
    "P06_agro",
    lambda s, d: plain(K.agro(agro_words(s, d))),
    sql(
        f"""SELECT file, k AS seq, {PAGE}, CAST(dt AS VARCHAR) AS dt, CASE WHEN k = 1 THEN 'BEGINNING BALANCE' ELSE {_said} || CASE WHEN k % 9 = 0 AND k < n THEN ' | OVER ' || CAST(floor(k / 9) AS INT) ELSE '' END END AS description,
 CASE WHEN k = 1 THEN 0.0 ELSE debit END AS debit, CASE WHEN k = 1 THEN 0.0 ELSE credit END AS credit, bal AS balance, k = 1 AS marker, CASE WHEN k = 1 THEN 'Balance Marker' WHEN k % 13 = 0 THEN 'Online Payment' ELSE 'Other' END AS category,
 CASE WHEN account_no % 3 = 0 THEN '#' ELSE '' END AS "check" FROM (SELECT file, account_no, k, n, CASE WHEN year(dt) < 2000 THEN dt + INTERVAL 100 YEAR ELSE dt END::DATE AS dt, description, {DEC} FROM run)""",
        more=RUN,
    ),
)


def ambank_lines(s, d) -> DataFrame:
    r = numbered(s, d).withColumn("description", F.replace("description", F.lit("BALANCE"), F.lit("COST")))
    before = money(c("bal") - c("credit") + c("debit"))
    return pages(
        r,
        F.when(c("k") == 1, F.concat(F.lit("Statement Date / Tarikh Penyata : 01/01/"), F.date_format("dt", "yyyy"), F.lit(" - 31/12/"), F.date_format("dt", "yyyy"))),
        F.when((c("k") == 1) & (c("account_no") % 2 == 0), "Opening Balance"), F.when((c("k") == 1) & (c("account_no") % 2 == 0), before),
        F.when(first_row() & (c("p") % 3 == 2), F.concat(F.lit("Balance Brought Fwd "), before)),
        F.concat_ws(" ", F.date_format("dt", "dd-MMM"), "description", F.when(c("k") % 5 != 0, money("amount"))),
        F.when(c("k") % 4 == 0, F.concat(F.lit("MORE "), c("k").cast("string"))),
        F.when(first_row(), "Account No 123"),
        F.concat(F.when(c("k") % 7 == 0, "DR ").otherwise(""), money("bal")),
        F.when(last_row(), "TOTAL / JUMLAH 1.00 2.00"), F.when(last_row(), "lost 3.00"), F.when(last_row(), "Privacy Notice"), F.when(last_row(), "05-Jan never 4.00"),
    )


_u = "upper(text)"
_cr = f"(contains(' ' || {_u} || ' ', ' CR ') OR contains({_u}, 'CREDIT'))"
_dr = f"((contains({_u}, 'INW') AND contains({_u}, 'CHQ')) OR contains({_u}, ' DEBIT') OR contains({_u}, 'FEE') OR contains({_u}, 'CHARGE') OR contains({_u}, 'INT'))"
add(
    "P08_ambank",
    lambda s, d: plain(K.ambank(ambank_lines(s, d))),
    sql(
        f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY dt, page, o) AS seq, page, CAST(dt AS VARCHAR) AS dt, text AS description,
 CASE WHEN marker THEN 0.0 WHEN shown AND {_cr} THEN 0.0 WHEN shown AND {_dr} THEN amount WHEN known THEN debit WHEN shown THEN amount ELSE 0.0 END AS debit,
 CASE WHEN marker THEN 0.0 WHEN shown AND {_cr} THEN amount WHEN shown AND {_dr} THEN 0.0 WHEN known THEN credit ELSE 0.0 END AS credit, bal AS balance, marker
 FROM (SELECT file, {PAGE}, k AS o, dt, trim(regexp_replace(regexp_replace(description || CASE WHEN k % 4 = 0 THEN ' MORE ' || k ELSE '' END || CASE WHEN k % 7 = 0 THEN ' DR' ELSE '' END, '\\b(DR|CR)\\b', ''), ' +', ' ', 'g')) AS text, k % 5 <> 0 AS shown, k > 1 OR account_no % 2 = 0 AS known, amount, credit, debit, bal, false AS marker FROM q
 UNION ALL SELECT file, {PAGE}, k - 0.5, CAST(date_trunc('year', dt) + INTERVAL 11 MONTH AS DATE), 'Balance Brought Fwd', false, false, 0, 0, 0, round(bal - credit + debit, 2), true FROM q WHERE k % 9 = 1 AND floor((k - 1) / 9) % 3 = 2)""",
        more=f"{RUN}, q AS (SELECT file, account_no, k, dt, replace(description, 'BALANCE', 'COST') AS description, {DEC} FROM run)",
    ),
)

"""Queries of the layouts over words with coordinates, on words printed from the statement's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import words as W
from .fixtures import sql
from .layouts import RUN, money, numbered

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, text: str) -> None:
    QUERIES[name] = fn
    SQL[name] = text


def placed(rows: DataFrame, *cells: tuple[object, float, Column], scale: Column | None = None) -> DataFrame:
    """Words of every row's cells ``(x, dy, text)``: nine rows a page, 20 points apart; a cell's words follow each other."""
    shrink = F.lit(1.0) if scale is None else scale
    at = F.array(*(F.struct(F.lit(x).cast("double").alias("x"), F.lit(float(dy)).alias("dy"), t.alias("t")) for x, dy, t in cells))
    per = rows.select("file", (c("p") + 1).alias("page"), ((c("k") - 1) % 9 * 20 + 100).alias("y"), shrink.alias("s"), F.explode(at).alias("a")).where("a.t IS NOT NULL")
    per = per.select("file", "page", "y", "s", "a", F.posexplode(F.split("a.t", " ")).alias("i", "text"))
    x = (c("a.x") + c("i") * 14) * c("s")
    return per.select("file", "page", x.alias("x0"), (c("y") + c("a.dy")).alias("y0"), (x + 12 * c("s")).alias("x1"), "text", (760 * c("s")).alias("width"))


def plain(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", c("dt").cast("string")).withColumn("seq", c("seq").cast("bigint")).withColumn("page", c("page").cast("bigint"))


def at(col: str, x: float, step: int = 5) -> Column:
    """A column's place, a few points off from row to row."""
    return x + c(col) % 3 * step


def first_row() -> Column:
    """Whether a row is the first of its page."""
    return c("k") % 9 == 1


def last_row() -> Column:
    return (c("k") % 9 == 0) | (c("k") == c("n"))


def reference() -> Column:
    return F.when(c("k") % 4 == 0, F.concat(F.lit("REF "), c("k").cast("string")))


def slashed() -> Column:
    return F.date_format("dt", "dd/MM/yyyy")


PAGE = "CAST(floor((k - 1) / 9) + 1 AS BIGINT) AS page"
WITH_REF = "description || CASE WHEN k % 4 = 0 THEN ' REF ' || k ELSE '' END"
DEC = "CAST(amount AS DOUBLE) AS amount, CAST(credit AS DOUBLE) AS credit, CAST(debit AS DOUBLE) AS debit, CAST(bal AS DOUBLE) AS bal"


def affin_words(s, d) -> DataFrame:
    headed = first_row() & (c("p") % 4 != 3)
    return placed(
        numbered(s, d),
        (30, -30, F.when(headed, "DATE")), (100, -30, F.when(headed, "PARTICULARS")), (300, -30, F.when(headed, "DEBIT")), (400, -30, F.when(headed, "CREDIT")), (500, -30, F.when(headed, "BALANCE")),
        (30, 0, slashed()), (100, 0.5, c("description")), (at("k", 300), 1.5, F.when(c("debit") > 0, money("debit"))), (at("k", 400), 1.5, F.when(c("credit") > 0, money("credit"))), (at("k", 500), 1.5, money("bal")),
        (200, 9, F.when(c("k") % 10 == 0, "9.99")), (100, 9, reference()), (300, 13, F.when(c("k") % 6 == 0, "(1.OO)")),
    )


add(
    "P05_affin",
    lambda s, d: plain(W.affin(affin_words(s, d))),
    sql(
        f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY k) AS seq, {PAGE}, CAST(dt AS VARCHAR) AS dt, {WITH_REF} AS description, CASE WHEN headed THEN round(debit + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END, 2) ELSE 0.0 END AS debit,
 CASE WHEN headed THEN credit ELSE 0.0 END AS credit, bal AS balance, false AS marker FROM (SELECT file, k, dt, description, CAST(floor((k - 1) / 9) AS BIGINT) % 4 <> 3 AS headed, {DEC} FROM run WHERE NOT contains(description, 'OPENING'))""",
        more=RUN,
    ),
)


def muamalat_words(s, d) -> DataFrame:
    day = F.when(F.year("dt") >= 2000, F.date_format("dt", "dd/MM/yy")).otherwise(slashed())
    return placed(
        numbered(s, d),
        (30, -20, F.when(first_row(), "Tarikh / Date")),
        (30, 0, day), (80, 0, c("description")), (190, 1, F.concat(F.lit("R"), c("k").cast("string"))), (at("k", 300), 1, F.when(c("debit") > 0, money("debit"))), (at("k", 405), 1, F.when(c("credit") > 0, money("credit"))), (at("k", 510), 1, money("bal")),
        (620, 8, F.when(c("k") % 4 == 0, F.concat(F.lit("D "), c("k").cast("string")))),
        (80, 12, F.when(last_row(), "All items and balances")), (80, 16, F.when(last_row(), "LOST 1.00")),
        scale=F.when(c("p") % 2 == 0, 1.0).otherwise(0.5),
    )


_no_first = "regexp_matches(description, 'DEPOSIT|BALANCE')"
add(
    "P10_muamalat",
    lambda s, d: plain(W.muamalat(muamalat_words(s, d))),
    sql(
        f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY k) AS seq, {PAGE}, CAST(dt AS VARCHAR) AS dt, CASE WHEN {_no_first} THEN '' ELSE description || ' R' || k || ' ' END || CASE WHEN k % 4 = 0 THEN 'D ' || k ELSE '' END AS raw,
 trim(raw) AS description, CASE WHEN {_no_first} THEN 0.0 ELSE debit END AS debit, CASE WHEN {_no_first} THEN 0.0 ELSE credit END AS credit, CASE WHEN {_no_first} THEN 0.0 ELSE bal END AS balance, false AS marker
 FROM (SELECT file, k, dt, description, {DEC} FROM run) WHERE NOT {_no_first} OR k % 4 = 0""".replace("SELECT file, row", "SELECT * EXCLUDE (raw) FROM (SELECT file, row", 1) + ")",
        more=RUN,
    ),
)


def maybank_words(s, d) -> DataFrame:
    sign = F.when(c("k") % 2 == 0, F.when(c("side") == "CR", "+").otherwise("-")).otherwise("")
    cents = F.concat(F.lit("."), F.substring_index(money("bal"), ".", -1))
    day = F.date_format("dt", "dd/MM")
    return placed(
        numbered(s, d),
        (20, -50, F.when(c("k") == 1, F.concat(F.lit("STATEMENT DATE : 31/12/"), F.date_format("dt", "yyyy")))),
        (20, -30, F.when(first_row(), "ENTRY DATE")),
        (20, -6, F.when(c("k") % 3 == 2, day)), (20, 0, F.when(c("k") % 3 == 1, day)), (90, 0, c("description")), (400, 2, F.concat(money("amount"), sign)), (500, 2, F.when(c("k") % 5 == 0, cents).otherwise(money("bal"))),
        (95, 8, reference()), (20, 14, F.when(last_row(), "ENDING BALANCE 1.00")), (95, 18, F.when(last_row(), "LOST WORDS")),
    )


_near = "step <> 0 AND abs(abs(step) - amount) <= 500"
add(
    "P14_maybank",
    lambda s, d: plain(W.maybank(maybank_words(s, d))),
    sql(
        f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY k) AS seq, {PAGE}, CAST(day AS VARCHAR) AS dt, {WITH_REF} AS description,
 CASE WHEN step IS NULL AND k % 2 = 1 THEN amount WHEN k % 2 = 1 OR ({_near}) THEN greatest(-step, 0) WHEN side = 'DR' THEN amount ELSE 0.0 END AS debit,
 CASE WHEN step IS NULL AND k % 2 = 1 THEN 0.0 WHEN k % 2 = 1 OR ({_near}) THEN greatest(step, 0) WHEN side = 'CR' THEN amount ELSE 0.0 END AS credit, bal AS balance, false AS marker
 FROM (SELECT *, round(bal - lag(bal) OVER (PARTITION BY file ORDER BY k), 2) AS step FROM (SELECT file, k, dt, side, description, last_value(CASE WHEN k % 3 <> 0 THEN dt END IGNORE NULLS) OVER (PARTITION BY file ORDER BY k) AS day, {DEC} FROM run) WHERE k % 5 <> 0 OR k % 2 = 0)""",
        more=RUN,
    ),
)


def rakyat_words(s, d) -> DataFrame:
    silent = (c("k") % 7 == 0) & (c("k") % 9 != 1)
    totals = F.concat_ws(" ", money(F.lit(77.5)), money(F.lit(1.0)), money(F.lit(2.0)), money(c("bal")))
    return placed(
        numbered(s, d),
        (20, -40, F.when(first_row(), "TARIKH DATE")),
        (20, 0, F.when(c("k") % 5 != 0, slashed())), (20, 9, F.when(c("k") % 5 == 0, slashed())), (100, 0, F.when(c("k") % 3 != 0, "4321")), (150, 0, F.replace("description", F.lit("BALANCE"), F.lit("FEE"))),
        (at("k", 300), 1, F.when((c("debit") > 0) & ~silent, money("debit"))), (at("k", 400), 1, F.when((c("credit") > 0) & ~silent, money("credit"))), (at("k", 500), 1, money("bal")),
        (150, 9, reference()), (20, 18, F.when(c("k") == c("n"), "OPENING BALANCE")), (20, 26, F.when(c("k") == c("n"), totals)),
    )


_silent = "(k % 7 = 0 AND k % 9 <> 1)"
add(
    "P11_rakyat",
    lambda s, d: plain(W.rakyat(rakyat_words(s, d))),
    sql(
        f"""SELECT file, k AS seq, {PAGE}, CAST(dt AS VARCHAR) AS dt, CASE WHEN k % 3 <> 0 THEN '4321' ELSE '' END AS code, replace({WITH_REF}, 'BALANCE', 'FEE') AS description, CASE WHEN {_silent} THEN greatest(-step, 0) WHEN alone THEN amount ELSE debit END AS debit,
 CASE WHEN {_silent} THEN greatest(step, 0) WHEN alone THEN 0.0 ELSE credit END AS credit, bal AS balance, false AS marker, 77.5::DOUBLE AS opening
 FROM (SELECT *, round(bal - lag(bal) OVER (PARTITION BY file ORDER BY k), 2) AS step, NOT bool_or(debit > 0 AND NOT {_silent}) OVER (PARTITION BY file, floor((k - 1) / 9)) AS alone FROM (SELECT file, k, dt, description, {DEC} FROM run))""",
        more=RUN,
    ),
)


def hong_leong_words(s, d) -> DataFrame:
    printed = F.when((c("account_no") % 3 == 0) & (c("k") % 30 == 0), "(34.50)").when(c("k") % 6 == 0, F.concat((c("k") + 500).cast("string"), F.lit(".25")))
    day = F.date_format("dt", "dd-MM-yyyy")
    even = (c("account_no") % 2 == 0) & (c("k") == 1)
    return placed(
        numbered(s, d),
        (20, -80, F.when((c("k") == 1) & (c("account_no") % 4 == 1), "THE OD FACILITY")), (20, -60, F.when(c("k") == 1, "Balance from previous statement 1,000.00")),
        (20, -40, F.when(first_row() & (c("p") % 3 != 2), "Date")), (300, -40, F.when(first_row() & (c("p") % 3 != 2), "Deposit")), (400, -40, F.when(first_row() & (c("p") % 3 != 2), "Withdrawal")), (500, -40, F.when(first_row() & (c("p") % 3 != 2), "Balance")),
        (20, -20, F.when(even, day)), (90, -20, F.when(even, "Statement Period")), (505, -20, F.when(even, "700.00")),
        (20, 0, day), (90, 1, c("description")), (305, 2, F.when(c("credit") > 0, money("credit"))), (405, 2, F.when(c("debit") > 0, F.concat(money("debit"), F.lit("-")))), (515, 2, printed),
        (90, 8, reference()), (20, 13, F.when(last_row(), "Total Withdrawals 5.00")), (405, 17, F.when(last_row(), "6.00")),
    )


add(
    "P13_hong_leong",
    lambda s, d: plain(W.hong_leong(hong_leong_words(s, d))),
    sql(
        f"""SELECT file, k AS seq, {PAGE}, CAST(dt AS VARCHAR) AS dt, description || CASE WHEN credit > 0 THEN format(' {{:,.2f}}', credit) ELSE '' END || CASE WHEN debit > 0 THEN format(' {{:,.2f}}-', debit) ELSE '' END
 || CASE WHEN printed < 0 THEN ' (34.50)' WHEN printed > 0 THEN ' ' || (k + 500) || '.25' ELSE '' END || CASE WHEN k % 4 = 0 THEN ' REF ' || k ELSE '' END AS description, debit, credit, running AS balance, false AS marker FROM g""",
        more=f"""{RUN}, h AS MATERIALIZED (SELECT file, account_no, k, dt, description, credit, debit, CASE WHEN account_no % 3 = 0 AND k % 30 = 0 THEN -34.5 WHEN k % 6 = 0 THEN k + 500.25 END AS printed,
 account_no % 4 = 1 OR (account_no % 3 = 0 AND k >= 30) AS od, CASE WHEN account_no % 2 = 0 THEN 700.0 ELSE 1000.0 END AS first FROM (SELECT file, account_no, k, dt, description, {DEC} FROM run)),
 g AS (WITH RECURSIVE q AS (SELECT *, CAST(coalesce(printed, CASE WHEN NOT od AND round(first + credit - debit, 2) < 0 THEN first ELSE round(first + credit - debit, 2) END) AS DOUBLE) AS running, CAST(coalesce(printed, first) AS DOUBLE) AS anchor FROM h WHERE k = 1
 UNION ALL SELECT h.*, CAST(coalesce(h.printed, CASE WHEN NOT h.od AND round(q.running + h.credit - h.debit, 2) < 0 THEN q.anchor ELSE round(q.running + h.credit - h.debit, 2) END) AS DOUBLE), CAST(coalesce(h.printed, q.anchor) AS DOUBLE) FROM q JOIN h ON h.file = q.file AND h.k = q.k + 1) SELECT * FROM q)""",
    ),
)

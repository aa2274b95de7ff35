"""Queries of banks with several layouts, on lines, cells and words printed from the statement's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import cascades as X
from .fixtures import sql
from .layouts import RUN, money, numbered, pages
from .wordlayouts import DEC, PAGE, WITH_REF, last_row, placed, plain, reference, slashed

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, text: str) -> None:
    QUERIES[name] = fn
    SQL[name] = text


def cells_of(rows: DataFrame, cells: Column, at: Column) -> DataFrame:
    return rows.select("file", (c("p") + 1).alias("page"), at.alias("row"), cells.alias("cells"))


def kind() -> Column:
    return c("account_no") % 4


def before() -> Column:
    return money(c("bal") - c("credit") + c("debit"))


def scanned() -> Column:
    """One account's files are scanned: every fifth line is lost in the text, and recognised lines tell each day's last balance."""
    return c("account_no") == 9




def islam_inputs(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = numbered(s, d).withColumn("bal", c("bal") + F.lit("1234.56").cast("decimal(18,2)")).withColumn("file", F.when(scanned(), F.concat("file", F.lit("-scan"))).otherwise(c("file")))
    day = F.when(kind() == 3, F.concat(F.date_format("dt", "dd/MM/"), F.substring(F.date_format("dt", "yyyy"), 2, 3))).otherwise(slashed())
    lines = pages(
        r,
        F.when(c("k") == 1, F.concat(F.when(kind() == 2, "BAL B/IF ").otherwise("BAL B/F "), before())),
        F.when(c("k") % 3 == 0, "ORDINARY LINE 1.00"),
        F.when(~scanned() | (c("k") % 5 != 0), F.concat_ws(" ", day, "description", money("amount"), money("bal"))),
    )
    even = r.where(kind() == 0)
    head = cells_of(even.where("k % 9 = 1"), F.array(*map(F.lit, ("TARIKH\nDATE", "BUTIR", "DEBIT", "KREDIT", "BAKI"))), F.lit(0))
    body = cells_of(even, F.array(slashed(), F.concat_ws("\n", "description", reference()), F.when(c("debit") > 0, money("debit")), F.when(c("credit") > 0, money("credit")), money("bal")), c("k"))
    days = r.where(scanned()).groupBy("file", "dt").agg(F.max(F.struct("k", "bal")).alias("x"), F.min(F.struct("k", (c("bal") - c("credit") + c("debit")).alias("o"))).alias("o")).select("file", "dt", c("x.k").alias("k"), c("x.bal").alias("bal"), c("o.o").alias("o"))
    step = c("bal") - c("o")
    sums = days.groupBy("file").agg(F.min(F.struct("k", "o"))["o"].alias("o"), F.sum(F.greatest(step, F.lit(0))).alias("cr"), F.sum(F.greatest(-step, F.lit(0))).alias("dr"))
    top = sums.select("file", F.lit(1).alias("page"), F.explode(F.array(F.struct(F.lit(1).alias("line"), F.concat(F.lit("Bal B/F "), money("o")).alias("text")), F.struct(F.lit(2).alias("line"), F.concat(F.lit("Total Debit 5 "), money("dr"), F.lit(" Total Credit "), money("cr")).alias("text")))).alias("x")).select("file", "page", "x.*")
    told = days.select("file", F.lit(2).alias("page"), F.explode(F.array(F.struct((c("k") * 2).alias("line"), money("bal").alias("b")), F.struct((c("k") * 2 + 1).alias("line"), money(c("bal") + 7000000).alias("b")))).alias("x"), "dt")
    told = told.select("file", "page", c("x.line").alias("line"), F.concat_ws(" ", slashed(), F.lit("READ"), c("x.b")).alias("text"))
    return lines, head.unionByName(body), top.unionByName(told)


def islam(s, d) -> DataFrame:
    lines, cells, read = islam_inputs(s, d)
    return plain(X.bank_islam(lines, cells, read))


_cut = "greatest(bal - before, 0) AS credit, greatest(before - bal, 0) AS debit, bal AS balance, false AS marker"
add(
    "P09_bank_islam",
    islam,
    sql(
        f"""SELECT file, k AS seq, {PAGE}, CASE WHEN account_no % 4 <> 3 THEN CAST(dt AS VARCHAR) END AS dt, CASE WHEN account_no % 4 = 0 THEN {WITH_REF} ELSE description END AS description, debit, credit, bal AS balance, false AS marker,
 CASE account_no % 4 WHEN 0 THEN 'format1' WHEN 1 THEN 'format2' WHEN 2 THEN 'format4' ELSE 'format3' END AS layout FROM (SELECT file, account_no, k, dt, description, {DEC} FROM run) WHERE account_no <> 9
 UNION ALL SELECT file || '-scan', row_number() OVER w, 2, CAST(dt AS VARCHAR), 'READ', round(greatest(before - bal, 0), 2), round(greatest(bal - before, 0), 2), bal, false, 'read'
 FROM (SELECT file, dt, CAST(arg_max(bal, k) AS DOUBLE) AS bal, CAST(arg_min(bal - credit + debit, k) AS DOUBLE) AS before FROM run WHERE account_no = 9 GROUP BY file, dt) WINDOW w AS (PARTITION BY file ORDER BY dt)""",
        more=RUN.replace('CAST(1000000000 +', 'CAST(1000001234.56 +'),
    ),
)


def rhb_inputs(s, d) -> tuple[DataFrame, DataFrame]:
    r = numbered(s, d)
    top = c("k") == 1
    period = F.concat(F.lit("Statement Period : 1 Jan 99 - 31 Dec "), F.date_format("dt", "yyyy"))
    dashed = F.date_format("dt", "dd-MM-yyyy")
    either = lambda x: F.when(c(x) > 0, money(x)).otherwise("-")
    row = F.when(kind() == 0, F.concat_ws(" ", dashed, F.lit("123"), "description", F.lit("12345678"), either("debit"), either("credit"), F.concat(money("bal"), F.lit("+"))))
    row = row.when(kind() == 3, F.concat_ws(" ", F.date_format("dt", "ddMMM"), "description", money("bal"))).otherwise(F.concat_ws(" ", F.date_format("dt", "dd MMM"), "description", money("bal")))
    lines = pages(
        r,
        F.when(top, F.when(kind() == 0, "REFLEX CASH MANAGEMENT").when(kind() == 1, "ACCOUNT STATEMENT").when(kind() == 2, "RHB ISLAMIC").otherwise("RHB")),
        F.when(top, period),
        F.when(top & (kind() != 0), F.concat_ws(" ", F.when(kind() == 3, F.date_format("dt", "ddMMM")).otherwise(F.date_format("dt", "dd MMM")), F.when(kind() == 3, "START").otherwise("B/F"), before())),
        row,
        F.when((kind() == 1) & (c("k") % 4 == 0), reference()),
        F.when(last_row() & (kind() == 1), "PAGE NO. 7"),
        F.when(last_row() & (kind() == 1), "lost after noise"),
    )
    w = r.where("account_no = 8")
    words = placed(w, (30, 0, dashed), (90, 2, F.substring_index("description", " ", 1)), (142, 3, F.lit("Party")), (200, 4, F.lit("PARTY")), (365, 0, either("debit")), (440, 0, either("credit")), (517, 0, money("bal")), (90, 17, F.when(last_row(), "www.rhbgroup.com")), (90, 18, F.when(last_row(), "lost")))
    return lines, words


def rhb(s, d) -> DataFrame:
    return plain(X.rhb(*rhb_inputs(s, d)))


add(
    "P16_rhb",
    rhb,
    sql(
        f"""SELECT file, k AS seq, {PAGE}, CAST(dt AS VARCHAR) AS dt, CASE WHEN account_no = 8 THEN upper(split_part(description, ' ', 1)) || ' PARTY' WHEN account_no % 4 = 1 THEN {WITH_REF} ELSE description END AS description, debit, credit, bal AS balance, false AS marker,
 CASE WHEN account_no = 8 THEN 'words' WHEN account_no % 4 = 0 THEN 'table' WHEN account_no % 4 = 1 THEN 'account' WHEN account_no % 4 = 2 THEN 'islamic' ELSE 'conventional' END AS layout FROM (SELECT file, account_no, k, dt, description, {DEC} FROM run)""",
        more=RUN,
    ),
)


def cimb_inputs(s, d, forward: Column) -> tuple[DataFrame, DataFrame]:
    r = numbered(s, d).withColumn("q", F.when(forward, c("k")).otherwise(c("n") - c("k") + 1)).withColumn("p", F.floor((c("q") - 1) / 9).cast("int"))
    r = r.withColumnsRenamed({"k": "time", "q": "k"}).withColumn("description", F.replace("description", F.lit("BALANCE"), F.lit("FEE")))
    last, first = c("time") == c("n"), c("time") == 1
    text = kind() == 1
    lines = pages(
        r,
        F.when(c("k") == 1, F.concat(F.lit("TARIKH PENYATA : 05/01/"), F.date_format("dt", "yyyy"))),
        F.when(text & first, F.concat(F.lit("OPENING BALANCE "), before())),
        F.when(text, F.concat_ws(" ", slashed(), F.replace("description", F.lit("1,000"), F.lit("1000")), F.when(c("k") % 2 == 0, F.concat_ws(" ", money("amount"), money("bal"))))),
        F.when(text & (c("k") % 2 == 1), F.concat_ws(" ", reference(), F.lit("TAIL"), money("amount"), money("bal"))),
        F.when(last, F.concat(F.lit("CLOSING BALANCE / BAKI PENUTUP "), money("bal"))),
    )
    body = r.where(~text)
    day = F.when(c("k") % 3 == 0, F.date_format("dt", "dd/MM")).otherwise(slashed())
    rows = cells_of(body, F.array(day, "description", F.lit("R"), F.when(c("debit") > 0, money("debit")), F.when(c("credit") > 0, money("credit")), money("bal")), c("k") * 10 + 5)
    extra = cells_of(body.where("k % 9 = 1"), F.array(*map(F.lit, ("Date / Tarikh", "Desc", "Ref", "W", "D", "B"))), c("k") * 10)
    twice = cells_of(body.where("time % 10 = 0"), F.array(slashed(), F.lit("PRINTED AGAIN"), F.lit("R"), F.when(c("debit") > 0, money("debit")), F.when(c("credit") > 0, money("credit")), money("bal")), c("k") * 10 + 6)
    opened = cells_of(body.where("time = 1"), F.array(F.lit(None), F.lit("Opening Balance"), F.lit(None), F.lit(None), F.lit(None), before()), c("k") * 10 + 8)
    return lines, rows.unionByName(extra).unionByName(twice).unionByName(opened)


def cimb_sql(forward: str) -> str:
    """``again`` rows share every value but the text with the row before them, so one of the two stays."""
    place = f"CASE WHEN {forward} THEN k ELSE n - k + 1 END"
    return sql(
        f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY o) AS seq, page, dt, description, debit, credit, balance, marker FROM (
 SELECT file, k AS o, CAST(floor(({place} - 1) / 9) + 1 AS BIGINT) AS page, CAST(dt AS VARCHAR) AS dt, CASE WHEN account_no % 4 <> 1 THEN description
 ELSE CASE WHEN {place} % 2 = 0 THEN replace(replace(description, '1,000', '1000'), ' 0 SDN BHD', '') ELSE replace(description, '1,000', '1000') END || CASE WHEN {place} % 2 = 1 THEN CASE WHEN {place} % 4 = 0 THEN ' REF ' || {place} ELSE '' END || ' TAIL' ELSE '' END END AS description, debit, credit, bal AS balance, false AS marker FROM pr
 UNION ALL SELECT file, 0, CAST(floor(({place} - 1) / 9) + 1 AS BIGINT), CAST(CAST(date_trunc('month', (SELECT max(z.dt) FROM pr z WHERE z.file = pr.file)) AS DATE) AS VARCHAR), '{X.CIMB_MARKERS[0]}', 0, 0, round(bal - credit + debit, 2), true FROM pr WHERE k = 1
 UNION ALL SELECT file, n + 1, NULL, CAST(dt AS VARCHAR), '{X.CIMB_MARKERS[1]}', 0, 0, bal, true FROM pr WHERE k = n)""",
        more=f"{RUN}, pr AS (SELECT file, account_no, k, n, dt, replace(description, 'BALANCE', 'FEE') AS description, {DEC} FROM run)",
    )


add("P12_cimb", lambda s, d: plain(X.cimb(*cimb_inputs(s, d, F.lit(False)))), cimb_sql("false"))
add("P12_cimb_direction", lambda s, d: plain(X.cimb(*cimb_inputs(s, d, kind() == 2), found=True)), cimb_sql("account_no % 4 = 2"))


def uob_words(s, d) -> DataFrame:
    return placed(
        numbered(s, d),
        (20, -40, F.when(c("k") % 9 == 1, "Account Activities")),
        (190, -7, F.lit("JomPAY")), (200, -3.5, F.when(c("k") % 3 == 0, "Date of export")),
        (20, 0, slashed()), (100, 0, slashed()), (190, 0, F.replace(F.replace("description", F.lit("CASH"), F.lit("COIN")), F.lit("DR"), F.lit("D"))), (330, 1, money("credit")), (400, 1, money("debit")), (480, 1, money("bal")),
        (190, 5, reference()), (20, 9, F.when(last_row(), "Total Deposits 3.00")),
    )


_kept = "replace(replace(replace(description, 'CASH', 'COIN'), 'DR', 'D'), 'CHQ', 'CHQ')"
add(
    "P17_uob",
    lambda s, d: plain(X.uob(uob_words(s, d))),
    sql(
        f"""WITH t AS (SELECT *, 'JomPAY ' || {_kept} || CASE WHEN k % 4 = 0 THEN ' REF ' || k ELSE '' END AS own, strpos({_kept}, 'CHQ') AS at FROM (SELECT file, k, n, dt, description, {DEC} FROM run))
 SELECT file, k AS seq, {PAGE}, CAST(dt AS VARCHAR) AS dt, own AS description, debit, credit, bal AS balance, false AS marker FROM t""".replace("WITH t AS", "SELECT * FROM (WITH t AS") + ")",
        more=RUN,
    ),
)

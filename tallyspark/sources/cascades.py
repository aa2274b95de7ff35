"""Banks with several layouts (P09, P12, P16, P17): candidate rows of every layout side by side, one chosen for each file.

Inputs are text lines ``(file, page, line, text)``, table cells ``(file, page, row, cells array<string>)`` and words with
coordinates. All text layouts of a bank read the lines once: a line is followed once for each layout that it may fit, and each
layout's rows are a partition of their own. A file takes the first layout that gives it rows (``first_layout``), or a second
reading whose sums agree with the printed totals where the first one's do not (``agreeing``). Null texts are empty lines, empty
tables give no rows, columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bankparties import spaced
from .layouts import ROWS, amount, contains_any
from .words import MONTHS, cents, day_of, first_of, folded, inside, joined, last_, middle, visual_lines

c = F.col

# Fixed values, from here to the next comment: each layout's patterns, marks and column positions.
ISLAM_DATE = r"^\s*(\d{1,2}/\d{1,2}/\d{2,4})"
ISLAM_LAYOUTS = (  # layout, balance brought forward, amounts, least amounts in a row
    ("format2", r"(?i)BAL\s+B/F", r"\(?-?[\d,]+\.\d{2}\)?", 1),
    ("format4", r"(?i)BAL\s+B/IF", r"\d{1,3}(?:,\d{3})*\.\d{2}", 1),
    ("format3", r"(?i)BAL\s+B/F", r"\d{1,3}(?:,\d{3})*\.\d{2}", 2),
)
ISLAM_CELL_MONEY, ISLAM_GARBLED, ISLAM_SHORT, ISLAM_LONG = r"(-?[\d,]+\.\d{2})", 20, 80, 120
ISLAM_OPENING, ISLAM_DEBITS, ISLAM_CREDITS = r"BAL\s*B/F\s+((?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2})", r"TOTAL DEBIT\s+(?:\d+\s+)?(\d{1,3}(?:,\d{3})*\.\d{2})", r"TOTAL CREDIT\s+(?:\d+\s+)?(\d{1,3}(?:,\d{3})*\.\d{2})"
ISLAM_READ_MONEY = r"(?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2}"
ISLAM_MONTH = r"(?:STATEMENT\s*DATE|TARIKH\s*PENYATA)\s*:?\s*\d{1,2}/(\d{1,2})/(\d{2,4})"
CENT = 0.01
CIMB_MONEY, CIMB_ROW = r"^-?\d{1,3}(?:,\d{3})*\.\d{2}$", r"^(\d{2}/\d{2}/\d{4})\s+(.*)$"
CIMB_OPENING, CIMB_CLOSING = r"(?i)^\s*OPENING\s+BALANCE\b", r"(?i)CLOSING\s+BALANCE\s*/\s*BAKI\s+PENUTUP\s+(-?[\d,]+\.\d{2})"
CIMB_YEAR = r"(?i)(?:STATEMENT\s+DATE|TARIKH\s+PENYATA)\s*[:\s]+\d{1,2}/\d{1,2}/(\d{2,4})"
CIMB_NUMBER = r"^-?\d+(\.\d+)?$"
CIMB_MARKERS = ("OPENING BALANCE (PAGE 1)", "CLOSING BALANCE / BAKI PENUTUP")
RHB_REFLEX = ("REFLEX", "CASH MANAGEMENT", "DEPOSIT ACCOUNT SUMMARY", "TRANSACTION STATEMENT")
RHB_TABLE = ("REFLEX", "CASH MANAGEMENT", "TRANSACTION STATEMENT", "AMOUNT (DR)", "AMOUNT (CR)")
RHB_ACCOUNT = ("ACCOUNT STATEMENT", "PENYATA")
RHB_PERIODS = (
    r"(?i)Statement\s+Period.*?:\s*\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}\s*[-–—]\s*\d{1,2}\s+[A-Za-z]{3,9}\s+(\d{2,4})",
    r"(?i)\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\s+\d{1,2}\s+[A-Za-z]{3,9}\s+(\d{4})\b",
    r"(?i)Statement\s+Period.*?\b\d{1,2}\s+[A-Za-z]{3,9}\s+(\d{2,4})\b",
)
RHB_NOISE = (
    r"(?i)^(?:ACCOUNT\s+ACTIVITY|DEPOSIT\s+ACCOUNT|DEPOSIT\s+ACCOUNT\s+SUMMARY|STATEMENT\s+PERIOD|IMPORTANT\s+NOTES|IMPORTANT\s+ANNOUNCEMENTS|PAGE\s+NO\.?|RHB\s+BANK|MEMBER\s+OF\s+PIDM|PROTECTED\s+BY\s+PIDM"
    r"|DILINDUNGI\s+OLEH\s+PIDM|PRODUCT\s+NAME|ACCOUNT\s+NO\.?|CURRENCY|DATE\s+DESCRIPTION|CHEQUE\s+/\s+SERIAL|DEBIT|CREDIT|BALANCE)\b|^Total\s+Count\b"
)
RHB_START = r"^(\d{1,2})\s+([A-Za-z]{3})\b\s+(.*)$"
RHB_MONEY = r"^[+-]?\d{1,3}(?:,\d{3})*\.\d{2}[+-]?$|^[+-]?\d+\.\d{2}[+-]?$"
RHB_END, RHB_SPACED_DAY, RHB_DAY = r"([\d,]+\.\d{2}[+-]?)\s*$", r"(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b", r"(\d{1,2})\s*(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"
RHB_LINE = r"^(\d{2}-\d{2}-\d{4})\s+(.*?)\s+(-|[\d,]+\.\d{2})\s+(-|[\d,]+\.\d{2})\s+([\d,]+\.\d{2}[+-]?)$"
RHB_TEXT = 200
RHB_COLUMNS = {"description": (86, 140), "party_name": (140, 194), "reference_1": (194, 248), "reference_2": (248, 306), "debit": (362, 438), "credit": (438, 515), "balance": (515, 590)}
RHB_FOOTER = r"(?i)www\.rhbgroup\.com|For Any Enquiries|please call|603-92068118"
RHB_CELL_MONEY = r"(-|(?:\d{1,3}(?:,\d{3})*|\d+)?\.\d{2}[+-]?|\d+\.\d{2}[+-]?)"
UOB_DETAILS = (
    "DUITNOW/INSTANT TRF", "DUITNOW/INST TRF", "DUITNOW INSTANT TRF", "DUITNOW INST TRF", "JOMPAY", "JOM PAY", "FUND TRF", "MISC DR", "MISC CR", "IBG DR", "IBG CR", "RENTAS", "TELEGRAPHIC", "CASH",
    "CHEQUE DEPOSIT", "CHEQUE", "CHQ", "DR", "OD MAINTENANCE FEE", "OD COMMITMENT FEE", "OD INT CHARGE", "OD INT", "OD INTEREST", "OVERDRAFT INTEREST", "INTEREST",
)
UOB_MONEY, UOB_DATE = r"^-?(\d{1,3}(?:,\d{3})*|\d+)\.\d{2}$", r"^\d{2}/\d{2}/\d{4}$"
UOB_DATE_X, UOB_TEXT_X, UOB_TOLERANCE, UOB_LOOK_BACK = (15.0, 90.0), (185.0, 315.0), 3.0, (0.55, 55.0, 85.0)
UOB_HEADER = r"DATE OF EXPORT|^ACCOUNT ACTIVITIES$|^STATEMENT DATE TRANSACTION DATE|^STATEMENT DATE(?=.*TRANSACTION)(?=.*DESCRIPTION)"
UOB_NO_TEXT = UOB_HEADER + r"|^(?:TOTAL DEPOSITS|NOTE|ACCOUNT TRANSACTIONS|ACCOUNT TYPE)|^\d+\s+OF\s+\d+$"
UOB_NOTHING = "(NO DESCRIPTION)"
# End of the fixed values.


def first_layout(rows: DataFrame, rank: Column | str = "rank") -> DataFrame:
    """Of each file's candidate rows those of the lowest rank."""
    low = F.min(rank).over(Window.partitionBy("file"))
    return rows.withColumn("best", low).where(F.col("best").eqNullSafe(rank if isinstance(rank, Column) else c(rank))).drop("best")


def agreeing(first: DataFrame, second: DataFrame, totals: DataFrame, asked: DataFrame) -> DataFrame:
    """For the files of ``asked(file)`` the second reading where it fits the printed ``totals(file, debits, credits)`` better.

    The second reading is taken if the first has no rows, or if the first's sums are more than a cent off the totals and the
    second's are not, or it has more rows. Rows are gathered once; only sums by file are compared.
    """
    both = first.withColumn("reading", F.lit(1)).unionByName(second.withColumn("reading", F.lit(2)), allowMissingColumns=True)
    per = lambda r, f, of: f(F.when(c("reading") == r, of))
    sums = both.groupBy(c("file").alias("g_file")).agg(*(x.alias(n) for r in (1, 2) for n, x in ((f"n{r}", per(r, F.count, F.lit(1))), (f"d{r}", F.round(per(r, F.sum, c("debit")), 2)), (f"c{r}", F.round(per(r, F.sum, c("credit")), 2)))))
    sums = sums.join(totals.select(c("file").alias("t_file"), "debits", "credits"), c("g_file").eqNullSafe(c("t_file")), "left").join(asked.select(c("file").alias("k_file")).distinct(), c("g_file").eqNullSafe(c("k_file")), "left_semi")
    off = lambda r: (F.abs(F.coalesce(f"d{r}", F.lit(0.0)) - c("debits")) > CENT + 1e-9) | (F.abs(F.coalesce(f"c{r}", F.lit(0.0)) - c("credits")) > CENT + 1e-9)
    takes = (c("n2") > 0) & ((c("n1") == 0) | F.coalesce(off(1) & (~off(2) | (c("n2") > c("n1"))), F.lit(False)))
    joined_ = both.join(sums.select("g_file", takes.alias("takes")), c("file").eqNullSafe(c("g_file")), "left")
    return joined_.where(c("reading") == F.when(c("takes"), 2).otherwise(1)).drop("reading", "takes", "g_file")


def _tidy(lines: DataFrame) -> DataFrame:
    return lines.select("file", c("page").cast("int").alias("page"), c("line").cast("int").alias("line"), spaced(c("text")).alias("t")).where("t <> ''")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _without(text: Column, tokens: Column) -> Column:
    """The text without any occurrence of the tokens, trimmed after each."""
    return F.aggregate(tokens, F.trim(text), lambda a, t: F.trim(F.replace(a, t, F.lit(""))))


def _signed(text: Column) -> Column:
    """An amount whose brackets make it negative."""
    value = amount(F.regexp_replace(text, r"[()]", ""))
    return F.when(F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")), -value).otherwise(value)


def _trailing(text: Column) -> Column:
    """An amount whose sign may stand behind it."""
    value = amount(F.regexp_replace(text, r"[+-]$", ""))
    return F.when(F.endswith(text, F.lit("-")), -F.abs(value)).when(F.endswith(text, F.lit("+")), F.abs(value)).otherwise(value)


def _sides(step: Column) -> tuple[Column, Column]:
    return F.greatest(-step, F.lit(0.0)).alias("debit"), F.greatest(step, F.lit(0.0)).alias("credit")


def _seq(rows: DataFrame, *order: str) -> DataFrame:
    if "marker" not in rows.columns:
        rows = rows.withColumn("marker", F.lit(False))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy(*order)))


# --- Bank Islam -------------------------------------------------------------------------------------------------


def islam_table(cells: DataFrame) -> DataFrame:
    """Rows of printed tables: five columns if a page's first row has five and is headed by the date, else twelve.

    Twelve are number, day, customer, code, text, reference, branch, debit, credit, balance, counterparty and details; a row of
    them without amounts takes the one in its text, as a credit if the text says CR, CREDIT or IN.
    """
    first = F.min(F.struct("row", "cells")).over(Window.partitionBy("file", "page"))["cells"]
    five = (F.size(first) == 5) & F.upper(F.regexp_replace(F.coalesce(F.get(first, F.lit(0)), F.lit("")), r"\s+", "")).rlike("TARIKH|DATE")
    rows = cells.select("file", c("page").cast("int").alias("page"), c("row").cast("int").alias("line"), "cells", five.alias("five"))
    cell = lambda k: F.get("cells", F.lit(k))
    money = lambda k: F.coalesce(amount(F.regexp_extract(F.regexp_replace(cell(k), r"\s+", ""), ISLAM_CELL_MONEY, 1)), F.lit(0.0))
    pick = lambda a, b: F.when(c("five"), money(a)).otherwise(money(b))
    short = F.regexp_extract(cell(0), r"(\d{1,2}/\d{1,2}/\d{2,4})", 1)
    long = F.regexp_extract(cell(1), r"(\d{2}/\d{2}/\d{4})", 1)
    day = F.when(c("five"), _islam_day(short)).otherwise(_islam_day(long))
    parts = F.filter(F.array(*(F.trim(F.regexp_replace(cell(k), "\n", " ")) for k in (0, 3, 4, 10, 11))), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan"))
    text = F.when(c("five"), spaced(cell(1))).otherwise(F.array_join(parts, " "))
    rows = rows.where(~c("five") | (F.size("cells") >= 5)).withColumn("dt", day).withColumn("debit", pick(2, 7)).withColumn("credit", pick(3, 8)).withColumn("balance", pick(4, 9)).withColumn("description", text)
    lost = ~c("five") & (c("debit") == 0) & (c("credit") == 0)
    inward = F.upper(cell(4)).rlike("CR|CREDIT|IN")
    rows = rows.withColumn("credit", F.when(lost & inward, money(4)).otherwise(c("credit"))).withColumn("debit", F.when(lost & ~F.coalesce(inward, F.lit(False)), money(4)).otherwise(c("debit")))
    return rows.where("dt IS NOT NULL").select("file", "page", "line", "dt", "description", "debit", "credit", "balance")


def _islam_day(text: Column) -> Column:
    pattern = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$"
    return day_of(text, pattern)


def islam_lines(lines: DataFrame) -> DataFrame:
    """``(file, page, line, layout, rank, dt, description, debit, credit, balance)`` of the three text layouts.

    A layout's balance brought forward starts its chain; each dated line after it with enough amounts ends in a balance, whose
    step from the one before is the amount. The second layout leaves lines with days that do not exist out.
    """
    known = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(n).alias("layout"), F.lit(least).alias("least")) for k, (n, _, _, least) in enumerate(ISLAM_LAYOUTS)))
    rows = _tidy(lines).withColumn("raw", F.regexp_extract("t", ISLAM_DATE, 1))
    rows = rows.withColumn("dated", c("t").rlike(ISLAM_DATE + r"\b")).withColumn("started", c("raw") != "")
    rows = rows.select("*", F.explode(known).alias("k")).select("*", "k.*")
    by = lambda f: reduce(lambda out, k: F.when(c("rank") == k, f(*ISLAM_LAYOUTS[k])).otherwise(out), range(len(ISLAM_LAYOUTS)), F.lit(None))
    rows = rows.withColumn("forward", by(lambda n, f, m, least: c("t").rlike(f))).withColumn("m", by(lambda n, f, m, least: _all(c("t"), m)))
    rows = rows.withColumn("dt", _islam_day(c("raw"))).withColumn("balance", F.when(c("rank") == 0, _signed(last_(c("m")))).otherwise(amount(last_(c("m")))))
    row = ~c("forward") & F.when(c("rank") == 0, c("dated") & c("dt").isNotNull()).otherwise(c("started")) & (F.size("m") >= c("least"))
    rows = rows.where(c("balance").isNotNull() & (c("forward") | row))
    w = Window.partitionBy("file", "rank").orderBy("page", "line")
    rows = rows.withColumn("known", F.max("forward").over(w)).where("known").withColumn("step", F.round(c("balance") - F.lag("balance").over(w), 2)).where("NOT forward")
    head = F.when(c("rank") == 0, F.substring("t", F.length("raw") + 1, F.length("t"))).otherwise(F.replace("t", c("raw"), F.lit("")))
    return rows.select("file", "page", "line", "layout", "rank", "dt", _without(head, c("m")).alias("description"), *_sides(c("step")), F.round("balance", 2).alias("balance"))


def islam_read(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and totals of scanned pages' recognised lines: one balance a day, the nearest to the day's before, its step the amount.

    Where the nearest ones do not add up to the printed totals and each day's first ones do, or each day's last ones, those
    are taken. The first page tells the opening balance, without which a file has no rows, the totals, and the month that days must lie in.
    """
    rows = _tidy(lines)
    first = rows.where("page = 1").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "t"))).alias("p")).select(c("file").alias("h_file"), F.upper(F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("u"))
    year = F.regexp_extract("u", ISLAM_MONTH, 2)
    month = F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.lpad(F.regexp_extract("u", ISLAM_MONTH, 1), 2, "0"))
    found = lambda p: amount(F.regexp_extract("u", p, 1))
    head = first.select("h_file", found(ISLAM_OPENING).alias("opening"), found(ISLAM_DEBITS).alias("debits"), found(ISLAM_CREDITS).alias("credits"), F.when(c("u").rlike(ISLAM_MONTH), month).alias("month"))
    rows = rows.withColumn("raw", F.regexp_extract("t", ISLAM_DATE + r"\b", 1)).withColumn("dt", _islam_day(c("raw"))).withColumn("m", _all(c("t"), ISLAM_READ_MONEY)).where("dt IS NOT NULL AND size(m) > 0")
    rows = rows.join(head, c("file").eqNullSafe(c("h_file"))).where((c("month").isNull() | (F.date_format("dt", "yyyy-MM") == c("month"))) & c("opening").isNotNull())
    text = _without(F.substring("t", F.length("raw") + 1, F.length("t")), c("m"))
    told = ("opening", "debits", "credits")
    options = rows.withColumn("balance", amount(last_(c("m")))).withColumn("said", text).where("balance IS NOT NULL").groupBy("file", "dt", "balance").agg(F.min(F.struct("page", "line", "said")).alias("s"), F.max(F.struct("page", "line", "said")).alias("e"), *(F.first(n).alias(n) for n in told))
    ends = F.min(F.struct("s.page", "s.line", "s.said", "balance")).alias("first"), F.max(F.struct("e.page", "e.line", "e.said", "balance")).alias("last")
    days = options.groupBy("file", "dt").agg(F.sort_array(F.collect_list(F.struct("balance", "s.page", "s.line", "s.said"))).alias("o"), *ends, *(F.first(n).alias(n) for n in told))

    def step(s: tuple, options: list[dict], opening: float) -> tuple[tuple, tuple]:
        before = s[0] if s else opening
        near = min(options, key=lambda o: (abs(cents(o["balance"] - before)), o["balance"]))
        return (near["balance"],), (near["balance"], near["said"], near["page"])

    made = folded(days, ("dt",), ("o", "opening"), (), {"balance": "double", "said": "string", "page": "int"}, step)
    made = made.withColumn("near", F.struct("page", "said", "balance")).select("file", "dt", *told, "near", "first", "last")
    whole = Window.partitionBy("file")
    readings = ("near", "first", "last")
    for r in readings:
        before = F.coalesce(F.lag(f"{r}.balance").over(whole.orderBy("dt")), c("opening"))
        made = made.withColumn(f"{r}_step", F.round(c(f"{r}.balance") - before, 2))
    for r in readings:
        off = lambda sign, printed: F.abs(F.round(F.sum(F.greatest(sign * c(f"{r}_step"), F.lit(0.0))).over(whole), 2) - c(printed)) > CENT + 1e-9  # noqa: B023, E731
        made = made.withColumn(f"{r}_fits", ~off(-1, "debits") & ~off(1, "credits"))
    pick = lambda of: reduce(lambda rest, r: F.when(c(f"{r}_fits"), c(of.format(r))).otherwise(rest), reversed(readings), c(of.format("near")))
    made = made.select("file", pick("{}.page").alias("page"), F.row_number().over(whole.orderBy("dt")).alias("line"), "dt", pick("{}.said").alias("description"), *_sides(pick("{}_step")), pick("{}.balance").alias("balance"))
    return made, head.select(c("h_file").alias("file"), "debits", "credits").where("debits IS NOT NULL AND credits IS NOT NULL")


def islam_scanned(lines: DataFrame) -> DataFrame:
    """``(file)`` of files that seem scanned: by their name, or by first three pages that are all short or garbled."""
    rows = _tidy(lines)
    page = rows.groupBy("file", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("t"))
    marks = F.size(F.split(F.upper("t"), r"\(CID:")) - 1
    thin = (F.length("t") > 800) & (F.length(F.regexp_replace("t", r"[^\p{L}\p{N}]", "")) / F.length("t") < 0.15)
    garbled = (marks >= ISLAM_GARBLED) | thin
    per = page.where("page <= 3").groupBy("file").agg(F.max((F.length("t") >= ISLAM_LONG) & ~garbled).alias("good"), F.min((F.length("t") < ISLAM_SHORT) | garbled).alias("bad"))
    return per.where(F.lower("file").contains("scan") | (~c("good") & c("bad"))).select("file")


def bank_islam(lines: DataFrame, cells: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """The table's rows, else those of the second, the fourth or the third layout, whichever is the first to give any.

    ``read(file, page, line, text)`` are the recognised lines of scanned files: their rows replace the others' where the printed
    totals speak for them. Besides the common columns: ``layout``.
    """
    rows = islam_lines(lines)
    if cells is not None:
        rows = rows.withColumn("rank", c("rank") + 1).unionByName(islam_table(cells).withColumn("layout", F.lit("format1")).withColumn("rank", F.lit(0)))
    best = first_layout(rows).drop("rank")
    if read is not None:
        second, totals = islam_read(read)
        files = read.select("file").distinct()
        scanned = islam_scanned(lines).unionByName(files.join(lines.select(c("file").alias("l_file")).distinct(), c("file").eqNullSafe(c("l_file")), "left_anti"))
        best = agreeing(best, second.withColumn("layout", F.lit("read")), totals, scanned)
    return _seq(best, "page", "line").select(*ROWS, "layout")


# --- RHB --------------------------------------------------------------------------------------------------------


def _rhb_pages(lines: DataFrame) -> DataFrame:
    """Lines with their file's header, its year, and without pages of commodity certificates."""
    rows = _tidy(lines)
    texts = rows.groupBy("file", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " ").alias("text"))
    up = F.upper("text")
    has = lambda *marks: reduce(lambda a, b: a & b, (F.contains(up, F.lit(m)) for m in marks))
    other = has("SELLER/PENJUAL", "BUYER/PEMBELI") | has("CERTIFICATE NO", "NET DEPOSIT", "SELLING PRICE") | has("COMMODITY", "TRADING")
    head = F.min(F.struct("page", "text")).over(Window.partitionBy("file"))["text"]
    texts = texts.select(c("file").alias("t_file"), c("page").alias("t_page"), other.alias("other"), head.alias("head"))
    year = F.coalesce(*(F.nullif(F.regexp_extract("head", p, 1), F.lit("")) for p in RHB_PERIODS))
    texts = texts.withColumn("year", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)).withColumn("head", F.upper("head"))
    return rows.join(texts, c("file").eqNullSafe(c("t_file")) & c("page").eqNullSafe(c("t_page"))).drop("t_file", "t_page")


def _month_day(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws(" ", F.lpad(day, 2, "0"), F.initcap(month), year), "dd MMM yyyy")


def rhb_account(pages: DataFrame) -> DataFrame:
    """The account statement: a line of day and month with amounts ends in its balance; other lines go on with the row before.

    Noise and lines without amounts end a row; a balance brought forward starts the chain, before it a row has no amount.
    """
    rows = pages.where(contains_any(c("head"), RHB_ACCOUNT) & ~c("other"))
    month = F.upper(F.regexp_extract("t", RHB_START, 2))
    rows = rows.withColumn("noise", c("t").rlike(RHB_NOISE)).withColumn("dated", ~c("noise") & c("t").rlike(RHB_START)).withColumn("words", F.slice(F.split("t", " "), 3, 1 << 20))
    at = F.filter(F.transform("words", lambda x, i: F.when(x.rlike(RHB_MONEY), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.when(c("dated") & month.isin(*MONTHS), at)).withColumn("balance", _trailing(F.get("words", last_(c("at")))))
    said = F.array_join(F.slice("words", F.lit(1), F.get("at", F.lit(0))), " ")
    rows = rows.withColumn("said", F.when(c("balance").isNotNull(), said)).withColumn("u", F.upper("said"))
    rows = rows.withColumn("forward", F.contains("u", F.lit("B/F"))).withColumn("starts", c("balance").isNotNull() & ~F.contains("u", F.lit("B/F")) & ~F.contains("u", F.lit("C/F")))
    w = Window.partitionBy("file").orderBy("page", "line")
    counts = c("starts") | c("forward")
    rows = rows.withColumn("before", F.last(F.when(counts, c("balance")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("tid", F.count_if("starts").over(w)).withColumn("gid", F.count_if(c("noise") | c("dated")).over(w))
    rows = rows.withColumn("open", c("gid") == F.last(F.when(c("starts"), c("gid")), ignorenulls=True).over(w)).where(c("open"))
    dt = _month_day(F.regexp_extract("t", RHB_START, 1), F.regexp_extract("t", RHB_START, 2), c("year"))
    part = F.struct("page", "line", F.when(c("starts"), c("said")).otherwise(c("t")).alias("text"), F.when(c("starts"), dt).alias("dt"), "balance", F.round(c("balance") - c("before"), 2).alias("step"))
    made = rows.groupBy("file", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"))
    # the text is cut to its length after every line that joins it
    text = F.aggregate(F.slice("p", 2, 1 << 20), F.substring(F.expr("p[0].text"), 1, RHB_TEXT), lambda a, x: F.substring(F.trim(F.concat(a, F.lit(" "), x["text"])), 1, RHB_TEXT))
    made = made.select("file", F.expr("p[0].page").alias("page"), F.expr("p[0].line").alias("line"), F.expr("p[0].dt").alias("dt"), text.alias("description"), *_sides(F.coalesce(F.expr("p[0].step"), F.lit(0.0))), F.expr("p[0].balance").alias("balance"))
    return made.withColumn("layout", F.lit("account")).withColumn("rank", F.lit(2))


def rhb_chains(pages: DataFrame) -> DataFrame:
    """Two older text layouts: lines with a day anywhere and a balance at their end; the first balance, or one brought forward
    in the Islamic layout, starts the chain. A day that does not exist ends a layout for its file."""
    rows = pages.where(~contains_any(c("head"), RHB_REFLEX) & ~c("other")).withColumn("balance", _trailing(F.regexp_extract("t", RHB_END, 1))).where("balance IS NOT NULL")
    rows = rows.select("*", F.explode(F.array(F.struct(F.lit(3).alias("rank"), F.lit("islamic").alias("layout")), F.struct(F.lit(4).alias("rank"), F.lit("conventional").alias("layout")))).alias("k")).select("*", "k.*")
    of = lambda k: F.when(c("rank") == 3, F.regexp_extract("t", RHB_SPACED_DAY, k)).otherwise(F.regexp_extract("t", RHB_DAY, k))
    rows = rows.withColumn("day", of(0)).where("day <> ''").withColumn("dt", _month_day(of(1), of(2), c("year"))).withColumn("forward", (c("rank") == 3) & c("t").rlike(r"\b[BC]/F\b"))
    w = Window.partitionBy("file", "rank").orderBy("page", "line")
    rows = rows.withColumn("step", F.round(c("balance") - F.lag("balance").over(w), 2)).where("step IS NOT NULL AND NOT forward")
    rows = rows.withColumn("bad", F.max(c("dt").isNull()).over(Window.partitionBy("file", "rank"))).where("NOT bad")
    text = spaced(F.replace(F.regexp_replace("t", RHB_END, ""), c("day"), F.lit("")))
    return rows.select("file", "page", "line", "dt", text.alias("description"), *_sides(c("step")), "balance", "layout", "rank")


def rhb_table(pages: DataFrame) -> DataFrame:
    """The cash management table as text: day, text, debit, credit and balance in one line."""
    rows = pages.where(contains_any(c("head"), RHB_TABLE) & ~c("other") & c("t").rlike(RHB_LINE))
    part = lambda k: F.regexp_extract("t", RHB_LINE, k)
    text = F.regexp_replace(part(2), r"^\d{3}\s+", "")
    for pattern, by in ((r"(?i)\bRPP\s+INWARD\s+INST\s+TRF\b", "RPP"), (r"\s+\d{7,}\s*$", ""), (r"\s*/\s*", " / "), (r"\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, by)
    value = lambda k: F.coalesce(F.when(part(k) != "-", amount(part(k))), F.lit(0.0))
    rows = rows.withColumn("description", F.btrim(text, F.lit(" -/"))).withColumn("balance", _trailing(part(5))).withColumn("dt", day_of(part(1), r"^(\d{2})-(\d{2})-(\d{4})$"))
    rows = rows.where("description <> '' AND balance IS NOT NULL AND dt IS NOT NULL")
    return rows.select("file", "page", "line", "dt", F.substring("description", 1, RHB_TEXT).alias("description"), value(3).alias("debit"), value(4).alias("credit"), "balance", F.lit("table").alias("layout"), F.when(contains_any(c("head"), RHB_REFLEX), 1).otherwise(6).alias("rank"))


def rhb_words(words: DataFrame) -> DataFrame:
    """The cash management table by coordinates: every date opens a block down to the next one or a footer; columns are boxes.

    A row needs a balance; its text joins its columns, each once.
    """
    number = lambda n: c(n).cast("double").alias(n)
    w = words.select("file", c("page").cast("int").alias("page"), number("x0"), number("y0"), F.coalesce(c("x1"), c("x0")).cast("double").alias("x1"), F.trim("text").alias("text")).where("text <> '' AND x0 IS NOT NULL AND y0 IS NOT NULL")
    page = Window.partitionBy("file", "page")
    dated = c("text").rlike(r"^\d{2}-\d{2}-\d{4}$")
    w = w.withColumn("ends", F.min(F.when(c("text").rlike(RHB_FOOTER), c("y0"))).over(page)).withColumn("dated", dated)
    # a block begins one point above its date, so dates are counted from one point below a word
    near = page.orderBy("y0").rangeBetween(Window.unboundedPreceding, 1)
    w = w.withColumn("tid", F.count_if("dated").over(near)).where((c("tid") > 0) & (c("ends").isNull() | (c("y0") < c("ends"))) & ~c("text").rlike(RHB_FOOTER))
    made = w.groupBy("file", "page", "tid").agg(F.min(F.when(c("dated"), F.struct("y0", "text"))).alias("d"), F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "text"))).alias("w")).where("d IS NOT NULL")
    cell = lambda k: spaced(F.regexp_replace(joined(inside(c("w"), F.lit(float(RHB_COLUMNS[k][0])), F.lit(float(RHB_COLUMNS[k][1])), middle)), RHB_FOOTER, ""))
    token = lambda k: F.regexp_extract(cell(k), RHB_CELL_MONEY, 1)
    value = lambda k: F.coalesce(F.when(token(k) != "-", F.round(_trailing(F.regexp_replace(token(k), r"^\.", "0.")), 2)), F.lit(0.0))
    parts = F.filter(F.array(*(F.btrim(cell(k), F.lit(" -")) for k in ("description", "party_name", "reference_1", "reference_2"))), lambda x: x != "")
    once = F.array_join(F.array_distinct(F.transform(parts, F.upper)), " ")
    text = F.btrim(spaced(F.regexp_replace(F.regexp_replace(once, r"\s*/\s*", " / "), r"(?:\s+/\s*){2,}", " / ")), F.lit(" -/"))
    dt = day_of(c("d.text"), r"^(\d{2})-(\d{2})-(\d{4})$")
    return made.where(token("balance") != "").select("file", "page", c("tid").cast("int").alias("line"), dt.alias("dt"), text.alias("description"), value("debit").alias("debit"), value("credit").alias("credit"), value("balance").alias("balance"), F.lit("words").alias("layout")).where("dt IS NOT NULL")


def rhb(lines: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """A cash management statement by its header takes the word or text table first; others the account statement, the
    Islamic or the conventional layout, then those tables. Besides the common columns: ``layout``."""
    pages = _rhb_pages(lines)
    names = ["file", "page", "line", "dt", "description", "debit", "credit", "balance", "layout", "rank"]
    rows = rhb_account(pages).select(*names).unionByName(rhb_chains(pages).select(*names)).unionByName(rhb_table(pages).select(*names))
    if words is not None:
        heads = pages.groupBy(c("file").alias("h_file")).agg(F.max(contains_any(c("head"), RHB_REFLEX)).alias("reflex"))
        by_words = rhb_words(words).join(heads, c("file").eqNullSafe(c("h_file")), "left").withColumn("rank", F.when(c("reflex"), 0).otherwise(5))
        rows = rows.unionByName(by_words.select(*names))
    return _seq(first_layout(rows), "page", "line").select(*ROWS, "layout")


# --- CIMB -------------------------------------------------------------------------------------------------------


def latest_first(rows: DataFrame) -> DataFrame:
    """``(file, reverse)``: whether a file's rows ``(file, idx, debit, credit, balance)`` stand latest first.

    In the right order each balance is the one before plus the row's credit less its debit; the order with the smaller sum of
    differences is the right one, the printed order if they are equal.
    """
    w = Window.partitionBy("file").orderBy("idx")
    move = c("credit") - c("debit")
    down = F.abs(F.round(c("balance") - F.lag("balance").over(w) - move, 2))
    up = F.abs(F.round(c("balance") - F.lead("balance").over(w) - move, 2))
    return rows.select("file", down.alias("down"), up.alias("up")).groupBy("file").agg((F.coalesce(F.sum("up"), F.lit(0.0)) < F.coalesce(F.sum("down"), F.lit(0.0))).alias("reverse"))


def _printed_once(rows: DataFrame, found: bool) -> DataFrame:
    """Rows in printed order without those printed again, with the file's direction ``reverse``, latest first unless ``found``.

    A row equal in day, amounts and balance to one before it is printed again unless its balance goes on from that of the last
    row kept: then amounts between them cancel out, and both are rows.
    """
    same = Window.partitionBy("file", "dt", F.round("debit", 2), F.round("credit", 2), F.round("balance", 2)).orderBy("idx")
    rows = rows.withColumn("nth", F.row_number().over(same))
    if found:
        ways = latest_first(rows.where("nth = 1")).select(c("file").alias("r_file"), "reverse")
        rows = rows.join(ways, c("file").eqNullSafe(c("r_file")), "left").drop("r_file")
    else:
        rows = rows.withColumn("reverse", F.lit(True))
    whole = lambda x: F.round(x * 100).cast("long")
    rows = rows.withColumn("b", whole(c("balance"))).withColumn("m", whole(c("credit") - c("debit")))

    def step(s: tuple, nth: int, reverse: bool, b: int, m: int) -> tuple[tuple, tuple]:
        kept = nth == 1 or (s[0] - s[1] == b if reverse else s[0] + m == b)
        return ((b, m) if kept else s), (kept,)

    return folded(rows, ("idx",), ("nth", "reverse", "b", "m"), (), {"kept": "boolean"}, step).where("kept").drop("nth", "b", "m", "kept")


def _cimb_marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows in the order of time between an opening and a closing row; of rows without amounts each ``(dt, balance)`` once."""
    w = Window.partitionBy("file")
    rows = rows.withColumn("at", F.when(c("reverse"), -c("idx")).otherwise(c("idx"))).withColumn("last", F.max("dt").over(w))
    rows = rows.withColumn("at", F.row_number().over(w.orderBy("dt", "at")))
    latest = rows.groupBy(c("file").alias("l_file")).agg(F.max("dt").alias("last"), F.count("*").alias("n"))
    marks = marks.join(latest, c("m_file").eqNullSafe(c("l_file")))
    none = F.lit(0.0)
    opening = marks.where("opening IS NOT NULL").select(c("m_file").alias("file"), c("opening_page").alias("page"), F.trunc("last", "month").alias("dt"), F.lit(CIMB_MARKERS[0]).alias("description"), none.alias("debit"), none.alias("credit"), c("opening").alias("balance"), F.lit(0).alias("at"), F.lit(True).alias("marker"))
    closing = marks.where("closing IS NOT NULL").select(c("m_file").alias("file"), F.lit(None).cast("int").alias("page"), c("last").alias("dt"), F.lit(CIMB_MARKERS[1]).alias("description"), none.alias("debit"), none.alias("credit"), c("closing").alias("balance"), (c("n") + 1).cast("int").alias("at"), F.lit(True).alias("marker"))
    every = rows.select("file", "page", "dt", "description", "debit", "credit", "balance", "at", F.lit(False).alias("marker")).unionByName(opening).unionByName(closing)
    same = Window.partitionBy("file", "dt", F.round("debit", 2), F.round("credit", 2), F.round("balance", 2)).orderBy("at")
    return _seq(every.withColumn("nth", F.row_number().over(same)).where("nth = 1 OR debit <> 0 OR credit <> 0"), "at").select(*ROWS)


def _cimb_head(lines: DataFrame) -> DataFrame:
    """``(m_file, closing, year)`` from a file's lines."""
    t = _tidy(lines)
    year = F.regexp_extract("t", CIMB_YEAR, 1)
    at = F.struct("page", "line")
    closing = F.min(F.when(c("t").rlike(CIMB_CLOSING), F.struct(at, amount(F.regexp_extract("t", CIMB_CLOSING, 1)).alias("v"))))["v"]
    when = F.min(F.when((c("page") <= 2) & c("t").rlike(CIMB_YEAR), F.struct(at, F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).alias("v"))))["v"]
    return t.groupBy(c("file").alias("m_file")).agg(closing.alias("closing"), when.alias("year"))


def cimb_table(cells: DataFrame, lines: DataFrame, found: bool = False) -> DataFrame:
    """Rows of six cells day, text, reference, withdrawal, deposit and balance, printed latest first.

    Headings, rows without a balance, a day or an amount are none; the opening balance's row and the closing balance in the
    lines give marker rows on the first day of the last month and on the last day. Rows printed again, equal in day, amounts
    and balance, are one, the first printed. ``found`` tells each file's direction from its balances instead.
    """
    cell = lambda k: F.get("cells", F.lit(k))
    bare = lambda k: F.regexp_replace(cell(k), r"[\s,]", "")
    value = lambda k: F.coalesce(F.when(bare(k).rlike(CIMB_NUMBER), bare(k).try_cast("double")), F.lit(0.0))
    head = _cimb_head(lines)
    rows = cells.where((F.size("cells") >= 6) & ~F.coalesce(F.lower(cell(0)).rlike("date|tarikh"), F.lit(False)))
    text = F.trim(F.regexp_replace(F.coalesce(cell(1), F.lit("")), "\n", " "))
    rows = rows.select("file", c("page").cast("int").alias("page"), c("row").cast("int").alias("row"), text.alias("description"), F.trim(cell(0)).alias("day"), value(3).alias("debit"), value(4).alias("credit"), value(5).alias("balance"), cell(5).isNotNull().alias("has"))
    forward = F.contains(F.lower("description"), F.lit("opening balance"))
    opened = rows.where(forward & (c("balance") != 0)).groupBy(c("file").alias("o_file")).agg(F.max(F.struct("page", "row", "balance")).alias("o"))
    marks = head.join(opened, c("m_file").eqNullSafe(c("o_file")), "left").select("m_file", "closing", "year", c("o.balance").alias("opening"), c("o.page").alias("opening_page"))
    rows = rows.where(~forward & c("has")).join(marks.select(c("m_file").alias("y_file"), "year"), c("file").eqNullSafe(c("y_file")), "left")
    full = F.when(c("day").rlike(r"^\d{2}/\d{2}$"), F.concat_ws("/", "day", "year")).otherwise(c("day"))
    dt = F.coalesce(day_of(full, r"^(\d{2})/(\d{2})/(\d{4})$"), F.try_to_date(F.when(c("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), c("day")), "yyyy-MM-dd"))
    rows = rows.withColumn("dt", dt).where("dt IS NOT NULL AND (debit <> 0 OR credit <> 0)")
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("page", "row")))
    return _cimb_marked(_printed_once(rows.select("file", "page", "dt", "description", "debit", "credit", "balance", "idx"), found), marks)


def cimb_text(lines: DataFrame) -> DataFrame:
    """P12 without tables: a dated line starts a row, which ends with its first line that holds a balance, the last amount.

    Rows are put into the order of time first; then the step of the balance, from the opening balance on, is the amount.
    """
    rows = _tidy(lines)
    head = _cimb_head(lines)
    up = F.upper("t")
    closes = F.contains(up, F.lit("CLOSING BALANCE")) & F.contains(up, F.lit("BAKI"))
    words = F.split("t", " ")
    rows = rows.withColumn("words", words).withColumn("m", F.filter("words", lambda x: x.rlike(CIMB_MONEY))).withColumn("opens", c("t").rlike(CIMB_OPENING))
    first = F.filter(F.transform("words", lambda x, i: F.when((x == "0") | x.rlike(CIMB_MONEY), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("to", F.get(first, F.lit(0))).withColumn("balance", amount(last_(c("m"))))
    opened = rows.where("opens AND balance IS NOT NULL").groupBy(c("file").alias("o_file")).agg(F.max(F.struct("page", "line", "balance")).alias("o"))
    marks = head.join(opened, c("m_file").eqNullSafe(c("o_file")), "left").select("m_file", "closing", "year", c("o.balance").alias("opening"), c("o.page").alias("opening_page"))
    rows = rows.where(~c("opens") & ~closes).withColumn("starts", c("t").rlike(CIMB_ROW))
    w = Window.partitionBy("file").orderBy("page", "line")
    rows = rows.withColumn("tid", F.count_if("starts").over(w)).where("tid > 0")
    own = Window.partitionBy("file", "tid").orderBy("page", "line")
    rows = rows.withColumn("done", F.coalesce(F.max(c("balance").isNotNull()).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("NOT done")
    rest = F.slice("words", F.when(c("starts"), 2).otherwise(1), F.greatest(F.when(c("balance").isNotNull(), c("to")).otherwise(F.size("words")) - F.when(c("starts"), 1).otherwise(0), F.lit(0)))
    part = F.struct("page", "line", F.array_join(rest, " ").alias("text"), F.when(c("starts"), day_of(F.regexp_extract("t", CIMB_ROW, 1), r"^(\d{2})/(\d{2})/(\d{4})$")).alias("dt"), "balance")
    made = rows.groupBy("file", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"))
    text = F.trim(F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != ""), " "))
    made = made.select("file", F.expr("p[0].page").alias("page"), F.expr("p[0].dt").alias("dt"), text.alias("description"), last_(c("p"))["balance"].alias("balance"), c("tid").alias("idx")).where("balance IS NOT NULL AND dt IS NOT NULL")
    made = made.join(marks.select(c("m_file").alias("b_file"), "opening"), c("file").eqNullSafe(c("b_file")), "left")
    step = F.round(c("balance") - F.coalesce(F.lag("balance").over(Window.partitionBy("file").orderBy("dt", F.desc("idx"))), c("opening")), 2)
    made = made.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return _cimb_marked(made.select("file", "page", "dt", "description", *_sides(c("step")), "balance", "idx").withColumn("reverse", F.lit(True)), marks)


def cimb(lines: DataFrame, cells: DataFrame | None = None, found: bool = False) -> DataFrame:
    """The table's rows, for files without any the text's."""
    rows = cimb_text(lines).withColumn("rank", F.lit(1))
    if cells is not None:
        rows = rows.unionByName(cimb_table(cells, lines, found).withColumn("rank", F.lit(0)))
    return first_layout(rows).select(*ROWS)


# --- UOB --------------------------------------------------------------------------------------------------------

UOB_START = "(?i)(?<![A-Z0-9])(?:" + "|".join(d.replace(" ", r"\s+") for d in sorted(UOB_DETAILS, key=len, reverse=True)) + r")\b"
_MARK = "\u0001"
#: The same for Python: letters of either case and blanks of ASCII alone, as Java takes them.
_either = lambda words: "".join(f"[{x.upper()}{x.lower()}]" if x.isalpha() else r"[ \t\n\x0b\f\r]+" if x == " " else re.escape(x) for x in words)
UOB_BEGIN = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(_either(d) for d in sorted(UOB_DETAILS, key=len, reverse=True)) + r")\b")
UOB_CHEQUE = re.compile(rf"(?:{_either('CHEQUE')}|{_either('CHQ')})\b")


def _cut_at_details(text: Column) -> Column:
    """The text in pieces, each from the second on beginning with the words that begin a row's details."""
    return F.split(F.regexp_replace(text, UOB_START, _MARK + "$0"), _MARK)


def _begins(pieces: Column) -> Column:
    return (F.size(pieces) > 1) & (pieces[0] == "")


def _pieces(text: str) -> list[str]:
    """``_cut_at_details`` of one text."""
    return UOB_BEGIN.sub(lambda m: _MARK + m.group(), text).split(_MARK)


def _start(pieces: list[str]) -> bool:
    return len(pieces) > 1 and pieces[0] == ""


def _bars(text: Column) -> Column:
    return F.contains(text, F.lit("||"))


def repaired_tails(rows: DataFrame) -> DataFrame:
    """Descriptions whose tail is the next row's beginning, or whose beginning is the tail of the row before.

    ``rows(file, seq, description, ...)``. Going down, a row that begins with the words of a detail hands its last such words
    and what follows to a next row that does not begin with them; a row of such words only lends them and keeps them. Then the
    text before a row's first such words, if it holds a double bar, goes up to the row before; ``DR`` or ``CR`` and one word
    behind the bars stay. Then tails go down once more, to any row that does not begin with them, though cheques' words only
    behind bars; and fronts go up once more. What goes down may go on, so that is a fold over the file's rows.
    """
    w = Window.partitionBy("file").orderBy("seq")
    rows = rows.withColumn("d", spaced(c("description"))).withColumn("next", F.lead("d").over(w))

    def hand_down(s: tuple, own: str | None, following: str | None) -> tuple[tuple, tuple]:
        d = " ".join(x for x in (*s, own) if x is not None).strip(" ")
        pieces = _pieces(d)
        if d == "" or not following or not _start(pieces) or _start(_pieces(following)):
            return (None,), (d,)
        if d[UOB_BEGIN.match(d).end() :].strip(" ") == "":
            return (d,), (d,)
        kept, tail = "".join(pieces[:-1]).strip(" "), pieces[-1].strip(" ")
        return ((tail,), (kept,)) if len(pieces) > 2 and kept != "" and tail != "" else ((None,), (d,))

    def go_up(table: DataFrame, stays: bool) -> DataFrame:
        pieces = _cut_at_details(c("d"))
        front, rest = F.trim(pieces[0]), F.trim(F.array_join(F.slice(pieces, 2, 1 << 20), ""))
        up = (F.size(pieces) > 1) & (front != "") & (rest != "") & _bars(front) & (F.row_number().over(w) > 1)
        if stays:
            up = up & ~F.startswith("d", F.lit("NO TRANSACTIONS"))
            split = r"(?i)^(.+?\|\|)\s+((?:DR|CR)\s+\S+)\s*$"
            own = F.when(front.rlike(split), F.regexp_extract(front, split, 2))
            front = F.when(front.rlike(split), F.regexp_extract(front, split, 1)).otherwise(front)
            rest = F.concat_ws(" ", own, rest)
        table = table.withColumn("gives", F.when(up, spaced(front))).withColumn("left", F.when(up, spaced(rest)).otherwise(c("d")))
        return table.withColumn("d", spaced(F.concat_ws(" ", "left", F.lead("gives").over(w)))).drop("gives", "left")

    def hand_tail(s: tuple, own: str, more: bool) -> tuple[tuple, tuple]:
        (lent,) = s
        d = own if lent is None or own.upper().startswith(lent.upper()) else f"{lent} {own}".strip(" ")
        pieces = _pieces(d)
        kept, tail = "".join(pieces[:-1]).strip(" "), pieces[-1].strip(" ")
        leaks = more and len(pieces) > 2 and kept != "" and ("||" in kept or not UOB_CHEQUE.match(tail))
        return ((tail,), (kept,)) if leaks else ((None,), (d,))

    others = [n for n in rows.columns if n not in ("d", "next", "description")]
    rows = folded(rows.select(*others, "d", "next"), ("seq",), ("d", "next"), (None,), {"done": "string"}, hand_down)
    rows = go_up(rows.select(*others, c("done").alias("d")), True).withColumn("more", F.lead("seq").over(w).isNotNull())
    rows = folded(rows.select(*others, "d", "more"), ("seq",), ("d", "more"), (None,), {"done": "string"}, hand_tail)
    return go_up(rows.select(*others, c("done").alias("d")), False).withColumnRenamed("d", "description")


def uob(words: DataFrame) -> DataFrame:
    """A line with a day on the left and three amounts is a row: deposit, withdrawal and balance.

    Its text stands in the description column, from the first line between the row before and itself that begins with the words
    of a detail, else from half way to the row before, down to where the next row's begins. Rows that leaked into their
    neighbours are repaired (``repaired_tails``).
    """
    lines = visual_lines(words, UOB_TOLERANCE, anchored=True)
    left = first_of(c("words"), lambda w: F.when(w["text"].rlike(UOB_DATE) & w["x0"].between(*UOB_DATE_X), w["text"]))
    lines = lines.withColumn("day", left).withColumn("m", F.filter("words", lambda w: w["text"].rlike(UOB_MONEY))).withColumn("row", c("day").isNotNull() & (F.size("m") >= 3))
    said = joined(F.filter("words", lambda w: (w["x0"] >= UOB_TEXT_X[0]) & (w["x0"] < UOB_TEXT_X[1])))
    lines = lines.withColumn("said", said).withColumn("u", F.upper(joined(c("words")))).withColumn("detail", _begins(_cut_at_details(c("said"))))
    page = Window.partitionBy("file", "page").orderBy("line")
    value = lambda k: amount(F.get("m", F.size("m") - k)["text"])
    rows = lines.where("row").select("file", "page", "line", "y", "day", value(3).alias("deposit"), value(2).alias("withdrawal"), value(1).alias("balance"))
    before, after = F.lag("y").over(page), F.lead("y").over(page)
    back, alone, most = UOB_LOOK_BACK
    low = F.when(before.isNotNull(), (before + c("y")) / 2).otherwise(F.greatest(F.lit(0.0), c("y") - F.least(F.lit(most), F.coalesce((after - c("y")) * back, F.lit(alone)))))
    rows = rows.withColumn("low", F.greatest(F.lit(0.0), low - UOB_TOLERANCE)).withColumn("tid", F.row_number().over(page))
    # a page's starts are a short list beside each of its lines
    tops = F.sort_array(F.collect_list(F.when(c("detail"), c("y")))).alias("tops")
    per = lines.groupBy(c("file").alias("a_file"), c("page").alias("a_page")).agg(tops)
    rows = rows.join(per, c("file").eqNullSafe(c("a_file")) & (c("page") == c("a_page")))
    rows = rows.withColumn("start", F.coalesce(F.get(F.filter("tops", lambda t: (t >= c("low")) & (t <= c("y"))), F.lit(0)), c("low"))).drop("tops", "a_file", "a_page")
    starts = rows.groupBy(c("file").alias("s_file"), c("page").alias("s_page")).agg(F.collect_list("start").alias("starts"))
    text = lines.join(starts, c("file").eqNullSafe(c("s_file")) & (c("page") == c("s_page"))).withColumn("tid", F.size(F.filter("starts", lambda s: s <= c("y"))))
    text = text.where((c("tid") > 0) & (c("said") != "") & ~c("u").rlike(UOB_NO_TEXT) & ~F.upper("said").rlike(UOB_HEADER))
    text = text.groupBy(c("file").alias("t_file"), c("page").alias("t_page"), c("tid").alias("t_tid")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), " ").alias("text"))
    made = rows.join(text, c("file").eqNullSafe(c("t_file")) & (c("page") == c("t_page")) & (c("tid") == c("t_tid")), "left")
    made = made.select("file", "page", "line", day_of(c("day"), r"^(\d{2})/(\d{2})/(\d{4})$").alias("dt"), F.coalesce("text", F.lit(UOB_NOTHING)).alias("description"), F.abs("withdrawal").alias("debit"), F.abs("deposit").alias("credit"), "balance")
    return repaired_tails(_seq(made, "page", "line")).select(*ROWS)

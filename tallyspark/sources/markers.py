"""Two more layouts (P06, P08): rows over several lines with balance markers between them, from words and from lines.

Words and lines are as in ``words`` and ``layouts``; what a row needs of the rows before it is a window over its file. Null texts
are empty, empty tables give no rows, other columns are ignored, days that do not exist begin no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bankparties import spaced
from .layouts import ROWS, amount, contains_any
from .statements import first_pattern
from .words import day_of, first_of, joined, last_, visual_lines

c = F.col

# Fixed values, from here to the next comment: the layouts' patterns, marks, positions and categories.
AGRO_TOLERANCE, AGRO_TEXT_X, AGRO_STEP, CENT = 2.0, 180.0, 0.0001, 0.01
AGRO_DATE, AGRO_MONEY, AGRO_ZERO = r"^\d{1,2}/\d{2}/\d{2}$", r"^((?:\d{1,3}(?:,\d{3})*|\d+)?\.\d{2})(-)?$", r"^(?:0|0?\.00)(?:-)?$"
AGRO_FOOTERS = (
    "BANK PERTANIAN MALAYSIA BERHAD", "PETI SURAT", "SEMUA CATATAN", "SEKIRANYA TERDAPAT SEBARANG PERTANYAAN", "DEEMED TO BE CORRECT", "PLEASE CALL AT OUR NEAREST BRANCH", "AKTIVITI AKAUN ANDA",
    "DATE REFERENCE NO. DETAILS", "DEBIT(-)/CREDIT", "TARIKH PENYATA", "STATEMENT DATE", "A/C NO:", "PENYATA AKAUN", "ACCOUNT STATEMENT",
)
AGRO_FIGURE = r"([\d,]*\d?\.\d{2})"
AGRO_ZONE = ("AKTIVITI AKAUN ANDA", "DATE REFERENCE NO.", "DEBIT(-)/CREDIT")
AGRO_MARKERS = ("BEGINNING BALANCE", "CLOSING BALANCE")
AGRO_CATEGORIES = [
    (r"\bCDM\s+CA\s+DEPOSIT\b", "Cash Deposit (CDM)"), (r"\bDUITNOW/INSTANT\s+DR\b", "DuitNow Debit"), (r"\bDUITNOW/INSTANT\s+CR\b", "DuitNow Credit"), (r"\b(?:OUTWARD\s+IBG\s+DEBIT|INWARD\s+IBG\s+CREDIT)\b", "Interbank Transfer"),
    (r"\bINWARD\s+RENTAS\s+CREDIT\b", "High Value (RENTAS)"), (r"\bFPX\s+PAYMENT\b", "Online Payment"), (r"\b(?:IBFT\s+INEB-INWTRF|FUND\s+RM\s*\.00\s+BRANCH\s+OTC)\b", "Internal/Other"),
]
AMBANK_START = r"(?i)^(\d{1,2})\s*[-/]?\s*(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b\s*(.*)$"
AMBANK_MONEY = r"(?<!\d)(?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2}(?!\d)"
AMBANK_FORWARD, AMBANK_TOTAL = r"(?i)^\s*Balance\s+Brought\s+Fwd\b", r"(?i)\bTOTAL\s*/\s*JUMLAH\b"
AMBANK_RANGE, AMBANK_DAY = r"(?i)STATEMENT\s+DATE.*?:\s*\d{2}/\d{2}/\d{4}\s*-\s*(\d{2}/\d{2}/\d{4})", r"(?i)STATEMENT\s+DATE\s*/\s*TARIKH\s+PENYATA\s*:?\s*(\d{2}/\d{2}/\d{4})"
AMBANK_OPENING, AMBANK_NEAR = r"(?i)(?:OPENING\s+BALANCE|BAKI\s+PEMBUKAAN)", 5
AMBANK_ENDS = r"^(?:1\. )?PRIVACY NOTICE"
AMBANK_NOISE = r"DEPOSITS COMBINED STATEMENT|DETAILED ACCOUNT TRANSACTION|^DATE (?=.*TRANSACTION)(?=.*DEBIT)|^(?:ACCOUNT NAME|PRODUCT NAME|ACCOUNT NO|STATEMENT DATE|PAGE / MUKA SURAT)"
AMBANK_MARKER, AMBANK_NOTHING = "Balance Brought Fwd", "(NO DESCRIPTION)"
# End of the fixed values.


def _value(text: Column) -> Column:
    """An amount that may begin with its point; a minus behind it makes it negative."""
    number = amount(F.regexp_replace(F.regexp_extract(text, AGRO_MONEY, 1), r"^\.", "0."))
    return F.when(F.regexp_extract(text, AGRO_MONEY, 2) == "-", -number).otherwise(number)


def agro(words: DataFrame) -> DataFrame:
    """A line that begins with a day and holds an amount is a row; lines follow it until the next day or a footer.

    The step of the balance is the amount. Beginning and closing balances are marker rows. On a later page, lines far to the
    right behind the table's heading and before the page's first row go on with the last row that is no marker. Besides the
    common columns: ``category`` and ``check``, ``#`` on all rows of a file whose sums are more than a cent off its printed
    totals, of which the last page's count.
    """
    lines = visual_lines(words, AGRO_TOLERANCE)
    # an array or a text that is asked for several times is a column of its own, so that it is made once a line
    lines = lines.withColumn("t", joined(c("words"))).withColumn("u", F.upper("t")).withColumn("token", c("words")[0]["text"]).withColumn("left", c("words")[0]["x0"])
    money = F.filter("words", lambda w: w["text"].rlike(AGRO_MONEY))
    plain = F.filter("words", lambda w: ~w["text"].rlike(AGRO_MONEY) & ~w["text"].rlike(AGRO_ZERO))
    lines = lines.withColumn("money", money).withColumn("printed", last_(c("money"))["text"]).withColumn("plain", plain).drop("words", "money")
    lines = lines.withColumn("dated", c("token").rlike(AGRO_DATE)).withColumn("balance", _value(c("printed"))).withColumn("footer", contains_any(c("u"), AGRO_FOOTERS))
    lines = lines.withColumn("day", F.when(c("dated"), day_of(c("token"), r"^(\d{1,2})/(\d{2})/(\d{2})$"))).withColumn("starts", c("dated") & c("balance").isNotNull() & c("day").isNotNull())
    head = F.filter("plain", lambda w: ~w["text"].rlike(AGRO_DATE))
    lines = lines.withColumn("said", joined(F.when(c("starts"), head).otherwise(c("plain"))))
    figure = lambda word: F.when(F.contains("u", F.lit(word)) & c("t").rlike(AGRO_FIGURE), F.struct("line", amount(F.regexp_replace(F.regexp_extract("t", AGRO_FIGURE, 1), r"^\.", "0.")).alias("v")))
    lines = lines.withColumn("debits", figure("TOTAL DEBIT")).withColumn("credits", figure("TOTAL CREDIT")).withColumn("zoned", contains_any(c("u"), AGRO_ZONE))
    lines = lines.select("file", "page", "line", "dated", "footer", "starts", "day", "balance", "said", "left", "debits", "credits", "zoned")
    page, file = Window.partitionBy("file", "page").orderBy("line"), Window.partitionBy("file").orderBy("page", "tid")
    lines = lines.withColumn("tid", F.count_if("starts").over(page)).withColumn("gid", F.count_if(c("dated") | c("footer")).over(page))
    lines = lines.withColumn("own", c("gid") == F.last(F.when(c("starts"), c("gid")), ignorenulls=True).over(page))
    lines = lines.withColumn("own", F.when(c("starts"), True).otherwise(c("own") & ~c("footer"))).withColumn("zone", F.max("zoned").over(page))
    # lines at the top of a later page go to the last row before them that is no marker
    top = (c("tid") == 0) & c("zone") & ~c("dated") & ~c("footer") & (c("left") >= AGRO_TEXT_X) & (c("said") != "")
    own, more = F.when((c("tid") > 0) & c("own"), F.struct("line", "day", "balance", "said")), F.when(top, F.struct("page", "line", "said"))
    made = lines.groupBy("file", "page", "tid").agg(F.sort_array(F.collect_list(own)).alias("p"), F.sort_array(F.collect_list(more)).alias("tops"), F.max("debits").alias("debits"), F.max("credits").alias("credits"))
    text = F.array_join(F.concat(F.array(F.get("p", F.lit(0))["said"]), F.filter(F.transform(F.slice("p", 2, 1 << 20), lambda x: x["said"]), lambda t: t != "")), " | ")
    paged = lambda n: F.when(c(n).isNotNull(), F.struct("page", f"{n}.line", f"{n}.v")).alias(n)
    made = made.select("file", "page", "tid", F.get("p", F.lit(0))["day"].alias("dt"), F.get("p", F.lit(0))["balance"].alias("balance"), F.when(c("tid") > 0, text).alias("text"), "tops", paged("debits"), paged("credits"))
    made = made.where("tid > 0 OR size(tops) > 0 OR debits IS NOT NULL OR credits IS NOT NULL").withColumn("u", F.upper("text"))
    kind = F.when(F.contains("u", F.lit(AGRO_MARKERS[0])), AGRO_MARKERS[0]).when(F.contains("u", F.lit(AGRO_MARKERS[1])), AGRO_MARKERS[1])
    made = made.withColumn("kind", kind)
    # a row that is no marker opens a run, in which the tops of later pages are its own
    whole, run = Window.partitionBy("file"), Window.partitionBy("file", "run")
    made = made.withColumn("before", F.last("balance", ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1))).withColumn("run", F.count_if((c("tid") > 0) & c("kind").isNull()).over(file))
    for n in ("debits", "credits"):
        made = made.withColumn(n, F.max(n).over(whole)["v"])
    made = made.withColumn("tail", F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("tops").over(run))), lambda x: x["said"]), " | ")).where("tid > 0")
    made = made.withColumn("step", c("balance") - c("before"))
    step = F.when(F.coalesce(c("kind") == AGRO_MARKERS[0], F.lit(False)) | (F.abs("step") <= AGRO_STEP), 0.0).otherwise(F.coalesce("step", F.lit(0.0)))
    made = made.withColumn("credit", F.round(F.greatest(step, F.lit(0.0)), 2)).withColumn("debit", F.round(F.greatest(-step, F.lit(0.0)), 2))
    made = made.withColumn("category", F.when(c("kind").isNotNull(), "Balance Marker").otherwise(first_pattern(c("text"), AGRO_CATEGORIES))).withColumn("description", F.coalesce("kind", F.concat_ws(" | ", F.nullif("text", F.lit("")), F.nullif("tail", F.lit("")))))
    off = lambda side, printed: F.coalesce(F.abs(F.round(F.sum(side).over(whole), 2) - c(printed)) > CENT + 1e-9, F.lit(False))
    made = made.withColumn("check", F.when(off("debit", "debits") | off("credit", "credits"), "#").otherwise(""))
    made = made.withColumn("seq", F.row_number().over(file)).withColumn("marker", c("kind").isNotNull()).withColumn("balance", F.round("balance", 2))
    return made.select(*ROWS, "category", "check")


def _side(text: Column) -> Column:
    """The side that a text tells, by the first of its signs."""
    u = F.upper(text)
    has = lambda m: F.contains(u, F.lit(m))
    padded = F.concat(F.lit(" "), u, F.lit(" "))
    return F.when(F.contains(padded, F.lit(" CR ")) | has("CREDIT") | has("DUITNOW CR"), "CR").when((has("INW") & has("CHQ")) | has(" DEBIT") | has("/DEBIT") | has("FEE") | has("CHARGE") | has("INT"), "DR")


def ambank(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """A line that begins with day and month starts a row, all lines up to the next one or the page's end belong to it.

    Its last amount is the balance, the one before it the amount; words tell the side, else the step of the balance, else it is
    a debit. A balance brought forward is a marker row on the first of the statement's month; it also stands before the
    rows above it on its page, and before a file's first row stands the opening balance of its first page. A row without a
    second amount takes the step. Rows are ordered by day and page. Without a statement date ``default_year`` is the year.
    """
    money = lambda t: F.regexp_extract_all(t, F.lit(f"({AMBANK_MONEY})"), F.lit(1))
    # lines are followed page by page and only their rows file by file, as a file's lines may be more than a task holds
    rows = lines.select("file", c("page").cast("int").alias("page"), c("line").cast("int").alias("line"), spaced(c("text")).alias("t")).where("t <> ''")
    page, whole = Window.partitionBy("file", "page").orderBy("line"), Window.partitionBy("file", "page")
    rows = rows.withColumn("nth", F.row_number().over(page)).withColumn("over", F.max(F.upper("t").rlike(AMBANK_ENDS)).over(page))
    rows = rows.withColumn("away", c("nth") - F.min(F.when(c("t").rlike(AMBANK_OPENING), c("nth"))).over(whole)).withColumn("out", c("over") | F.upper("t").rlike(AMBANK_NOISE))
    rows = rows.withColumn("total", ~c("out") & c("t").rlike(AMBANK_TOTAL)).withColumn("forward", ~c("out") & ~c("total") & c("t").rlike(AMBANK_FORWARD))
    rows = rows.withColumn("forward", c("forward") & (F.count_if(c("forward") & c("t").rlike(AMBANK_MONEY)).over(page) <= 1))
    rows = rows.withColumn("starts", ~c("out") & ~c("forward") & ~c("total") & c("t").rlike(AMBANK_START)).withColumn("gid", F.count_if(c("starts") | c("total")).over(page))
    rows = rows.withColumn("tid", F.count_if("starts").over(page)).withColumn("open", c("gid") == F.last(F.when(c("starts"), c("gid")), ignorenulls=True).over(page))
    brought = F.when(c("forward"), amount(last_(money(c("t")))))
    rows = rows.withColumn("brought", brought).withColumn("top", F.min(F.when(c("brought").isNotNull(), F.struct("line", "brought"))).over(whole)["brought"])
    body = F.when(c("starts"), F.regexp_extract("t", AMBANK_START, 3)).otherwise(c("t"))
    part = F.when(c("open") & ~c("forward") & ~c("total") & ~c("out"), F.struct("line", F.nullif(body, F.lit("")).alias("b")))
    day = F.max(F.when(c("starts"), F.concat_ws(" ", F.lpad(F.regexp_extract("t", AMBANK_START, 1), 2, "0"), F.initcap(F.regexp_extract("t", AMBANK_START, 2)))))
    stamp = lambda p: F.min(F.when(c("page").isNotNull() & c("t").rlike(p), F.struct("page", "line", F.regexp_extract("t", p, 1).alias("v"))))
    rank = F.when(c("away") == 0, 0).when(c("away").between(-AMBANK_NEAR, -1), -c("away")).when(c("away").between(1, AMBANK_NEAR), c("away") + AMBANK_NEAR)
    opening = F.min(F.when(c("page").isNotNull() & rank.isNotNull() & c("t").rlike(AMBANK_MONEY), F.struct("page", rank.alias("r"), amount(last_(money(c("t")))).alias("v"))))
    mark = F.min(F.when(c("brought").isNotNull(), F.struct("line", "brought")))
    made = rows.groupBy("file", "page", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"), day.alias("day"), mark.alias("mark"), F.first("top").alias("top"), stamp(AMBANK_RANGE).alias("range"), stamp(AMBANK_DAY).alias("stamp"), opening.alias("opening"))
    made = made.withColumn("t", F.array_join(F.transform("p", lambda x: x["b"]), " ")).withColumn("m", money(c("t")))
    made = made.withColumn("balance", amount(last_(c("m")))).withColumn("shown", F.when(F.size("m") > 1, F.get("m", F.size("m") - 2)))
    # one occurrence each of balance, a side behind it, and amount goes
    drop = lambda t, token: F.when(token.isNull() | (F.instr(t, token) == 0), t).otherwise(F.concat(F.substring(t, F.lit(1), F.instr(t, token) - 1), F.substring(t, F.instr(t, token) + F.length(token), F.length(t))))
    made = made.withColumn("text", F.regexp_replace(drop(c("t"), last_(c("m"))), r"(?i)^(.*?)\b(?:DR|CR)\b", "$1"))
    made = made.withColumn("description", F.coalesce(F.nullif(spaced(drop(c("text"), c("shown"))), F.lit("")), F.lit(AMBANK_NOTHING)))
    row = F.when(F.size("m") > 0, F.struct(F.get("p", F.lit(0))["line"].alias("line"), "day", "description", "balance", amount(c("shown")).alias("amt"), F.lit(False).alias("marker")))
    none = lambda kind: F.lit(None).cast(kind)
    marked = F.when(c("mark").isNotNull(), F.struct(c("mark.line").alias("line"), none("string").alias("day"), F.lit(AMBANK_MARKER).alias("description"), c("mark.brought").alias("balance"), none("double").alias("amt"), F.lit(True).alias("marker")))
    # a page that gives no row is there for the file's first page and for what it prints
    every = made.select("file", "page", "top", "range", "stamp", "opening", F.explode_outer(F.array_compact(F.array(row, marked))).alias("x")).select("file", "page", "top", "range", "stamp", "opening", "x.*")
    file = Window.partitionBy("file")
    every = every.withColumn("head", F.min("page").over(file))
    for n in ("range", "stamp", "opening"):
        every = every.withColumn(n, F.min(n).over(file))
    for n in ("range", "stamp", "opening"):
        every = every.withColumn(n, F.when(c(f"{n}.page") == c("head"), c(f"{n}.v")))
    every = every.withColumn("stamp", F.try_to_date(F.coalesce("range", "stamp"), "dd/MM/yyyy"))
    year = F.coalesce(F.year("stamp"), F.lit(default_year)).cast("string")
    begun = F.coalesce(F.trunc("stamp", "month"), F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd"))
    every = every.withColumn("dt", F.when(c("marker"), begun).otherwise(F.try_to_date(F.concat_ws(" ", "day", year), "dd MMM yyyy"))).where(c("marker") | (~c("marker") & c("dt").isNotNull()))
    every = every.select("file", "page", "line", "dt", "description", "balance", "amt", "top", "opening", "marker")
    before = F.coalesce(F.lag("balance").over(page), "top", F.lag("balance").over(Window.partitionBy("file").orderBy("page", "line")), "opening")
    every = every.withColumn("step", F.round(c("balance") - before, 2)).withColumn("side", F.when(c("amt").isNotNull(), _side(c("description"))))
    step = lambda sign: F.greatest(sign * c("step"), F.lit(0.0))
    credit = F.when(c("marker"), 0.0).when(c("side") == "CR", F.abs("amt")).when(c("side") == "DR", 0.0).otherwise(F.coalesce(step(1), F.lit(0.0)))
    debit = F.when(c("marker"), 0.0).when(c("side") == "DR", F.abs("amt")).when(c("side") == "CR", 0.0).when(c("step").isNotNull(), step(-1)).otherwise(F.coalesce(F.abs("amt"), F.lit(0.0)))
    every = every.withColumn("credit", F.round(credit, 2)).withColumn("debit", F.round(debit, 2))
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("dt", "page", "line"))).select(*ROWS)

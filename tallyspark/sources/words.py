"""Statement layouts over words with coordinates (P05, P10, P11, P13, P14, P20): ``(file, page, x0, y0, x1, text)`` rows
to transactions.

Words are put into visual lines page by page, columns are found from header words, page width or gaps between positions,
and a word goes to the column whose centre or box it meets. What is carried from line to line of a file is a window or, where
the next value depends on the one made before, a fold over the file's sorted lines (``folded``) that holds no list of them.

Words without a text or a position are left out; an empty table gives no rows; columns other than the named ones are
ignored; repeated words are words printed twice. Days that do not exist are no dates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .bankparties import spaced
from .layouts import ROWS, amount, contains_any

c = F.col

# Fixed values, from here to the next comment: each layout's header words, footers, marks and column positions.
AFFIN_HEADER = ("DATE", "TARIKH", "DEBIT", "CREDIT", "BALANCE", "BAKI")
AFFIN_FORWARD = ("B/F", "BALANCE B/F", "BAKI B/F", "BAKI MULA", "BAKI AWAL", "OPENING", "BALANCE BROUGHT", "BALANCE BROUGHT FORWARD")
AFFIN_MONEY = r"(?i)^\(?\s*(?:RM\s*)?((?:\d{1,3}(?:,\d{3})*|\d+)?\.\d{2})\s*\)?([+-])?\s*[.,;:|]*\s*$"
AFFIN_DATE = r"(\d{1,2})\s*[/-]\s*(\d{1,2})\s*[/-]\s*(\d{2,4})"
AFFIN_TOLERANCE, AFFIN_REACH, AFFIN_HEADER_LINES, AFFIN_DATE_WORDS = 2.8, 90.0, 80, 10
MUAMALAT_COLUMNS = {"date": (25, 75), "desc": (75, 185), "ref": (185, 295), "withdrawal": (295, 395), "deposit": (395, 500), "balance": (500, 605), "details": (605, 760)}
MUAMALAT_TOLERANCE, MUAMALAT_WIDTH = 2.5, 760.0
MUAMALAT_DATE = r"^\d{1,2}/\d{1,2}/(?:\d{2}|\d{4})$"
MUAMALAT_MONEY = r"(-?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{1,2})?|-?\.\d{1,2})"
MUAMALAT_FOOTER = (
    r"(?i)\b(?:EFFECTIVE\s+30\s+SEPTEMBER|PROPRIETORSHIP\s+WILL\s+NO\s+LONGER|I-MUAMALAT\.COM\.MY|SEGALA\s+BILANGAN\s+DAN\s+BAKI|ALL\s+ITEMS\s+AND\s+BALANCES|TANDA\s+['\"]?-['\"]?\s+PADA\s+BAKI"
    r"|THE\s+SIGN\s+['\"]?-['\"]?\s+AGAINST|SILA\s+MAKLUMKAN\s+KEPADA|CHANGE\s+OF\s+ADDRESS|SEBARANG\s+CEK\s+DEPOSIT|ANY\s+CHEQUES\s+DEPOSITED|TOTAL\s+ENDING\s+BALANCE|CURRENT\s+I-MUAMALAT\s+ONLINE"
    r"|ONLINE\s+PORTAL|THIS\s+STATEMENT|PAGE\s+\d+)\b"
)
MUAMALAT_HEADER = r"(?i)\b(?:TARIKH|DATE|PERKARA|DESCRIPTION|BUTIR-BUTIR\s+TAMBAHAN|ADDITIONAL\s+DETAILS|WITHDRAWAL|DEPOSIT|BALANCE)\b"
MUAMALAT_CUTS = (
    "EFFECTIVE 30 SEPTEMBER", "PROPRIETORSHIP WILL NO LONGER", "HTTPS:WWW.I-MUAMALAT.COM.MY", "HTTPS://WWW.I-MUAMALAT.COM.MY", "WWW.I-MUAMALAT.COM.MY", "SEGALA BILANGAN DAN BAKI", "ALL ITEMS AND BALANCES",
    "TANDA \"-\" PADA BAKI", "THE SIGN \"-\" AGAINST", "SILA MAKLUMKAN KEPADA", "CHANGE OF ADDRESS", "SEBARANG CEK DEPOSIT", "ANY CHEQUES DEPOSITED", "TOTAL ENDING BALANCE", "CURRENT I-MUAMALAT ONLINE",
    "ONLINE PORTAL", "THIS STATEMENT", "PAGE ",
)
MUAMALAT_NO_ROWS = ("TOTAL", "ENDING BALANCE")
MAYBANK_TOLERANCE, MAYBANK_NO_DATE_X, MAYBANK_DESCRIPTION_X, MAYBANK_DATE_WIDTH, MAYBANK_CORRECTION = 3.0, 70.0, 85.0, 20.0, 500.0
MAYBANK_MONEY = r"^-?(?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2}[+-]?$"
MAYBANK_CENTS = r"^\.(\d{2})[+-]?$"
MAYBANK_DATE = r"^(\d{2})[/-](\d{2})(?:[/-](\d{2,4}))?$"
MAYBANK_YEAR = r"(?i)STATEMENT\s+DATE\s*:?\s*\d{2}/\d{2}/(\d{2,4})"
MAYBANK_FOOTERS = (
    "ENDING BALANCE", "LEDGER BALANCE", "TOTAL DEBIT", "TOTAL CREDIT", "TOTAL DEBITS", "TOTAL CREDITS", "END OF STATEMENT", "PROFIT OUTSTANDING", "BAKI LEGAR", "BAKI AKHIR", "MUKA/", "PAGE",
    "NOMBOR AKAUN", "NOT PROTECTED BY PIDM", "PLEASE BE REMINDED", "NOTICE:", "NOTIS",
)
MAYBANK_SECTIONS = ("ACCOUNT TRANSACTIONS", "TRANSACTION DESCRIPTION", "BUTIR URUSNIAGA", "ENTRY DATE", "TARIKH MASUK")
MAYBANK_NO_DETAIL = ("BAKI LEGAR", "BAKI AKHIR", "ENDING BALANCE", "LEDGER BALANCE", "NOT PROTECTED BY PIDM", "PLEASE NOTIFY", "PROTECTED BY PIDM", "OVERDRAWN BALANCES")
MAYBANK_IDEOGRAPHS = "[㐀-䶿一-鿿豈-﫿]"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
RAKYAT_TOLERANCE, RAKYAT_GAP = 6.0, 30.0
RAKYAT_HEADER, RAKYAT_SUMMARY = r"(?i)\btarikh\b|\bdate\b", r"(?i)baki.{0,3}permulaan|opening.{0,3}balance"
RAKYAT_DATE, RAKYAT_CODE, RAKYAT_MONEY = r"^\d{2}/\d{2}/\d{4}$", r"^\d{3,6}$", r"^-?\d[\d,]*\.\d{2}$"
RAKYAT_COLUMNS = {"date": (0, 80), "code": (80, 160), "desc": (160, 330), "debit": (330, 425), "credit": (425, 515), "balance": (515, 9999)}
HONG_LEONG_TOLERANCE, HONG_LEONG_LEFT, HONG_LEONG_BALANCE_LEFT, HONG_LEONG_REACH = 3.0, 25.0, 10.0, 80.0
HONG_LEONG_COLUMNS = {"deposit": 320.0, "withdrawal": 410.0, "balance": 520.0}
HONG_LEONG_DATE = r"^\d{2}-\d{2}-\d{4}$"
HONG_LEONG_MONEY = r"^\(?([\d,]+\.\d{2})\)?([+-])?$"
HONG_LEONG_OPENING = r"(?i)Balance from previous statement\s+([\d,]+\.\d{2})"
HONG_LEONG_NO_ROWS = r"(?i)(Statement Period|Balance from previous statement|Date\s*/\s*Tarikh)"
HONG_LEONG_OVERDRAFT = r"(?i)\b(overdraft|od\s+facility|od\s+limit|overdrawn|excess\s+limit|interest\s+on\s+overdraft|excess\s+interest)\b"
HONG_LEONG_TOTALS = r"(?i)Total Withdrawals|Total Deposits|Closing Balance|Important Notices"
HONG_LEONG_NOISE = r"(?i)Protected by PIDM|Dilindungi oleh PIDM|Hong Leong Islamic Bank|hlisb\.com\.my|Menara Hong Leong|CURRENT ACCOUNT"
# End of the fixed values.

CENT, DIGITS = Decimal("0.01"), Context(prec=400)


def visual_lines(words: DataFrame, tolerance: float, anchored: bool = False, **of_page: Column) -> DataFrame:
    """P20: ``(file, page, line, y, words)``, a page's words in lines from top to bottom, and the page's
    greatest values ``of_page``.

    A word belongs to the line before it if it lies at most ``tolerance`` below the mean height of that line's words, or, if
    ``anchored``, below its first word; a line's words are ordered from left to right as ``(x0, y0, x1, text)``.
    """
    number = lambda n: c(n).cast("double")
    tidy = words.select("file", c("page").cast("int").alias("page"), number("y0").alias("y0"), number("x0").alias("x0"), F.coalesce(number("x1"), number("x0")).alias("x1"), F.btrim("text", F.lit(" \t\r\n")).alias("text"), *(v.alias(f"p_{k}") for k, v in of_page.items()))
    word = F.when((c("text") != "") & c("x0").isNotNull() & c("y0").isNotNull(), F.struct("y0", "x0", "x1", "text"))
    if not of_page:
        tidy = tidy.where(word.isNotNull())
    per = tidy.groupBy("file", "page").agg(F.sort_array(F.collect_list(word)).alias("w"), *(F.max(f"p_{k}").alias(k) for k in of_page))
    zero = F.struct(F.lit(0.0).alias("y"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))

    def step(a: Column, w: Column) -> Column:
        new = (a["n"] == 0) | (w["y0"] - a["y"] > tolerance)
        y = F.when(new, w["y0"]).otherwise(a["y"] if anchored else (a["y"] * a["n"] + w["y0"]) / (a["n"] + 1))
        at = a["at"] + 1
        return F.struct(y.alias("y"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"), at.alias("at"), F.when(new, F.concat(a["starts"], F.array(at))).otherwise(a["starts"]).alias("starts"))

    def line(s: Column, k: Column) -> Column:
        """The line that begins at a word's number: the words, in order of height, up to the next line's first."""
        own = F.slice("w", s, F.coalesce(F.get("starts", k + 1), F.size("w") + 1) - s)
        flat = F.transform(own, lambda w: F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["text"].alias("text")))
        return F.struct((k + 1).alias("line"), F.get("w", s - 1)["y0"].alias("y"), F.sort_array(flat).alias("words"))

    lined = per.withColumn("starts", F.aggregate("w", zero, step, lambda a: a["starts"]))
    return lined.select("file", "page", *of_page, F.inline(F.transform("starts", line))).select("file", "page", "line", *of_page, "y", "words")


def folded(rows: DataFrame, order: tuple[str, ...], reads: tuple[str, ...], zero: tuple, made: dict[str, str], step: Callable) -> DataFrame:
    """Every file's rows with what ``step`` makes of each in order; ``step(state, *reads)`` gives the next state and the new values.

    ``zero`` is the state before a file's first row, ``made`` the types of the new columns. A task reads its files' sorted rows in
    batches and keeps the state alone between them, so time grows with a file's length and memory does not.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    names, file = rows.columns, rows.columns.index("file")
    at, kinds = [names.index(n) for n in reads], [to_arrow_type(DataType.fromDDL(t)) for t in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), zero
        for b in batches:
            out = []
            for f, *r in zip(*(b.column(k).to_pylist() for k in (file, *at)), strict=True):
                if f != now:
                    now, state = f, zero
                state, new = step(state, *r)
                out.append(new)
            new = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, *made])

    kept = StructType([*rows.schema.fields, *(StructField(k, DataType.fromDDL(t)) for k, t in made.items())])
    return rows.repartition("file").sortWithinPartitions("file", *order).mapInArrow(run, kept)


def cents(x: float | None) -> float | None:
    """A number to two places, halves away from zero in its shortest decimal form, as ``F.round`` does."""
    if x is None or not math.isfinite(x):
        return x
    return float(Decimal(repr(x)).quantize(CENT, ROUND_HALF_UP, DIGITS)) + 0.0


def first_of(array: Column, f: Callable[[Column], Column]) -> Column:
    """The first value that ``f`` finds for an element; null if it finds none."""
    return F.get(F.filter(F.transform(array, f), lambda x: x.isNotNull()), F.lit(0))


def with_(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def last_(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def joined(words: Column) -> Column:
    return spaced(F.array_join(F.transform(words, lambda w: w["text"]), " "))


def inside(words: Column, low: Column, high: Column, at: Callable[[Column], Column]) -> Column:
    return F.filter(words, lambda w: (at(w) >= low) & (at(w) < high))


def middle(w: Column) -> Column:
    return (w["x0"] + w["x1"]) / 2


def nearest(x: Column, centres: list[Column], reach: float | None = None) -> Column:
    """The number of the centre next to ``x``, the first of equally near ones; null centres are none, nor are those out of reach."""
    far = F.array_min(F.filter(F.array(*(F.struct(F.abs(x - m).alias("d"), F.lit(k).alias("k")) for k, m in enumerate(centres))), lambda s: s["d"].isNotNull()))
    return far["k"] if reach is None else F.when(far["d"] <= reach, far["k"])


def day_of(text: Column, pattern: str, d: int = 1, m: int = 2, y: int = 3) -> Column:
    """The day in a text by the groups of a pattern; years below 100 are of this century."""
    part = lambda k: F.regexp_extract(text, pattern, k)
    year = F.when(F.length(part(y)) == 2, F.concat(F.lit("20"), part(y))).otherwise(F.lpad(part(y), 4, "0"))
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", year, F.lpad(part(m), 2, "0"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd"))


def _by_file(order: str = "line") -> object:
    return Window.partitionBy("file").orderBy("page", order)


def _page(order: str | None = "line") -> object:
    w = Window.partitionBy("file", "page")
    return w.orderBy(order) if order else w


def _whole_page() -> object:
    """All of a page in the order of its lines, which the windows over parts of it share."""
    return _page().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy(*order))).withColumn("marker", F.lit(False))


def affin_money(text: Column) -> Column:
    """A printed amount with zeros that were read as letters put right; brackets or a minus behind it make it negative."""
    def value(t: Column) -> Column:
        number = F.try_to_number(F.regexp_replace(F.regexp_extract(t, AFFIN_MONEY, 1), ",", ""), F.lit("9999999999999999.99")).cast("double")
        below = (F.startswith(t, F.lit("(")) & F.contains(t, F.lit(")"))) | (F.regexp_extract(t, AFFIN_MONEY, 2) == "-")
        return with_(number, lambda n: F.when(below, -n).otherwise(n))

    def read(t: Column) -> Column:
        bare = F.btrim(t, F.lit(".,;:|"))
        return with_(F.when(t.rlike(AFFIN_MONEY), t).when(bare.rlike(AFFIN_MONEY), bare), lambda m: F.when(m.isNotNull(), value(m)))

    return F.when(F.contains(text, F.lit(".")), with_(F.translate(text, "Oo ", "00"), read))


def affin(words: DataFrame) -> DataFrame:
    """A line with a day among its first ten words starts a transaction, which goes on until the next day or a header line.

    A page's first header line that names debit, credit and balance gives their centres; each amount belongs to the nearest
    centre within 90 points, amounts of a column are added up, the last balance counts, and without one the last amount of
    all. A page without such a line has balances only. Rows that bring a balance forward and rows without amounts are none.
    """
    lines = visual_lines(words, AFFIN_TOLERANCE)
    date = lambda t: F.when(F.contains(t, F.lit("/")) | F.contains(t, F.lit("-")), day_of(t, AFFIN_DATE))
    lines = lines.withColumn("u", F.upper(joined(c("words")))).withColumn("day", first_of(F.slice("words", 1, AFFIN_DATE_WORDS), lambda w: date(w["text"])))
    up = lambda w: F.upper(w["text"])
    lines = lines.withColumn("hint", contains_any(c("u"), AFFIN_HEADER))
    centre = lambda test: first_of(c("words"), lambda w: F.when(test(up(w)), middle(w)))
    has = lambda u, *marks: contains_any(u, marks)
    found = {"debit": lambda u: has(u, "DEBIT") | (u == "DR"), "credit": lambda u: has(u, "CREDIT", "CR"), "balance": lambda u: has(u, "BAL", "BAKI")}
    centres = [centre(f).alias(k) for k, f in found.items()]
    whole = F.forall(F.array(*centres), lambda x: x.isNotNull() & (x != 0))
    row = F.row_number().over(_page())
    lines = lines.withColumn("columns", F.when((row <= AFFIN_HEADER_LINES) & c("hint") & whole, F.struct("line", *centres)))
    ends = c("hint") & c("day").isNull()
    upto = lambda test: F.max(F.when(test, c("line"))).over(_page())
    lines = lines.withColumn("columns", F.min("columns").over(_whole_page())).withColumn("tid", F.count("day").over(_page()))
    lines = lines.where("tid > 0").withColumn("over", F.coalesce(upto(ends) > upto(c("day").isNotNull()), F.lit(False))).where("NOT over")
    part = F.struct("line", "day", "u", "words")
    made = lines.groupBy("file", "page", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"), F.first("columns").alias("m"))
    ordered = F.sort_array(F.transform(F.flatten(F.transform("p", lambda x: x["words"])), lambda w: F.struct(w["y0"].alias("y0"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))))
    made = made.select("file", "page", "tid", F.expr("p[0].day").alias("dt"), F.expr("p[0].u").alias("head"), "m", ordered.alias("w"))
    made = made.where(~contains_any(c("head"), AFFIN_FORWARD)).withColumn("w", F.transform("w", lambda w, i: F.struct(middle(w).alias("x"), i.alias("i"), affin_money(w["text"]).alias("v"), w["text"].alias("text"))))
    made = made.withColumn("v", F.sort_array(F.transform(F.filter("w", lambda w: w["v"].isNotNull()), lambda w: F.struct(w["x"].alias("x"), w["i"].alias("i"), w["v"].alias("v"))))).where(F.size("v") > 0)
    made = made.withColumn("v", F.transform("v", lambda v: F.struct(v["v"].alias("v"), nearest(v["x"], [c("m.debit"), c("m.credit"), c("m.balance")], AFFIN_REACH).alias("k"))))
    of = lambda k: F.filter("v", lambda v: v["k"] == k)
    total = lambda k: F.round(F.aggregate(of(k), F.lit(0.0), lambda a, v: a + F.abs(v["v"])), 2)
    balance = F.round(F.coalesce(last_(F.transform(of(2), lambda v: v["v"])), last_(c("v"))["v"]), 2)
    bare = F.transform("w", lambda w: F.struct(F.btrim(w["text"], F.lit("|")).alias("text"), w["text"].alias("whole"), w["v"].alias("v")))
    no_money = lambda w: F.when(w["text"] == w["whole"], w["v"].isNull()).otherwise(affin_money(w["text"]).isNull())
    said = F.filter(bare, lambda w: (w["text"] != "") & no_money(w) & ~date(w["text"]).eqNullSafe(c("dt")))
    text = spaced(F.array_join(F.transform(said, lambda w: w["text"]), " "))
    made = made.select("file", "page", "tid", "dt", text.alias("description"), total(0).alias("debit"), total(1).alias("credit"), balance.alias("balance"))
    return _numbered(made, "dt", "page", "tid").select(*ROWS)


def muamalat(words: DataFrame) -> DataFrame:
    """P10: a line with a day in the date column, or among its first words left of the reference column, starts a transaction.

    The columns are boxes on a page of 760 points, drawn narrower where ``width`` (the page's, if ``words`` has it) is less; a
    word belongs to the box that holds its middle. A footer ends a transaction, header lines are left out of it, and so is a
    first line that holds a header word. Rows without a text, totals and ending balances are none.
    """
    wide = c("width").cast("double") if "width" in words.columns else F.lit(None).cast("double")
    lines = visual_lines(words, MUAMALAT_TOLERANCE, anchored=True, width=wide)
    lines = lines.withColumn("scale", F.when(c("width") > 0, F.least(c("width") / MUAMALAT_WIDTH, F.lit(1.0))).otherwise(1.0)).drop("width")
    box = lambda name, w: inside(w, c("scale") * MUAMALAT_COLUMNS[name][0], c("scale") * MUAMALAT_COLUMNS[name][1], middle)
    tidy = lambda t: F.btrim(F.regexp_replace(t, " ", ""), F.lit(".,"))
    day = lambda t: F.when(tidy(t).rlike(MUAMALAT_DATE), tidy(t))
    left = c("scale") * MUAMALAT_COLUMNS["ref"][0]
    down = F.transform(F.sort_array(F.transform("words", lambda w: F.struct(w["y0"].alias("y0"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text")))), lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text")))
    lines = lines.withColumn("down", down).withColumn("t", joined(c("down")))
    early = first_of(F.slice("words", 1, 4), lambda w: F.when(w["x0"] <= left, day(w["text"])))
    three = F.when(c("words")[0]["x0"] <= left, day(F.array_join(F.transform(F.slice("words", 1, 3), lambda w: F.btrim(w["text"], F.lit(".,"))), "")))
    lines = lines.withColumn("printed", F.coalesce(day(joined(box("date", c("down")))), early, three)).withColumn("tid", F.count("printed").over(_page()))
    first = c("printed").isNotNull()
    lines = lines.withColumn("over", F.max(c("t").rlike(MUAMALAT_FOOTER) & ~first).over(Window.partitionBy("file", "page", "tid").orderBy("line")))
    lines = lines.where("tid > 0 AND NOT over").withColumn("header", c("t").rlike(MUAMALAT_HEADER) & ~c("t").rlike(MUAMALAT_DATE))
    part = F.struct("line", F.when(~c("header"), c("down")).alias("w"))
    made = lines.groupBy("file", "page", "tid", "scale").agg(F.max("printed").alias("printed"), F.sort_array(F.collect_list(part)).alias("p"))
    undated = F.filter(F.flatten(F.filter(F.transform("p", lambda x: x["w"]), lambda w: w.isNotNull())), lambda w: day(w["text"]).isNull())
    made = made.withColumn("w", undated)
    said = lambda name: joined(box(name, c("w")))
    text = spaced(F.concat_ws(" ", *(F.nullif(said(n), F.lit("")) for n in ("desc", "ref", "details"))))
    at = F.least(*(F.nullif(F.instr(F.upper(c("text")), m), F.lit(0)) for m in MUAMALAT_CUTS))
    made = made.where(~F.upper(said("desc")).isin(*MUAMALAT_NO_ROWS)).withColumn("text", text)
    made = made.withColumn("text", F.when(at.isNull(), c("text")).otherwise(F.substring("text", F.lit(1), at - 1)))
    made = made.withColumn("description", spaced(F.regexp_replace("text", r"\s*[-=/,:;|]+\s*$", "")))

    def value(name: str) -> Column:
        number = F.regexp_replace(F.regexp_extract(F.regexp_replace(said(name), " ", ""), MUAMALAT_MONEY, 1), ",", "")
        return F.coalesce(F.regexp_replace(number, r"^(-?)\.", "$10.").try_cast("double"), F.lit(0.0))

    made = made.withColumn("dt", day_of(c("printed"), r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$")).where("dt IS NOT NULL AND description <> ''")
    made = made.select("file", "page", "tid", "dt", "description", value("withdrawal").alias("debit"), value("deposit").alias("credit"), value("balance").alias("balance"))
    return _numbered(made, "page", "tid").select(*ROWS)


def maybank(words: DataFrame, default_year: int | None = None) -> DataFrame:
    """A line with an amount and a balance is a transaction, dated by its own first word, by a line before it that holds
    little but a day, or, if it begins far to the right, by the last day printed.

    Its amount is the last one with a sign before the balance, else the one before it; the sign behind it tells the side, else
    the step of the balance. One amount alone counts only behind a known balance: with its sign it gives the balance, whose
    cents a lone ``.dd`` behind it replaces. An amount within 500 of the balance's step gives way to the step. Lines without
    day and amount inside a transaction section go on with the transaction before them, by their words between its
    description's left and its amount's left. Days without a year take the statement date's of the first two pages, else
    ``default_year``, else they are no days. Rows equal in all columns of a page are one.
    """
    lines = visual_lines(words, MAYBANK_TOLERANCE).withColumn("t", joined(c("words"))).withColumn("u", F.upper("t"))
    stamp = F.when((c("page") <= 2) & c("t").rlike(MAYBANK_YEAR), F.struct("page", "line", F.regexp_extract("t", MAYBANK_YEAR, 1).alias("y")))
    lines = lines.withColumn("stamp", F.min(stamp).over(Window.partitionBy("file"))["y"])
    year = F.coalesce(F.when(F.length("stamp") == 2, F.concat(F.lit("20"), c("stamp"))).otherwise(c("stamp")), F.lit(default_year).cast("string"))
    lines = lines.withColumn("year", year).withColumn("section", contains_any(c("u"), MAYBANK_SECTIONS)).withColumn("footer", ~c("section") & contains_any(c("u"), MAYBANK_FOOTERS))
    lines = lines.withColumn("body", ~c("section") & ~c("footer"))
    word = lambda k: F.get("words", F.lit(k))
    one = F.upper(word(0)["text"])
    y = F.regexp_extract(one, MAYBANK_DATE, 3)
    short = F.when(one.rlike(MAYBANK_DATE), day_of(F.concat_ws("/", F.regexp_extract(one, MAYBANK_DATE, 1), F.regexp_extract(one, MAYBANK_DATE, 2), F.coalesce(F.nullif(y, F.lit("")), "year")), r"^(\d{2})/(\d{2})/(\d{2,4})$"))
    split = F.when(word(0)["text"].rlike(r"^\d+$") & F.upper(word(1)["text"]).isin(*MONTHS) & word(2)["text"].rlike(r"^\d{4}$"), F.try_to_date(F.concat_ws(" ", F.lpad(word(0)["text"], 2, "0"), F.initcap(word(1)["text"]), word(2)["text"]), "dd MMM yyyy"))
    lines = lines.withColumn("date", F.when(c("body"), F.coalesce(split, short))).withColumn("skip", F.when(c("date").isNull(), 0).when(split.isNotNull(), 3).otherwise(1))
    lines = lines.withColumn("date_x", F.when(c("skip") == 3, word(2)["x0"]).when(c("skip") == 1, word(0)["x0"]) + MAYBANK_DATE_WIDTH)
    lines = lines.withColumn("money", F.when(c("body"), F.filter("words", lambda w: w["text"].rlike(MAYBANK_MONEY)))).withColumn("n", F.coalesce(F.size("money"), F.lit(0)))
    lines = lines.withColumn("carried", F.last("date", ignorenulls=True).over(_by_file())).withColumn("money_x", F.get("money", F.lit(0))["x0"])
    only = c("date").isNotNull() & (c("n") == 0) & (F.size("words") <= c("skip") + 3)
    lines = lines.withColumn("kind", F.when(c("footer"), "footer").when(only, "day").when(c("n") > 0, "row").when(c("body") & c("date").isNull(), "detail"))
    value = lambda w: amount(F.regexp_replace(w["text"], r"[+-]$", ""))
    sign = lambda w: F.nullif(F.regexp_extract(w["text"], r"([+-])$", 1), F.lit(""))
    before = F.slice("money", F.lit(1), F.greatest(c("n") - 1, F.lit(1)))
    signed = F.filter(before, lambda w: sign(w).isNotNull())
    chosen = F.coalesce(last_(signed), last_(before))
    lone = last_(F.filter("words", lambda w: (w["x0"] > c("money_x")) & w["text"].rlike(MAYBANK_CENTS)))
    lines = lines.withColumn("chosen", F.when(c("n") > 0, chosen)).withColumn("printed", F.when(c("n") > 1, value(last_(c("money")))))
    lines = lines.withColumn("amt", value(c("chosen"))).withColumn("sign", sign(c("chosen"))).withColumn("cents", F.regexp_extract(lone["text"], MAYBANK_CENTS, 1).try_cast("double"))
    lines = lines.withColumn("late", F.when(word(0)["x0"] > MAYBANK_NO_DATE_X, c("carried")))
    # the section is on from its header until a footer or the page's end
    switch = F.when(c("section"), True).when(c("footer"), False)
    lines = lines.withColumn("on", F.coalesce(F.last(switch, ignorenulls=True).over(_page()), F.lit(False)))

    def step(s: tuple, kind: str, date, date_x, late, amt, sign, cent, printed, money_x) -> tuple[tuple, tuple]:
        pending, pending_x, known, tid, cut, own = s
        dt = next((d for d in (date, pending, late) if d is not None), None)
        guess = None
        if sign is not None and known is not None and amt is not None:
            guess = cents(known + amt if sign == "+" else known - amt)
            if cent is not None:
                guess = cents((math.ceil(guess) if guess < 0 else math.floor(guess)) + cent / 100)
        balance = (guess if printed is None else printed) if kind == "row" and dt is not None else None
        emits = balance is not None
        move = cents(balance - known) if emits and known is not None else None
        credit = amt if sign == "+" else move if sign is None and move is not None and move > 0 else 0.0
        debit = (amt if sign == "-" else 0.0) if sign is not None else amt if move is None else -move if move < 0 else None
        parsed = credit if credit is not None and credit > 0 else debit or 0.0
        if move and parsed > 0 and abs(abs(move) - parsed) <= MAYBANK_CORRECTION:
            credit, debit = max(move, 0.0), max(-move, 0.0)
        x = date_x if date_x is not None else pending_x if date is None and pending is not None else None
        x = MAYBANK_DESCRIPTION_X if x is None else x
        if kind == "day":
            pending, pending_x = date, date_x
        elif kind == "footer" or (emits and date is None):
            pending = None
        tid, cut = tid + emits, cut + (emits or kind == "day")
        own = (cut, x, money_x) if emits else own
        now = pending, pending_x, balance if emits else known, tid, cut, own
        return now, (dt if emits else None, balance, credit, debit or 0.0, tid, own is not None and own[0] == cut, own and own[1], own and own[2])

    # of a line's words those that may be said, of its text whether it may be a detail
    words = F.filter("words", lambda w, i: ~w["text"].rlike(MAYBANK_MONEY) & (i >= c("skip")))
    words = F.transform(words, lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text")))
    able = (c("kind") == "detail") & c("on") & ~c("t").rlike(MAYBANK_IDEOGRAPHS) & ~contains_any(c("u"), MAYBANK_NO_DETAIL)
    kept = lines.where("kind IS NOT NULL").withColumn("able", able)
    reads = ("kind", "date", "date_x", "late", "amt", "sign", "cents", "printed", "money_x")
    kept = kept.select("file", "page", "line", *reads, "able", F.when(c("able") | (c("kind") == "row"), words).alias("words"))
    made = {"dt": "date", "balance": "double", "credit": "double", "debit": "double", "tid": "int", "near": "boolean", "left_x": "double", "right_x": "double"}
    rows = folded(kept, ("page", "line"), reads, (None, None, None, 0, 0, None), made, step)
    between = F.filter("words", lambda w: (w["x0"] >= c("left_x")) & (w["x0"] < c("right_x")))
    rows = rows.where((c("tid") > 0) & (c("dt").isNotNull() | (c("able") & c("near")))).withColumn("said", joined(between))
    part = F.struct("page", "line", "dt", "said", "debit", "credit", "balance")
    made = rows.groupBy("file", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"))
    money = lambda n: F.round(F.expr(f"p[0].{n}"), 2).alias(n)
    made = made.select("file", "tid", F.expr("p[0].page").alias("page"), F.expr("p[0].dt").alias("dt"), spaced(F.array_join(F.transform("p", lambda x: x["said"]), " ")).alias("description"), money("debit"), money("credit"), money("balance"))
    same = ["file", "page", "dt", "description", "debit", "credit", "balance"]
    made = made.groupBy(*same).agg(F.min("tid").alias("tid"))
    return _numbered(made, "tid").select(*ROWS)


def rakyat(words: DataFrame) -> DataFrame:
    """Columns calibrated on each page by where its amounts, days and codes stand.

    The amounts between a page's header and its summary fall into groups by gaps of more than 30 points; the last three
    groups begin debit, credit and balance, two stand for debit and balance. A line with a balance starts a transaction; lines
    below it fill in its day, code and amounts and go on with its text. The summary's first line of four amounts gives opening,
    debits, credits and closing, later pages' over earlier ones'; without an opening it is closing less credits plus debits.
    Rows are ordered by day and page, and a row without amounts takes the step of the balance from the row before or the
    opening. Besides the common columns: ``code`` and ``opening``, the file's opening balance.
    """
    lines = visual_lines(words, RAKYAT_TOLERANCE, anchored=True).withColumn("t", joined(c("words")))
    page = _whole_page()
    lines = lines.withColumn("header", F.min(F.when(c("t").rlike(RAKYAT_HEADER), c("y"))).over(page)).where("header IS NOT NULL")
    lines = lines.withColumn("summary", F.min(F.when((c("y") >= c("header")) & c("t").rlike(RAKYAT_SUMMARY), c("y"))).over(page))
    lines = lines.withColumn("body", F.expr("coalesce(page IS NOT NULL AND y > header + 5 AND (summary IS NULL OR y < summary - 2), false)"))
    is_money = lambda t: t.rlike(RAKYAT_MONEY)
    sums = F.transform(F.filter("words", lambda w: is_money(w["text"])), lambda w: amount(w["text"]))
    lines = lines.withColumn("four", F.when(c("y") >= c("summary"), with_(sums, lambda v: F.when(F.size(v) >= 4, v))))

    # what a line's words are; a described one stands 20 points right of a day or a code that is read before it
    kind = lambda t: F.when(is_money(t), "money").when(t.rlike(RAKYAT_DATE), "date").when(t.rlike(RAKYAT_CODE), "code").when(F.length(t) > 1, "text")
    lines = lines.withColumn("kinds", F.when(c("body"), F.transform("words", lambda w: F.struct(kind(w["text"]).alias("kind"), w["x0"].alias("x0")))))
    xs = lambda k: F.transform(F.filter("kinds", lambda w: w["kind"] == k), lambda w: w["x0"])
    lines = lines.withColumns({"date_x": F.array_min(xs("date")), "code_x": F.array_min(xs("code")), "money_x": xs("money"), "text_x": xs("text")})
    left = F.least(*(F.min(k).over(_page()) for k in ("date_x", "code_x"))) + 20
    lines = lines.withColumn("left", left).withColumn("desc_x", F.array_min(F.filter("text_x", lambda x: x > c("left"))))
    money = F.sort_array(F.flatten(F.collect_list("money_x").over(page)))
    four = F.min(F.when(c("four").isNotNull(), F.struct("line", "four"))).over(page)["four"]
    at = lines.select("file", "page", "line", "body", "words", four.alias("four"), *(F.min(f"{k}_x").over(page).alias(k) for k in ("date", "code", "desc")), money.alias("m"))
    # a page's first line, which is never in its body, goes on as the bearer of its four amounts
    at = at.where("body OR (line = 1 AND four IS NOT NULL)").withColumn("m", F.filter("m", lambda x, i: (i == 0) | (x - F.get("m", i - 1) > RAKYAT_GAP)))
    n = F.size("m")
    debit = F.when(n >= 3, F.get("m", n - 3)).when(n == 2, F.get("m", F.lit(0))).otherwise(330.0)
    balance = F.when(n >= 2, F.get("m", n - 1)).otherwise(510.0)
    credit = F.when(n >= 3, F.get("m", n - 2)).when(n == 2, debit + (balance - debit) * 0.55).otherwise(330.0)
    at = at.select("file", "page", "line", "body", "words", F.when(~c("body"), c("four")).alias("four"), F.coalesce("date", F.lit(0.0)).alias("date"), "code", "desc", debit.alias("debit"), credit.alias("credit"), balance.alias("balance"), n.alias("n"))
    at = at.withColumn("code", F.coalesce("code", "desc", c("date") + 70)).withColumn("desc", F.coalesce("desc", c("code") + 40))
    edges = {"date": (c("date") - 8, c("code") - 2), "code": (c("code") - 2, c("desc") - 2), "desc": (c("desc") - 2, c("debit") - 5), "debit": (c("debit") - 5, c("credit") - 5), "credit": (c("credit") - 5, c("balance") - 5), "balance": (c("balance") - 5, F.lit(9999.0))}
    boxes = F.struct(*(F.struct(F.when(c("n") > 0, lo).otherwise(float(RAKYAT_COLUMNS[k][0])).alias("lo"), F.when(c("n") > 0, hi).otherwise(float(RAKYAT_COLUMNS[k][1])).alias("hi")).alias(k) for k, (lo, hi) in edges.items()))
    body = at.select("file", "page", "line", "body", "words", "four", boxes.alias("box"))
    said = lambda k: joined(inside(c("words"), c(f"box.{k}.lo"), c(f"box.{k}.hi"), lambda x: x["x0"]))
    body = body.select("file", "page", "line", "body", "four", *(F.when(c("body"), said(k)).alias(k) for k in RAKYAT_COLUMNS))
    value = lambda k: F.when(is_money(c(k)), amount(c(k)))
    word = lambda k: F.when(~is_money(c(k)), F.nullif(c(k), F.lit("")))
    body = body.select("file", "page", "line", "body", "four", F.when(c("date").rlike(RAKYAT_DATE), day_of(c("date"), r"^(\d{2})/(\d{2})/(\d{4})$")).alias("day"), word("code").alias("code"), word("desc").alias("text"), value("debit").alias("debit"), value("credit").alias("credit"), value("balance").alias("balance"))
    body = body.withColumn("tid", F.count("balance").over(_page())).where("tid > 0 OR NOT body")
    part = F.struct("line", "day", "code", "text", "debit", "credit", "balance")
    made = body.groupBy("file", "page", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"), F.first("four").alias("four"))
    some = lambda k: first_of(c("p"), lambda x: x[k])
    filled = lambda k: F.coalesce(first_of(c("p"), lambda x: F.nullif(x[k], F.lit(0.0))), F.lit(0.0))
    made = made.select("file", "page", "tid", some("day").alias("dt"), F.coalesce(some("code"), F.lit("")).alias("code"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("description"), filled("debit").alias("debit"), filled("credit").alias("credit"), F.expr("p[0].balance").alias("balance"), "four").where("dt IS NOT NULL OR tid = 0")
    # bearers have no day and so come first in their file, without a balance or a number
    rows = Window.partitionBy("file").orderBy("dt", "page", "tid")
    upto, whole = (rows.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    made = made.select("*", F.count(F.when(c("tid") > 0, 1)).over(upto).cast("int").alias("seq"), F.lag("balance").over(rows).alias("before"), F.max(F.when(c("four").isNotNull(), F.struct("page", "four"))).over(whole)["four"].alias("v"))
    back = F.when(F.size("v") > 3, F.round(last_(c("v")) - c("v")[2] + c("v")[1], 2))
    made = made.where("tid > 0").withColumn("opening", F.coalesce(c("v")[0], back)).withColumn("marker", F.lit(False))
    move = F.round(c("balance") - F.coalesce("before", "opening"), 2)
    made = made.withColumn("move", F.when((c("debit") == 0) & (c("credit") == 0), move))
    made = made.withColumn("credit", F.greatest("credit", F.coalesce("move", F.lit(0.0)))).withColumn("debit", F.greatest("debit", F.coalesce(-c("move"), F.lit(0.0))))
    return made.select(*ROWS, "code", "opening")


def hong_leong(words: DataFrame) -> DataFrame:
    """A running balance that every printed balance anchors anew, with a guard against overdrafts that are none.

    A dated line starts a transaction, which goes on until the next day or total. A page's header line gives the columns; an
    amount is a credit or a debit by the nearest of deposit, withdrawal and balance, and the rightmost amount from the balance
    column on is the printed balance. Between printed balances the balance is computed; where it would fall below zero in a
    file without a word of overdrafts and without a negative balance so far, the last printed one stands. A file without a
    balance from the previous statement on its first page gives no rows.
    """
    lines = visual_lines(words, HONG_LEONG_TOLERANCE, anchored=True).withColumn("t", joined(c("words")))
    file = Window.partitionBy("file")
    opening = F.when((c("page") == F.min("page").over(file)) & c("t").rlike(HONG_LEONG_OPENING), F.struct("line", amount(F.regexp_extract("t", HONG_LEONG_OPENING, 1)).alias("v")))
    lines = lines.withColumn("found", opening).withColumn("opening", F.min("found").over(file)["v"]).withColumn("od", F.max(c("t").rlike(HONG_LEONG_OVERDRAFT)).over(file)).where("opening IS NOT NULL")
    low = F.lower("t")
    named = F.contains(low, F.lit("deposit")) & F.contains(low, F.lit("withdrawal")) & F.contains(low, F.lit("balance"))

    def column(name: str) -> Column:
        hits = F.filter("words", lambda w: F.lower(w["text"]) == name)
        return F.coalesce(last_(hits)["x0"], F.lit(HONG_LEONG_COLUMNS[name])).alias(name)

    head = F.min(F.when(named, F.struct("line", *(column(n) for n in HONG_LEONG_COLUMNS)))).over(_page(None))
    lines = lines.withColumn("m", head)
    x = {n: F.coalesce(c(f"m.{n}"), F.lit(v)) for n, v in HONG_LEONG_COLUMNS.items()}
    date = first_of(c("words"), lambda w: F.when(w["text"].rlike(HONG_LEONG_DATE), day_of(w["text"], r"^(\d{2})-(\d{2})-(\d{4})$")))
    lines = lines.withColumn("day", date).withColumn("total", c("t").rlike(HONG_LEONG_TOTALS)).withColumn("starts", c("day").isNotNull() & ~c("total"))
    lines = lines.withColumn("tid", F.count_if("starts").over(_page())).withColumn("gid", F.count_if(c("day").isNotNull() | c("total")).over(_page()))
    lines = lines.withColumn("open", c("gid") == F.last(F.when(c("starts"), c("gid")), ignorenulls=True).over(_page())).where("open")
    value = lambda w: amount(F.regexp_extract(w["text"], HONG_LEONG_MONEY, 1)) * F.when((F.startswith(w["text"], F.lit("(")) & F.contains(w["text"], F.lit(")"))) | F.endswith(w["text"], F.lit("-")), -1).otherwise(1)
    money = F.transform(F.filter("words", lambda w: w["text"].rlike(HONG_LEONG_MONEY) & (w["x0"] >= x["deposit"] - HONG_LEONG_LEFT)), lambda w: F.struct(w["x0"].alias("x"), value(w).alias("v"), nearest(w["x0"], list(x.values())).alias("k"), (w["x0"] - x["balance"]).alias("off")))
    said = F.transform(F.filter("words", lambda w: ~w["text"].rlike(HONG_LEONG_DATE) & ~w["text"].rlike(HONG_LEONG_NOISE)), lambda w: w["text"])
    part = F.struct("line", "day", F.array_join(said, " ").alias("text"), money.alias("money"))
    made = lines.groupBy("file", "page", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"), F.first("opening").alias("opening"), F.first("od").alias("od"))
    made = made.withColumn("money", F.flatten(F.transform("p", lambda r: r["money"]))).withColumn("description", spaced(F.array_join(F.transform("p", lambda r: r["text"]), " "))).withColumn("dt", F.expr("p[0].day"))
    total = lambda k: F.round(F.aggregate(F.filter("money", lambda m: m["k"] == k), F.lit(0.0), lambda a, m: a + F.abs(m["v"])), 2)
    right = F.array_max(F.transform(F.filter("money", lambda m: m["off"] >= -HONG_LEONG_BALANCE_LEFT), lambda m: F.struct(m["x"].alias("x"), m["v"].alias("v"))))["v"]
    near = F.array_min(F.transform(F.filter("money", lambda m: (F.abs(m["off"]) <= HONG_LEONG_REACH) & (m["k"] == 2)), lambda m: F.struct(F.abs(m["off"]).alias("off"), (-m["x"]).alias("x"), m["v"].alias("v"))))["v"]
    made = made.withColumn("credit", total(0)).withColumn("debit", total(1)).withColumn("printed", F.round(F.coalesce(right, near), 2))
    nothing = (c("credit") == 0) & (c("debit") == 0)
    made = made.withColumn("silent", nothing & c("description").rlike(HONG_LEONG_NO_ROWS)).where(~(nothing & c("printed").isNull()))

    def step(s: tuple, credit: float, debit: float, printed: float | None, opening: float, overdraft: bool) -> tuple[tuple, tuple]:
        balance, anchor, od = s if s else (opening, opening, overdraft)
        od = od or (printed is not None and printed < 0)
        if printed is not None:
            return (printed, printed, od), (printed,)
        balance = cents(balance + credit - debit)
        balance = anchor if not od and balance < 0 else balance
        return (balance, anchor, od), (balance,)

    kept = made.select("file", "page", "tid", "dt", "description", "debit", "credit", "printed", "silent", "opening", "od")
    rows = folded(kept, ("page", "tid"), ("credit", "debit", "printed", "opening", "od"), (), {"balance": "double"}, step).where("NOT silent")
    return _numbered(rows.withColumn("balance", F.round("balance", 2)), "page", "tid").select(*ROWS)

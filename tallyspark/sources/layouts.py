"""Statement layouts over text lines (P07, P15, P17, W13): ``(file, page, line, text)`` rows to transactions.

What a reader of pages would carry from line to line - the open transaction, the day, the balance - is a window over the
lines of one file, which a statement's length bounds. Every layout returns ``ROWS``; lines that fit nothing give no row.
Null texts are empty lines; an empty table gives no rows; columns other than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bankparties import bound, off, spaced

ROWS = ("file", "seq", "page", "dt", "description", "debit", "credit", "balance", "marker")

# Each layout's lines that start, end or are no part of a transaction, and words that tell a side.
MONEY = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}"
ALLIANCE_HEADERS = ("STATEMENT OF ACCOUNT", "PENYATA AKAUN", "PAGE ", "HALAMAN ", "CURRENT A/C", "ACCOUNT NO", "NO. AKAUN", "CURRENCY", "MATAWANG", "PROTECTED BY PIDM", "DILINDUNGI", "CIF NO")
ALLIANCE_ENDS = ("THE ITEMS AND BALANCES SHOWN ABOVE", "SEGALA BUTIRAN DAN BAKI AKAUN PENYATA DI ATAS", "ALLIANCE BANK MALAYSIA BERHAD")
PBB_ANCHOR = r"(\d{1,3}(?:,\d{3})*\.\d{2})\s+(\d{1,3}(?:,\d{3})*\.\d{2})$"
PBB_BALANCE = r"(?i)\bBalance\s+(?:B/F|C/F|From Last Statement|In This Statement)\b|\bClosing Balance\b"
PBB_HEADER = (
    r"(?i)^(?:TARIKH|DATE\b|URUS NIAGA|TRANSACTION\b|DEBIT\b|KREDIT\b|CREDIT\b|BAKI(?:\s+BALANCE)?\s*$|BALANCE\s*$|Muka Surat|Page \d|Penyata ini|This is a computer|PUBLIC (?:BANK|ISLAMIC) BERHAD"
    r"|Baki Harian|Daily And Closing|Thank You For Banking|Terima Kasih|Your banking questions|Kemusykilan|Anda boleh melihat|You may view|Dimaklumkan bahawa|Please be informed|sila layari laman"
    r"|PERHATIAN|ATTENTION|TEL:|Dilindungi oleh PIDM|Protected by PIDM|Nombor Akaun|Account Number|Tarikh Penyata|Statement Date|Jenis Akaun|Account Type|RINGKASAN|SUMMARY|TEGASAN|HIGHLIGHTS"
    r"|Baki Penutup|Closing Balance|Jumlah (?:Debit|Kredit)|Total (?:Debits|Credits)|Bil\. (?:Debit|Kredit)|No\. of (?:Debits|Credits))"
)
PBB_YEAR = (r"(?i)(?:Statement Date|Tarikh Penyata)\s*[:/\s]+\d{1,2}\s+[A-Za-z]{3,}\s+(\d{4})", r"(?i)(?:Statement Date|Tarikh Penyata)\s*[:/\s]+\d{1,2}/\d{1,2}/(\d{2,4})")
OCBC_START = r"(?i)^(\d{2})\s+(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+(\d{4})\s+(.*)$"
OCBC_OPENING = r"(?i)\bBalance\s+B/F\b\s+(-?[\d,]+\.\d{2})"
OCBC_CREDIT = (" CR ", "CR /IB", "CR INWARD", "CREDIT")
OCBC_DEBIT = (" DR ", "DR /IB", "DEBIT", "DUITNOW SC", "DEBIT AS ADVISED")
OCBC_ARTIFACTS = (
    "START SUBMITTING YOUR AUDIT CONFIRMATION REPORT", "AUDIT CONFIRMATION REPORT REQUEST", "REQUESTS, PLEASE VISIT OUR WEBSITE", "TRANSFER FUNDS OVERSEAS QUICKLY AND EASILY", "BUSINESS MOBILE APP.ENJOY",
    "BUSINESS MOBILE APP. ENJOY", "OCBC FLASH", "THROUGH OCBC VELOCITY", "OUR SMES, FOR MORE INFORMATION", "BUILD YOUR BUSINESS STARTING WITH THE OCBC EBIZ ACCOUNT", "THE SHARIAH-COMPL", "ECONFIRM PORTAL",
    "HTTPS://WWW.OCBC.COM.MY/BUSINESS-BANKING/HELP-AND-SUPPORT#FORMS", "HTTPS://WWW.OCBC.COM.MY/EBIZ-I", "HTTPS://ECONFIRM.MY", "SILA HANTAR PERMINTAAN", "UNTUK BORANG DAN SOALAN LAZIM", "PROTECTED BY PIDM",
    "YOUR BANKING QUESTIONS ANSWERED", "A MEMBER OF OCBC GROUP", "IF THE PROPERTY OR ASSET", "LOCAL CHEQUES", "CEK-CEK TEMPATAN", "WITH EFFECT FROM", "BASE LENDING RATE", "INSURANCE KADAR PINJAMAN",
)
OCBC_ENDS = (
    "TRANSACTION", "SUMMARY", "NO. OF WITHDRAWALS", "NO. OF DEPOSITS", "TOTAL WITHDRAWALS", "TOTAL DEPOSITS", "HOLD AMOUNT", "LATE LOCAL CHEQUE", "PAGE ", "STATEMENT OF CURRENT ACCOUNT", "PENYATA AKAUN SEMASA",
    "TARIKH TRANSAKSI", "HURAIAN TRANSAKSI", "HTTP://WWW.BANKINGINFO.COM.MY", "HTTPS://WWW.BANKINGINFO.COM.MY", "HTTP://WWW.OCBC.COM.MY", "HTTPS://WWW.OCBC.COM.MY", "JOINT MANAGEMENT BODY",
    "CERTIFICATE OF INSURANCE", "THE ENTRIES AND BALANCE", "PLEASE NOTIFY US", "BUTIR-BUTIR TRANSAKSI", "SILA MAKLUMKAN", "BERKUATKUASA DARI",
)


def text_lines(files: DataFrame) -> DataFrame:
    """Lines of text files ``(path, content)``; a form feed ends a page."""
    pages = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page", "t"))
    return pages.select("file", F.col("page") + 1, F.posexplode(F.split("t", r"\r?\n")).alias("line", "text")).toDF("file", "page", "line", "text")


def contains_any(c: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(c, F.lit(m))
    return out


def amount(c: Column) -> Column:
    return F.try_to_number(F.regexp_replace(c, ",", ""), F.lit("S9999999999999999.99")).cast("double")


def _lines(lines: DataFrame) -> tuple[DataFrame, object]:
    tidy = lines.select("file", F.col("page").cast("int").alias("page"), F.col("line").cast("int").alias("line"), spaced(F.col("text")).alias("t"))
    return tidy.withColumn("u", F.upper("t")), Window.partitionBy("file").orderBy("page", "line")


def _stepped(rows: DataFrame, before: Column) -> DataFrame:
    return rows.withColumn("step", F.round(F.col("balance") - before, 2))


def _out(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("tid"))).select(*ROWS)


def alliance(lines: DataFrame) -> DataFrame:
    """Six digits start a transaction, whose amount and balance stand on its first line with money; the step of the
    balance tells the side once a beginning balance was printed, before that every amount is a debit.

    A day that does not exist ends the open transaction and starts none.
    """
    rows, w = _lines(lines)
    start = r"^(\d{2})(\d{2})(\d{2})\s+(.+)$"
    noise = (F.col("t") == "") | contains_any(F.col("u"), ALLIANCE_HEADERS) | F.col("u").startswith("DATE TRANSACTION DETAILS") | F.col("u").startswith("TARIKH KETERANGAN")
    noise = noise | (F.contains("u", F.lit("TRANSACTION DETAILS")) & F.contains("u", F.lit("CHEQUE")) & F.contains("u", F.lit("DEBIT")) & F.contains("u", F.lit("CREDIT")) & F.contains("u", F.lit("BALANCE")))
    rows = rows.where(~noise).withColumn("ends", contains_any(F.col("u"), ALLIANCE_ENDS)).withColumn("starts", ~F.col("ends") & F.col("t").rlike(start))
    rows = rows.withColumn("tid", F.count_if(F.col("starts") | F.col("ends")).over(w))
    day = F.try_to_date(F.concat(F.lit("20"), F.regexp_extract("t", start, 3), F.regexp_extract("t", start, 2), F.regexp_extract("t", start, 1)), "yyyyMMdd")
    head = off(F.regexp_extract("t", start, 4), r"\s+\b(CR|DR)\b\s*$", r"\s+-?\d[\d,]*\.\d{2}\s+-?\d[\d,]*\.\d{2}\s*$", r"\s+-?\d[\d,]*\.\d{2}\s*$")
    header = F.contains("u", F.lit("DATE")) & F.contains("u", F.lit("TRANSACTION")) & F.contains("u", F.lit("DETAILS"))
    part = F.struct("page", "line", "starts", F.when(F.col("starts"), day).alias("day"), F.when(F.col("starts"), head).when(~header, F.col("t")).alias("text"), F.regexp_extract_all("t", F.lit(f"({MONEY})"), F.lit(1)).alias("money"))
    made = rows.where(~F.col("ends")).groupBy("file", "tid").agg(F.sort_array(F.collect_list(part)).alias("p")).where("p[0].starts AND p[0].day IS NOT NULL")
    money = F.get(F.filter(F.transform("p", lambda x: F.when(x["starts"] | x["text"].isNotNull(), x["money"])), lambda m: F.size(m) > 0), F.lit(0))
    made = made.select("file", "tid", F.expr("p[0].page").alias("page"), F.expr("p[0].day").alias("dt"), spaced(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("description"), money.alias("m"))
    made = made.withColumn("balance", amount(F.element_at("m", -1))).withColumn("amount", F.when(F.size("m") > 1, amount(F.element_at("m", -2))))
    u = F.upper("description")
    kind = F.when(F.col("balance").isNotNull(), F.when(F.contains(u, F.lit("BEGINNING BALANCE")), "BEGINNING BALANCE").when(F.contains(u, F.lit("ENDING BALANCE")), "ENDING BALANCE"))
    order = Window.partitionBy("file").orderBy("tid")
    made = made.withColumn("kind", kind).withColumn("marker", F.col("kind").isNotNull()).withColumn("known", F.when(F.max("marker").over(order), F.col("balance")))
    made = _stepped(made, F.last("known", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    debit = F.when(F.col("marker"), 0.0).when(F.col("step").isNotNull(), F.greatest(-F.col("step"), F.lit(0.0))).otherwise(F.coalesce("amount", F.lit(0.0)))
    credit = F.when(F.col("marker") | F.col("step").isNull(), 0.0).otherwise(F.greatest("step", F.lit(0.0)))
    return _out(made.withColumn("description", F.coalesce("kind", "description")).withColumn("debit", debit).withColumn("credit", credit))


def public_bank(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """A line that ends in amount and balance is an anchor; other lines go on with the anchor before them.

    A page's lines before its first anchor belong to the page before only if every page since the anchor was carried
    forward and stand behind this page's balance brought forward. Days are a page's last printed ones, the year is the
    statement date's on the first three pages, else ``default_year``; without a year the day is null. The first row's
    side is told by its text, all others by the step of the balance.
    """
    rows, w = _lines(lines)
    rows = rows.withColumn("mark", F.col("t").rlike(PBB_BALANCE)).withColumn("header", ~F.col("mark") & F.col("t").rlike(PBB_HEADER))
    rows = rows.withColumn("anchor", ~F.col("mark") & ~F.col("header") & F.col("t").rlike(PBB_ANCHOR))
    page = Window.partitionBy("file", "page").orderBy("line")
    rows = rows.withColumn("tid", F.count_if("anchor").over(w)).withColumn("day", F.last(F.nullif(F.regexp_extract("t", r"^(\d{2}/\d{2})\s+", 1), F.lit("")), ignorenulls=True).over(page))
    rows = rows.withColumn("here", F.max("anchor").over(page)).withColumn("brought", F.max(F.col("mark") & F.col("t").rlike(r"(?i)\bBalance\s+B/F\b")).over(page))
    # pages that are not carried forward cut: a line reaches back to an anchor only if none lies between them
    last = F.col("line") == F.max("line").over(Window.partitionBy("file", "page"))
    cut = last & ~F.max(F.col("mark") & F.col("t").rlike(r"(?i)\bBalance\s+C/F\b")).over(Window.partitionBy("file", "page"))
    rows = rows.withColumn("cut", cut).withColumn("cuts", F.count_if("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("anchor_cuts", F.last(F.when(F.col("anchor"), F.col("cuts")), ignorenulls=True).over(w))
    goes_on = (F.col("t") != "") & ~F.col("anchor") & ~F.col("mark") & ~F.col("header") & (F.col("tid") > 0) & (F.col("here") | (F.col("brought") & (F.col("cuts") == F.col("anchor_cuts"))))
    head = F.regexp_replace(F.trim(F.regexp_replace("t", PBB_ANCHOR, "")), r"^(\d{2}/\d{2})(?:\s+|$)", "")
    part = F.struct("page", "line", "anchor", "day", F.when(F.col("anchor"), F.trim(head)).otherwise(F.col("t")).alias("text"), F.regexp_extract("t", PBB_ANCHOR, 1).alias("a"), F.regexp_extract("t", PBB_ANCHOR, 2).alias("b"))
    made = rows.where(F.col("anchor") | goes_on).groupBy("file", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"))
    made = made.select("file", "tid", F.expr("p[0].page").alias("page"), F.expr("p[0].day").alias("day"), F.trim(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("description"), amount(F.expr("p[0].a")).alias("amount"), amount(F.expr("p[0].b")).alias("balance"))
    printed = F.coalesce(*(F.when(F.col("t").rlike(p), F.struct("page", F.lit(k).alias("k"), "line", F.regexp_extract("t", p, 1).alias("y"))) for k, p in enumerate(PBB_YEAR)))
    years = rows.where("page <= 3").groupBy(F.col("file").alias("y_file")).agg(F.min(printed)["y"].alias("y")).select("y_file", F.when(F.length("y") == 4, F.col("y")).otherwise(F.concat(F.lit("20"), F.col("y"))).alias("y"))
    made = made.join(years, F.col("file").eqNullSafe(F.col("y_file")), "left")
    year = F.coalesce("y", F.lit(default_year).cast("string"))
    made = _stepped(made, F.lag("balance").over(Window.partitionBy("file").orderBy("tid")))
    first = F.upper("description").rlike(r"\bCR\b|^DEP|CREDIT")
    credit = F.when(F.col("step").isNotNull(), F.greatest("step", F.lit(0.0))).when(first, F.col("amount")).otherwise(0.0)
    debit = F.when(F.col("step").isNotNull(), F.greatest(-F.col("step"), F.lit(0.0))).when(first, 0.0).otherwise(F.col("amount"))
    dt = F.try_to_date(F.concat_ws("/", F.coalesce("day", F.lit("01/01")), F.coalesce(year, F.lit("-"))), "dd/MM/yyyy")
    return _out(made.withColumn("dt", dt).withColumn("credit", credit).withColumn("debit", debit).withColumn("marker", F.lit(False)))


def ocbc_text(c: Column) -> Column:
    """A description cut at the earliest advertisement, with four words behind its last reference mark."""
    def cut(s: Column) -> Column:
        at = F.least(*(F.nullif(F.instr(F.upper(s), m), F.lit(0)) for m in OCBC_ARTIFACTS))
        return F.when(at.isNull(), s).otherwise(F.substring(s, F.lit(1), at - 1))

    s = F.regexp_replace(bound(spaced(c), cut), r"(?i)^(.*\bREF\s*+:?+\s*+)(?!.*\bREF)((?:\S+ ){3}\S+) .*$", "$1$2")
    return spaced(F.regexp_replace(s, r"\s*[-=/,:;|]+\s*$", ""))


def ocbc(lines: DataFrame) -> DataFrame:
    """A dated line with amount and balance starts a transaction; details follow until a line that ends it.

    A page ends at its transaction summary. Words in the first line tell the side, else the step of the balance within
    five cents, else the step itself. A file with an opening balance and no transaction gives one marker row without a day.
    """
    rows, w = _lines(lines)
    rows = rows.where("t <> ''")
    page = Window.partitionBy("file", "page").orderBy("line")
    rows = rows.withColumn("over", F.max(F.contains("u", F.lit("TRANSACTION")) & F.contains("u", F.lit("SUMMARY"))).over(page))
    rows = rows.withColumn("dated", ~F.col("over") & F.col("t").rlike(OCBC_START)).withColumn("rest", F.regexp_extract("t", OCBC_START, 4))
    words = F.split("rest", " ")
    rows = rows.withColumn("at", F.when(F.col("dated"), F.filter(F.transform(words, lambda x, i: F.when(x.rlike(rf"^{MONEY}$"), i)), lambda i: i.isNotNull())))
    rows = rows.withColumn("starts", F.col("dated") & (F.size("at") > 1)).withColumn("words", words)
    ends = F.col("over") | F.col("dated") | contains_any(F.col("u"), (*OCBC_ENDS, *OCBC_ARTIFACTS))
    rows = rows.withColumn("tid", F.count_if(F.col("starts")).over(w)).withColumn("gid", F.count_if(F.col("starts") | ends).over(w))
    rows = rows.withColumn("open", (F.col("gid") == F.last(F.when(F.col("starts"), F.col("gid")), ignorenulls=True).over(w)) & ~F.col("starts"))
    padded = F.concat(F.lit(" "), F.col("u"), F.lit(" "))
    detail = F.col("u").startswith("DESC:") | F.col("u").startswith("REF:") | F.col("u").startswith("/IB") | F.contains(padded, F.lit(" DUITNOW")) | (F.size(F.split("t", " ")) <= 6)
    day = F.try_to_date(F.concat_ws(" ", F.regexp_extract("t", OCBC_START, 1), F.initcap(F.regexp_extract("t", OCBC_START, 2)), F.regexp_extract("t", OCBC_START, 3)), "dd MMM yyyy")
    two = F.col("at")[F.size("at") - 2]
    head = ocbc_text(F.array_join(F.slice("words", F.lit(1), two), " "))
    body = F.when(F.col("starts"), head).when(detail & ~F.regexp_replace("t", ",", "").rlike(rf"^{MONEY}$"), F.col("t"))
    value = lambda i: F.when(F.col("starts"), amount(F.get("words", i)))
    part = F.struct("page", "line", F.when(F.col("starts"), day).alias("day"), body.alias("text"), value(two).alias("a"), value(F.element_at("at", -1)).alias("b"))
    made = rows.where(F.col("starts") | F.col("open")).groupBy("file", "tid").agg(F.sort_array(F.collect_list(part)).alias("p"))
    first = F.expr("p[0].text")
    grown = F.aggregate(F.filter(F.transform(F.slice("p", 2, 1 << 20), lambda x: x["text"]), lambda t: t.isNotNull()), first, lambda acc, t: ocbc_text(F.concat(acc, F.lit(" "), t)))
    made = made.select("file", "tid", F.expr("p[0].page").alias("page"), F.expr("p[0].day").alias("dt"), first.alias("head"), ocbc_text(grown).alias("description"), F.expr("p[0].a").alias("amount"), F.expr("p[0].b").alias("balance"))
    found = rows.where(F.col("t").rlike(OCBC_OPENING)).withColumn("opening", amount(F.regexp_extract("t", OCBC_OPENING, 1)))
    opening = found.groupBy(F.col("file").alias("o_file")).agg(F.min(F.struct("page", "line", "opening")).alias("o"))
    made = made.join(opening, F.col("file").eqNullSafe(F.col("o_file")), "full").withColumn("file", F.coalesce("file", "o_file")).withColumn("marker", F.col("tid").isNull())
    order = Window.partitionBy("file").orderBy("tid")
    earlier = F.when(F.col("o.page") <= F.min("page").over(Window.partitionBy("file")), F.col("o.opening"))
    made = _stepped(made, F.coalesce(F.lag("balance").over(order), earlier))
    said = F.concat(F.lit(" "), F.upper("head"), F.lit(" "))
    size, step = F.abs("amount"), F.col("step")
    pair = lambda c, d: F.struct(c.cast("double").alias("c"), d.cast("double").alias("d"))
    none = F.lit(0.0)
    side = F.when(contains_any(said, OCBC_CREDIT) & ~contains_any(said, OCBC_DEBIT[:2]), pair(size, none)).when(contains_any(said, OCBC_DEBIT), pair(none, size))
    side = side.when(F.abs(step - F.col("amount")) <= 0.05, pair(size, none)).when(F.abs(step + F.col("amount")) <= 0.05, pair(none, size))
    side = side.when(step > 0, pair(step, none)).when(step < 0, pair(none, -step)).otherwise(pair(none, none))
    made = made.withColumn("side", side).withColumn("credit", F.when(F.col("marker"), 0.0).otherwise(F.round("side.c", 2))).withColumn("debit", F.when(F.col("marker"), 0.0).otherwise(F.round("side.d", 2)))
    made = made.withColumn("description", F.when(F.col("marker"), "NO TRANSACTIONS (BALANCE B/F)").otherwise(F.col("description"))).withColumn("balance", F.when(F.col("marker"), F.col("o.opening")).otherwise(F.col("balance")))
    return _out(made)


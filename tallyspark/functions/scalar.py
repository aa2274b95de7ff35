"""Column functions over statement text, amounts, dates and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import MONTHS

#: Words that are no counterparty, and words of a bill rail.
MONTH_WORDS = (*MONTHS, "SEPT", "JANUARY", "FEBRUARY", "MARCH", "APRIL", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
PURPOSE_WORDS = (
    "BULK", "SALARY", "PAYMENT", "PAY", "TRANSFER", "TRF", "FUND", "SETTLEMENT", "SETTLE", "LOAN", "REPAYMENT", "ADVANCE", "IBG", "ADVICE", "CREDIT", "DEBIT",
    "ACCOUNT", "HUB", "MISC", "DUITNOW", "FPX", "INSTANT", "CR", "DR", "TO", "FROM", "FR", "TRANSACTION", "TRANSACTIONS", "TRANS", "DEPOSIT", "WITHDRAWAL",
    "CASH", "INWARD", "OUTWARD",
)
BILL_WORDS = ("JOMPAY", "BILL", "PAYMENT", "PAYMENTS", "AT", "DIO", "DEBIT", "CREDIT", "TRANSFER", "TRANSFERS", "TXN", "REF", "FR")
#: Where a bank's footer begins inside a description, in any case of letters.
FOOTERS = (
    "可應用存餘", "截止結餘", "未過賬", "本欄内誌DR者爲結欠", "若银行在21天内未获得书面通知", "余额将被视为正确", "請通知本行在何地址更换", "進支項說明",
    "BALANCE DITANDAKAN DENGAN DR", "PERHATIAN / NOTE", "SEMUA MAKLUMAT DAN BAKI", "OVERDRAWN BALANCES ARE", "DENOTED BY DR", "PROTECTED BY PIDM",
    "PLEASE NOTIFY US OF ANY CHANGE OF ADDRESS IN WRITING", "APPLICABLE FOR PA-I MINOR AND IN-TRUST", "START SUBMITTING YOUR AUDIT CONFIRMATION REPORT",
    "AUDIT CONFIRMATION REPORT REQUEST", "REQUESTS, PLEASE VISIT OUR WEBSITE", "TRANSFER FUNDS OVERSEAS QUICKLY AND EASILY",
    "BUSINESS MOBILE APP.ENJOY", "BUSINESS MOBILE APP. ENJOY", "OCBC FLASH", "THROUGH OCBC VELOCITY", "OUR SMES, FOR MORE INFORMATION",
    "BUILD YOUR BUSINESS STARTING WITH THE OCBC EBIZ ACCOUNT", "THE SHARIAH-COMPL", "ECONFIRM PORTAL",
    "HTTPS://WWW.OCBC.COM.MY/BUSINESS-BANKING/HELP-AND-SUPPORT#FORMS", "HTTPS://WWW.OCBC.COM.MY/EBIZ-I", "HTTPS://ECONFIRM.MY",
    "SILA HANTAR PERMINTAAN", "UNTUK BORANG DAN SOALAN LAZIM", "YOUR BANKING QUESTIONS ANSWERED", "A MEMBER OF OCBC GROUP", "IF THE PROPERTY OR ASSET",
    "LOCAL CHEQUES", "CEK-CEK TEMPATAN", "WITH EFFECT FROM", "BASE LENDING RATE", "INSURANCE KADAR PINJAMAN", "EFFECTIVE 30 SEPTEMBER",
    "PROPRIETORSHIP WILL NO LONGER", "HTTPS:WWW.I-MUAMALAT.COM.MY", "HTTPS://WWW.I-MUAMALAT.COM.MY", "WWW.I-MUAMALAT.COM.MY",
    "SEGALA BILANGAN DAN BAKI", "ALL ITEMS AND BALANCES", 'TANDA "-" PADA BAKI', 'THE SIGN "-" AGAINST', "SILA MAKLUMKAN KEPADA", "CHANGE OF ADDRESS",
    "SEBARANG CEK DEPOSIT", "ANY CHEQUES DEPOSITED", "TOTAL ENDING BALANCE", "CURRENT I-MUAMALAT ONLINE", "ONLINE PORTAL",
    "THIS IS A COMPUTER GENERATED STATEMENT", "FOR ENQUIRIES, PLEASE CONTACT", "IF YOU HAVE ANY QUESTIONS ABOUT THIS STATEMENT",
    "PLEASE CONTACT OUR CUSTOMER SERVICE", "THIS STATEMENT WAS GENERATED BY", "FOR MORE INFORMATION ABOUT YOUR ACCOUNT",
    "THIS IS A SYSTEM GENERATED STATEMENT", "IF YOU HAVE ANY QUESTIONS REGARDING THIS STATEMENT", "FOR ANY INQUIRIES ABOUT THIS STATEMENT",
)
SPACE = r"(?U)\s+"


def normalize_text(c: Column) -> Column:
    """white space (Unicode's too) drawn together and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def to_amount(c: Column) -> Column:
    """a number from text: brackets or a trailing minus negate, signs and currency words are dropped, else 0."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    bracket = s.rlike(r"^\(.*\)$")
    inner = F.trim(F.when(bracket, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s))
    minus, plus = inner.endswith("-"), inner.endswith("+")
    body = F.regexp_replace(F.regexp_replace(inner, r"[+-]$", ""), r"[^0-9.\-]", "")
    value = F.coalesce(body.try_cast("double"), F.lit(0.0))
    return F.when(bracket | minus, -F.abs(value)).when(plus, F.abs(value)).otherwise(value)


#: Notations beyond the day-first ones, tried last.
DATE_FORMATS = ("dd.MM.yyyy", "yyyy/MM/dd")


def to_date(c: Column, default_year: Column | int | None = None) -> Column:
    """ISO dates as they stand, then day-first ones with ``/``, ``-`` or a month's first three letters; else null.

    Two-digit years from 69 up are of the last century. A date without a year takes ``default_year``, null without one.
    """
    s = normalize_text(c)
    year = F.lit(None).cast("string") if default_year is None else (default_year if isinstance(default_year, Column) else F.lit(default_year)).cast("string")
    numeric, named = r"^(\d{1,2})([/-])(\d{1,2})(?:\2(\d{4}|\d{2}))?$", r"^(\d{1,2})[ -]([A-Za-z]{3})(?:[ -](\d{4}|\d{2}))?$"

    def full(y: Column) -> Column:
        return F.when(y == "", year).when(F.length(y) == 2, F.concat(F.when(y >= "69", "19").otherwise("20"), y)).otherwise(y)

    def tried(pattern: str, month: int, at: int, form: str) -> Column:
        part = lambda k: F.regexp_extract(s, pattern, k)
        return F.when(s.rlike(pattern), F.try_to_date(F.concat_ws(" ", part(1), F.initcap(part(month)), F.coalesce(full(part(at)), F.lit("-"))), form))

    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), tried(numeric, 3, 4, "d M yyyy"), tried(named, 2, 3, "d MMM yyyy"), *(F.try_to_date(s, f) for f in DATE_FORMATS))


def strip_footer(c: Column, footers: tuple[str, ...] = FOOTERS) -> Column:
    """cut at the earliest footer, white space drawn together, trailing punctuation off."""
    s = normalize_text(c)
    at = F.least(*(F.nullif(F.instr(F.upper(s), m), F.lit(0)) for m in footers)) if len(footers) > 1 else F.nullif(F.instr(F.upper(s), footers[0]), F.lit(0))
    return F.trim(F.regexp_replace(F.when(at.isNull(), s).otherwise(F.substring(s, F.lit(1), at - 1)), r"[\s\-=/,:;|]+$", ""))


def signed_amount(credit: Column, debit: Column, amount: Column | None = None) -> Column:
    """credits positive, debits negative, else the amount."""
    return F.when(credit > 0, credit).when(debit > 0, -debit).otherwise(amount if amount is not None else F.lit(None))


def row_side(credit: Column, debit: Column) -> Column:
    """CR or DR if exactly one side is positive, else null."""
    c, d = F.coalesce(credit, F.lit(0)), F.coalesce(debit, F.lit(0))
    return F.when((c > 0) & (d <= 0), "CR").when((d > 0) & (c <= 0), "DR")


def positive(c: Column) -> Column:
    """F10."""
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))


def weekday_number(d: Column) -> Column:
    """Weekdays up to a date since a Monday."""
    n = F.datediff(d, F.to_date(F.lit("1990-01-01")))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays in (start, end]; 0 if end is not later. Holidays are taken off by a join, see pairing."""
    return F.when(end <= start, F.lit(0)).otherwise((weekday_number(end) - weekday_number(start))).cast("bigint")


def is_round(c: Column) -> Column:
    """a non-zero multiple of 10,000 (which the tiers up to ten million all are), within a cent."""
    return (F.abs(c) >= 10000) & (F.least(F.abs(c) % 10000, F.lit(10000) - F.abs(c) % 10000) <= 0.01)


def merchant_key(c: Column) -> Column:
    """upper case letters only; numbers of two or more digits go."""
    s = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\b\d{2,}\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^A-Z ]", " "), r" +", " "))


#: Payment rails cut from a party's text.
RAILS = (r"TRANSFER TO A/C", r"TRANSFER FR A/C", r"INTER-BANK PAYMENT INTO A/C", r"CMS\s*-\s*CR\s*PYMT", r"DUITNOW\s*QR-", r"\*", r"=\s*BAKI\s*LEGAR.*")


def party_name(c: Column) -> Column:
    """the party in a description: rails and long numbers cut, 80 characters at most."""
    s = F.upper(normalize_text(c))
    for p in RAILS:
        s = F.regexp_replace(s, p, " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\d{6,}", " "), r"\s+", " "))
    return F.when(s == "", "UNKNOWN").when(s.rlike("^[0-9 ]+$"), F.concat(F.lit("BANK_CLEARING_"), s)).otherwise(F.substring(s, 1, 80))


def company_suffix(c: Column) -> Column:
    """SB, SDN, SDN B, SDN BH and their like at the end become SDN BHD; empty is UNKNOWN."""
    s = F.regexp_replace(F.upper(normalize_text(c)), r"[ .,\-]+$", "")
    s = F.regexp_replace(s, r"(?<=\S)[ ]+(?:SB|SN|SND|SD|SDN)\.?(?:[ ]+(?:B|BH|BDH|BHD)\.?)?$", " SDN BHD")
    return F.when(s == "", "UNKNOWN").otherwise(s)


def no_counterparty(c: Column) -> Column:
    """empty, without a letter, of two characters or fewer, or made of months and purposes only."""
    s = F.upper(normalize_text(c))
    stop = F.array(*map(F.lit, dict.fromkeys(MONTH_WORDS + PURPOSE_WORDS)))
    return ~s.rlike("[A-Z]") | (F.length(s) <= 2) | F.forall(F.split(s, " "), lambda t: F.array_contains(stop, t))


#: Corporate suffixes, glued, cut short and abbreviated ones; markers of a person's name.
CORPORATE = r"(?i)(?<![A-Z])(?:SDN\.?\s*BHD\.?|BERHAD|BHD\.?|ENTERPRISES?|TRADING|CORPORATION|GROUP|HOLDINGS|INDUSTRIES)(?![A-Z])"
CORPORATE_GLUED = r"(?i)[A-Z]{4,}(?:SDNBHD\.?|BERHAD|BHD\.?)(?![A-Z])"
CORPORATE_CUT = r"(?i)[A-Z]{2,}\s+(?:\([^)]*\)\s+)?(?:SDN\.?(?:\s+BH?\.?)?|SB)\s*$"
PERSON = r"(?i)(?:^|\s)(?:BIN|BINTI|A/L|A/P)(?:\s|$)"


def has_corporate_suffix(c: Column) -> Column:
    """F18."""
    return F.coalesce(c.rlike(CORPORATE) | c.rlike(CORPORATE_GLUED) | c.rlike(CORPORATE_CUT), F.lit(False))


def is_person(c: Column) -> Column:
    """a marker of a person's name stands as a word."""
    return F.coalesce(c.rlike(PERSON), F.lit(False))


def company_root(c: Column) -> Column:
    """without brackets, suffixes, punctuation and leading numbers; '' for a bare number."""
    s = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"\b(?:SDN\.?\s*BHD\.?|SENDIRIAN BERHAD|BERHAD|BHD\.?|ENTERPRISES?|TRADING|CORPORATION|GROUP|HOLDINGS|INDUSTRIES)", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^A-Z0-9 ]", " "), r"\s+", " "))
    s = F.regexp_replace(s, r"^(?:\d+\s+)+", "")
    return F.when(s.rlike(r"^\d+$"), "").otherwise(s)


def own_party(name: Column, description: Column, roots: list[str]) -> Column:
    """a company root of five letters or more stands in the text or name, or a name of six or more in the root."""
    n, d = F.upper(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(description, F.lit("")))
    hits = [d.contains(r) | n.contains(r) | ((F.length(n) >= 6) & F.lit(r).contains(n)) for r in roots if len(r) >= 5]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def bill_code_only(c: Column) -> Column:
    """begins with the bill rail and names nobody."""
    words = F.split(F.upper(c), r"[^A-Z0-9]+")
    stop = F.array(*map(F.lit, BILL_WORDS))
    return F.coalesce(c.rlike(r"(?i)^\s*JOMPAY\b") & F.forall(words, lambda t: ~t.rlike("^[A-Z]{2,}$") | F.array_contains(stop, t)), F.lit(False))


def unknown_label(c: Column) -> Column:
    """labels that stand for no party."""
    s = F.upper(normalize_text(c))
    return s.isin("", "UNKNOWN", "UNNAMED", "N/A", "NONE", "-") | s.startswith("BANK_CLEARING_") | s.startswith("UNKNOWN ")


def fingerprint(*parts: Column) -> Column:
    """sha-256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def money(c: Column) -> Column:
    """F29."""
    return F.format_string("RM %,.2f", F.coalesce(c.cast("double"), F.lit(0.0)))


def round_debit(c: Column) -> Column:
    """1,000 or more and a multiple of 100, in cents."""
    return (c >= 1000) & (F.pmod(F.round(c * 100).cast("bigint"), F.lit(10000)) == 0)

"""The company or holder that a statement's first pages name (P19): labels, blocks and lines of company shape, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bankparties import bound, off, spaced

# Labels before a name, where a name ends, what marks a company and what is none.
LABELS = (
    r"(?:ACCOUNT\s+NAME|A/C\s+NAME|CUSTOMER\s+NAME|NAMA\s+AKAUN|NAMA\s+PELANGGAN|NAMA)",
    r"(?:ACCOUNT\s+HOLDER|PEMEGANG\s+AKAUN)",
)
ENDS = r"\s{2,}|ACCOUNT\s+NO|A/C\s+NO|NO\.\s*AKAUN|NO\s+AKAUN|STATEMENT|PENYATA|DATE|TARIKH|CURRENCY|BRANCH|PAGE|HALAMAN"
NO_NAME = r"A/C\s*NO|AC\s*NO|ACCOUNT\s*NO|ACCOUNT\s*NUMBER|NO\.?\s*AKAUN|NO\s+AKAUN|STATEMENT\s+DATE|TARIKH\s+PENYATA|DATE\s+FROM|DATE\s+TO|CURRENCY|BRANCH|SWIFT|IBAN|PAGE\s+\d+"
FORMS = r"\b(SDN\.?\s*BHD\.?|BHD\.?|ENTERPRISE|RESOURCES|HOLDINGS|TRADING|SERVICES|TECHNOLOGY|VENTURES|INDUSTRIES|GLOBAL|GROUP|CORPORATION|PLT)\b"
HEADINGS = r"\b(STATEMENT|ACCOUNT\s+STATEMENT|CURRENT\s+ACCOUNT|PAGE\b|BALANCE\b|SUMMARY\b|TRANSACTION|ENQUIRIES|BRANCH|PIDM|DATE\b|MUKA\b|HALAMAN\b)\b"
ACCOUNT = r"A/C|ACCOUNT\s*NO|ACCOUNT\s*NUMBER|NOMBOR\s+AKAUN|NO\.?\s*AKAUN"
DATE_LABEL = r"^TARIKH\s+PENYATA$"
DATE_TAIL = r"\s*(?:結單日期|结单日期)\s*[:：]?.*$"
BLOCK = r"Company\s*/\s*Account"


def company_clean(c: Column) -> Column:
    """A candidate without its label, leading codes and numbers, and what follows the name; glued legal forms apart."""

    def apart(s: Column) -> Column:
        s = off(off(s, r"\bSDNBHD\b", by="SDN BHD"), r"(?<=[A-Za-z0-9])\((M|MALAYSIA)\)", by=" ($1)")
        return off(off(s, r"\)(?=[A-Za-z])", by=") "), r"(?<=[A-Za-z0-9)])(?=(?:SDN|BHD|BERHAD|PLT)\b)", by=" ")

    s = off(apart(F.trim(F.coalesce(c, F.lit("")))), rf"^\s*(?:{LABELS[0]}|{LABELS[1]})\s*[:\-]?\s+")
    s = off(s, r"^\s*(?:[A-Z]{1,4}[-/]?\d{2,6}|\d{2,6}[-/]?[A-Z]{1,4})\s+", r"^\s*\d{1,5}\s+(?=[A-Z][A-Z0-9&().,'/-]*(?:\s|$))")
    s = F.trim(off(s, rf"(?:{ENDS}).*$"))
    s = apart(F.trim(off(F.trim(off(s, r"\bSDN\.?\s*BHD\.?\b.*$", by="SDN BHD")), DATE_TAIL)))
    return spaced(F.regexp_replace(s, r"^[:;\-• ]+", ""))


def no_account(c: Column) -> Column:
    """Three characters or more that are no account line and hold no long number."""
    return ~c.rlike(f"(?i){NO_NAME}") & ~c.rlike(r"\d{6,}") & (F.length(c) >= 3)


def headed(c: Column) -> Column:
    return no_account(c) & ~c.rlike(f"(?i){HEADINGS}") & ~c.rlike(r"(?i)https?://|www\.")


def is_company(c: Column) -> Column:
    return headed(c) & (F.length(c) >= 6) & ~c.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b") & c.rlike(f"(?i){FORMS}")


def is_holder(c: Column) -> Column:
    return headed(c) & ~c.rlike(r"\d{2}/\d{2}(?:/\d{2,4})?") & c.rlike("[A-Za-z]")


def company_name(lines: DataFrame, pages: int = 2) -> DataFrame:
    """``(file, company)`` of the text lines ``(file, page, line, text)`` of each file's first ``pages`` pages.

    The first of these that gives a name decides: the line behind a company's block of balances, a labelled name, the line
    behind a label of the statement's date (of 40 lines), the line before an account's label, a line or two lines in a row
    of a company's shape (of 80). Files without such a line get null, null and empty texts are no lines, and ties go to the
    line that stands first. A file's header lines are the largest thing that a window holds.
    """
    rows = lines.where((F.col("page") <= pages) & (F.trim("text") != "")).select("file", "page", "line", F.trim("text").alias("t"))
    w = Window.partitionBy("file")
    rows = rows.withColumn("n", F.row_number().over(w.orderBy("page", "line", "t"))).withColumn("up", F.lag("t").over(w.orderBy("n"))).withColumn("down", F.lead("t").over(w.orderBy("n")))
    rows = rows.withColumn("b1", F.min(F.when(F.col("t").rlike(f"(?i){BLOCK}"), F.col("n"))).over(w))
    again = (F.col("n") > F.col("b1")) & F.col("t").rlike(r"(?i)\bCompany\b") | (F.col("n") == F.col("b1")) & F.col("t").rlike(rf"(?i){BLOCK}.*?\bCompany\b")
    rows = rows.withColumn("b2", F.min(F.when(again, F.col("n"))).over(w))
    behind = r"(?i)^([A-Z0-9 &().,'/-]{3,})"
    cut_off = lambda c: bound(F.trim(off(c, r"\bMYR\b.*$")), lambda x: F.when(x == "", c).otherwise(x))
    label = [rf"(?i){p}\s*[:\-]" for p in LABELS]
    said = lambda p: F.regexp_extract(F.concat_ws("\n", "t", "down"), rf"{p}\s*(.+)", 1)
    both = F.concat_ws(" ", "t", "down")
    made = rows.select(
        "file", "n", "t",
        F.when((F.col("n") > F.col("b2")) & F.col("t").rlike(behind), company_clean(F.regexp_extract("t", behind, 1))).alias("block"),
        *(F.when(F.col("t").rlike(p), company_clean(said(p))).alias(f"label{k}") for k, p in enumerate(label)),
        F.when((F.col("n") <= 40) & F.col("t").rlike(f"(?i){DATE_LABEL}"), company_clean(F.col("down"))).alias("dated"),
        F.when((F.col("n") <= 80) & F.col("t").rlike(f"(?i){ACCOUNT}"), company_clean(F.col("up"))).alias("before"),
        F.when(F.col("n") <= 80, company_clean(F.col("t"))).alias("own"),
        F.when((F.col("n") <= 80) & F.col("down").isNotNull(), company_clean(both)).alias("two"),
    )
    shaped = F.when(is_company(F.col("own")), F.col("own")).when(is_company(F.col("two")) & (F.length("two") <= 120), F.col("two"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("n")))
    per = made.groupBy("file").agg(
        first(cut_off(F.col("block"))).alias("block"), *(first(F.col(f"label{k}")).alias(f"label{k}") for k in range(len(LABELS))),
        first(F.when(is_holder(F.col("dated")), F.col("dated"))).alias("dated"), first(F.when(is_company(F.col("before")), F.col("before"))).alias("before"), first(shaped).alias("shaped"),
    )
    valid = lambda k: F.when(no_account(F.col(k)), F.col(k))
    return per.select("file", F.coalesce(valid("block"), *(valid(f"label{k}") for k in range(len(LABELS))), "dated", "before", "shaped").alias("company"))

"""Statement sources: a parser registry, a text-layout parser and post-passes that no layout changes.

PDF, OCR and decryption libraries are not part of this engine; a reader for them registers here and emits the
same columns. What follows a parser - sides from balance steps, control totals, account numbers, lines of words -
is relational and works for every layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "file string, line int, dt date, description string, amount double, side string, balance double"

#: The banks whose statements are known.
BANKS = ("Affin Bank", "Agro Bank", "Alliance Bank", "Ambank", "Bank Islam", "Bank Muamalat", "Bank Rakyat", "CIMB Bank", "Hong Leong", "Maybank", "OCBC", "Public Bank (PBB)", "RHB Bank", "UOB Bank")

_parsers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(bank: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    """A parser takes ``(path, content)`` rows and returns ``SCHEMA``."""
    _parsers[bank] = parser


def banks() -> list[str]:
    return sorted(_parsers)


def read(spark: SparkSession, path: str, bank: str) -> DataFrame:
    """The files under a path through a bank's parser, one task per file where files are large."""
    return _parsers[bank](spark.read.format("binaryFile").load(path).select("path", "content"))


LINE = r"^\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})\s+(.*?)\s+([\d,]+\.\d{2})\s*([+-]|CR|DR)?\s+(-?[\d,]+\.\d{2})\s*$"


def text_layout(files: DataFrame) -> DataFrame:
    """A plain layout: date, text, amount with an optional sign, balance. Lines that do not fit are no rows."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line", "raw")).where(F.col("raw").rlike(LINE))
    part = lambda k: F.regexp_extract("raw", LINE, k)
    number = lambda k: F.regexp_replace(part(k), ",", "").cast("double")
    day = F.coalesce(F.try_to_date(part(1), "d/M/yyyy"), F.try_to_date(part(1), "d-M-yyyy"))
    side = F.when(part(4).isin("+", "CR"), "CR").when(part(4).isin("-", "DR"), "DR")
    return lines.select("file", "line", day.alias("dt"), F.trim(part(2)).alias("description"), number(3).alias("amount"), side.alias("side"), number(5).alias("balance"))



def canonical(rows: DataFrame) -> DataFrame:
    """Printed sides as they stand, others from the balance step; the first row of a file keeps CR."""
    w = Window.partitionBy("file").orderBy("line")
    step = F.col("balance") - F.lag("balance").over(w)
    side = F.coalesce("side", F.when(step < 0, "DR").otherwise("CR"))
    return rows.withColumn("side", side).select("file", "line", "dt", "description", F.when(F.col("side") == "CR", F.col("amount")).otherwise(0.0).alias("credit"), F.when(F.col("side") == "DR", F.col("amount")).otherwise(0.0).alias("debit"), "balance")


def control_total_choice(candidates: DataFrame, tolerance: float = 0.06) -> DataFrame:
    """Of the printed numbers taken as opening, credits, debits and closing the set that adds up best.

    ``candidates(file, role, value)`` holds a page's few printed numbers; a file's sets are formed inside its row.
    """
    role = lambda r: F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("value")))).alias(r)
    per = candidates.groupBy("file").agg(role("o"), role("c"), role("d"), role("e"))
    sets = per.select("file", F.explode("o").alias("o"), "c", "d", "e").select("file", "o", F.explode("c").alias("c"), "d", "e").select("file", "o", "c", F.explode("d").alias("d"), "e").select("file", "o", "c", "d", F.explode("e").alias("e"))
    off = F.abs(F.col("o") + F.col("c") - F.col("d") - F.col("e"))
    best = sets.groupBy("file").agg(F.min_by(F.struct("o", "c", "d", "e", off.alias("off")), F.struct(F.round(off, 2), -(F.col("c") + F.col("d")), "o", "c", "d", "e")).alias("b"))
    return best.select("file", "b.*").where(F.col("off") <= tolerance)


def account_number(lines: DataFrame) -> DataFrame:
    """The best-scored number of a file's header lines ``(file, text)``: label before it, then repeats, length, digits."""
    label = F.when(F.col("text").rlike(r"(?i)ACCOUNT\s*(?:NO|NUMBER)"), 120).when(F.col("text").rlike(r"(?i)\bA/?C\b|NO\.?\s+AKAUN"), 100).when(F.col("text").rlike(r"(?i)ACCOUNT|AKAUN"), 60).otherwise(0)
    found = lines.select("file", label.alias("score"), F.explode(F.regexp_extract_all("text", F.lit(r"(\d[\d-]{8,17}\d)"), F.lit(1))).alias("raw"))
    number = F.regexp_replace("raw", "-", "")
    agg = found.groupBy("file", number.alias("number")).agg((F.max("score") + 10 * F.count("*")).alias("score"))
    return agg.groupBy("file").agg(F.max_by("number", F.struct("score", F.length("number"), "number")).alias("account_no"))


def outlier_balances(rows: DataFrame, reach: float = 1_500_000.0, least: int = 10) -> DataFrame:
    """Balances farther than ``reach`` from a file's upper median go, if it has ten or more."""
    mid = rows.where("balance is not null").groupBy("file").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY balance DESC)").alias("mid"), F.count("*").alias("n"))
    j = rows.join(mid, "file", "left")
    return j.where((F.coalesce(F.col("n"), F.lit(0)) < least) | F.col("balance").isNull() | (F.abs(F.col("balance") - F.col("mid")) <= reach)).drop("mid", "n")


def nearest_balances(daily: DataFrame) -> DataFrame:
    """One of each day's candidate balances, the nearest to the one chosen the day before; the first day takes its first."""
    days = daily.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("dt", "candidates"))).alias("days"))
    zero = F.expr("cast(array() as array<struct<dt:date,balance:double>>)")
    near = lambda acc, x: F.array_min(F.transform(x["candidates"], lambda v: F.struct(F.abs(v - F.element_at(acc, -1)["balance"]).alias("off"), v.alias("balance"))))["balance"]
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["dt"].alias("dt"), F.when(F.size(acc) == 0, x["candidates"][0]).otherwise(near(acc, x)).alias("balance"))))
    return days.select("file", F.explode(F.aggregate("days", zero, step)).alias("d")).select("file", "d.*")


def quality_counts(tx: DataFrame) -> DataFrame:
    """The documented invariants of parsed rows, per bank or file: rows, bad dates, missing keys, both sides filled."""
    return tx.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.col("dt").isNull()).alias("invalid_dates"), F.count_if(F.col("description").isNull()).alias("missing_keys"), F.count_if((F.col("credit") > 0) & (F.col("debit") > 0)).alias("both_sides"))


def first_pattern(text: Column, rules: list[tuple[str, str]], default: str = "Other") -> Column:
    """a bank's ordered (pattern, category) list, the first that fits."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out

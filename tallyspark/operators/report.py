"""Reports: merging, assembly, export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import first_of

#: Keys of a report that merge by minimum, maximum or mean; all others are summed.
LOWEST = ("eod_lowest", "lowest_balance", "lowest_closing_balance")
HIGHEST = ("eod_highest", "highest_balance", "highest_closing_balance", "high_value_threshold", "large_transaction_threshold", "large_credit_threshold")


def merge_reports(rows: DataFrame) -> DataFrame:
    """``(report_id, key, value)`` of several reports into one value per key, by the class of the key."""
    kind = F.when(F.col("key").isin(*LOWEST), "min").when(F.col("key").isin(*HIGHEST), "max").when(F.col("key").contains("average") | F.col("key").endswith("_avg"), "mean").otherwise("sum")
    agg = rows.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("s"), F.count("value").alias("n"))
    k = agg.withColumn("kind", kind)
    value = F.when(F.col("kind") == "min", F.col("lo")).when(F.col("kind") == "max", F.col("hi")).when(F.col("kind") == "mean", F.col("s") / F.col("n")).otherwise(F.col("s"))
    return k.select("key", "kind", F.round(value, 2).alias("value"))


def union_sections(*sections: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Sections of several reports by name, the first row of each key."""
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return first_of(out, *(F.lower(F.col(k).cast("string")) for k in keys), order=order)


def documents(tx: DataFrame, name: str) -> DataFrame:
    """Each account's section as canonical JSON with its sha-256. Rows are aggregated by month first."""
    rows = tx.groupBy("account_no", "month").agg(F.count("*").alias("n"), F.sum("credit").cast("double").alias("credits"), F.sum("debit").cast("double").alias("debits"))
    doc = rows.groupBy("account_no").agg(F.to_json(F.sort_array(F.collect_list(F.struct("month", "n", "credits", "debits")))).alias("body"))
    return doc.select("account_no", F.lit(name).alias("section"), "body", F.sha2("body", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sections whose hash is no longer the one that was written."""
    b = before.select("account_no", "section", F.col("sha256").alias("was"))
    return after.join(b, ["account_no", "section"], "left").select("account_no", "section", F.when(F.col("was").isNull(), "NEW").when(F.col("was") == F.col("sha256"), "UNCHANGED").otherwise("EDITED").alias("status"))


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in the given folder; dates in ISO form."""
    df.write.mode("overwrite").json(path)


SECTION = "array<struct<month:string,n:bigint,credits:double,debits:double>>"


def import_sections(docs: DataFrame) -> DataFrame:
    """Sections back into rows under an explicit schema; bodies that do not parse give one row with nulls."""
    parsed = docs.withColumn("r", F.explode_outer(F.from_json("body", SECTION)))
    return parsed.select("account_no", "section", "r.*")


def import_aliases(docs: DataFrame) -> DataFrame:
    """``(alias, canonical)`` from a mapping document ``{"parties": [{"name", "aliases": []}]}``."""
    p = docs.select(F.explode(F.from_json("body", "struct<parties:array<struct<name:string,aliases:array<string>>>>")["parties"]).alias("p"))
    return p.select(F.explode("p.aliases").alias("alias"), F.col("p.name").alias("canonical"))


def export_aliases(names: DataFrame) -> DataFrame:
    """The mapping document of ``(alias, canonical)`` rows, one line per canonical name."""
    per = names.groupBy("canonical").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return per.select(F.to_json(F.struct(F.array(F.struct(F.col("canonical").alias("name"), "aliases")).alias("parties"))).alias("body"))


def integrity_rows(roll_up: DataFrame) -> DataFrame:
    """The roll-up under the report's names."""
    return roll_up.select("file_id", F.create_map(F.lit("LOW"), F.lit("CLEAN"), F.lit("MEDIUM"), F.lit("REVIEW"), F.lit("HIGH"), F.lit("SUSPICIOUS"))[F.col("risk")].alias("integrity"), "findings")


#: Names of the sheet's signals.
SIGNALS = (
    "Returned Cheques (Inward)", "Returned Cheques (Outward)", "Round Figure Transactions (AML)", "High Value Credits (>3x EOD)", "Cash Deposits (AML)", "EPF Compliance",
    "SOCSO Compliance", "LHDN Tax Payments", "Large Transactions", "Own Party Transactions", "Related Party Transactions", "Loan Activity", "Data Quality", "FX Transactions",
    "Low Closing Balance", "HRDF Payments",
)


def low_months(months: DataFrame, least: float = 1000.0) -> DataFrame:
    """One row: the account-months that close below ``least``, in order, as text."""
    return months.agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("closing") < least, F.col("month")))), ", ").alias("low_list"))


def risk_sheet(s: DataFrame, low: DataFrame, threshold: float = 10000.0) -> DataFrame:
    """Sixteen signals derived anew from the one-row summary: ``(id, name, signal, remarks)``.

    Unlike R01's flags, credits above the end-of-day balance, tax and training levy are never detected here, a fund is
    covered from 99.5 %, and the low months are listed. ``threshold`` is what the report calls a large transaction.
    """
    col = F.col
    rm = lambda c: F.format_string("RM %,.2f", (col(c) if isinstance(c, str) else c).cast("double"))
    pct = lambda a, b: F.format_string("%.1f%%", F.coalesce(col(a) / F.nullif(col(b), F.lit(0.0)) * 100, F.lit(0.0)))
    say = lambda *p: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in p))
    n = lambda c: col(c).cast("string")
    no = F.lit(False)
    counted = lambda k, what, none: (col(f"{k}_count") > 0, say(n(f"{k}_count"), f" {what} totalling ", rm(f"{k}_amount"), "."), none)
    fund = lambda name, p: ((col("salary_months") > 0) & (col(p) < 99.5), F.when(col("salary_months") > 0, say(f"{name} coverage ", F.format_string("%.1f%%", col(p)), " across salary months.")).otherwise("No salary months detected."))
    flow = lambda k, what, tail: ((col(f"{k}_credits") > 0) | (col(f"{k}_debits") > 0), say(f"{what} CR ", rm(f"{k}_credits"), " (", pct(f"{k}_credits", "gross_credits"), " of gross credits); DR ", rm(f"{k}_debits"), " (", pct(f"{k}_debits", "gross_debits"), f" of gross debits).{tail}"))
    paid = lambda k, what, tail, none: F.when(col(f"{k}_months") > 0, say(f"{what} payments detected: ", n(f"{k}_months"), " tx totalling ", rm(f"{k}_amount"), f" ({tail}).")).otherwise(none)
    large = f"RM{threshold:,.0f}"
    either = lambda d, yes, none: (d, F.when(d, yes).otherwise(none))
    rows = [
        either(*counted("returned_in", "inward returned cheques", "No inward returned cheques in the period.")),
        either(*counted("returned_out", "outward returned cheques", "No outward returned cheques in the period.")),
        either(*counted("round", "round-figure transactions", "No round-figure transactions flagged.")),
        (no, F.lit("No credits exceeded 3x daily EOD.")),
        either(col("cash_amount") > 0, say(n("cash_count"), " cash deposits totalling ", rm("cash_amount"), " (", pct("cash_amount", "gross_credits"), " of gross credits)."), "No cash deposits in the period."),
        fund("EPF", "epf_pct"),
        fund("SOCSO", "socso_pct"),
        (no, paid("tax", "LHDN", "PCB/CP204/SST — schedules differ; informational only", "No LHDN tax payments detected.")),
        either(*counted("large", f"large transactions (>={large})", f"No transactions at or above {large}.")),
        either(*flow("own", "Own-party", ""), "No own-party transactions detected."),
        either(*flow("related", "Related-party", " Parties: (no canonical names provided)."), "No related-party transactions detected."),
        either((col("loans_in") > 0) | (col("loans_out") > 0), say("Loan disbursements ", rm("loans_in"), "; loan repayments ", rm("loans_out"), "."), "No loan disbursements or repayments detected."),
        either(col("gap_months") > 0, say("Statement data INCOMPLETE: ", n("gap_months"), " months missing"), "Statement data complete across the period."),
        either((col("fx_credits") > 0) | (col("fx_debits") > 0), say("FX credits ", rm("fx_credits"), "; FX debits ", rm("fx_debits"), "."), "No FX (foreign-currency) activity detected."),
        either(col("low_list") != "", say("Closing balance below RM 1,000.00 in: ", col("low_list"), "."), "Closing balance stayed at or above RM 1,000.00 every month."),
        (no, paid("hrdf", "HRDF", "informational; no coverage ratio computed", "No HRDF payments detected.")),
    ]
    names = [f"{name} (>={large})" if name == "Large Transactions" else name for name in SIGNALS]
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("id"), F.lit(name).alias("name"), F.when(d, "YES").otherwise("NO").alias("signal"), r.alias("remarks")) for k, (name, (d, r)) in enumerate(zip(names, rows, strict=True), 1)))).alias("r")
    return s.crossJoin(low).select(listed).select("r.*")  # two one-row sides


def correct_months(report: DataFrame, summary: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Closing balances of a report taken from a summary where they differ beyond the tolerance."""
    s = summary.select("account_no", "month", F.col("closing").alias("s_closing"))
    j = report.join(s, ["account_no", "month"], "left")
    off = F.abs(F.col("closing") - F.col("s_closing")) > tolerance
    return j.select("account_no", "month", F.when(F.coalesce(off, F.lit(False)) | F.col("closing").isNull(), F.col("s_closing")).otherwise(F.col("closing")).alias("closing"), F.coalesce(off, F.lit(False)).alias("corrected"))

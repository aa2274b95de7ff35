"""The risk report: summary, sixteen flags, observations and formula checks. Every part is a small relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.scalar import money
from .detect import TEXTS, high_value_credits, text_groups
from .monthly import completeness, judged, monthly, statutory_sums, statutory_totals


def dbl(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


#: The summary's sums over the whole statement.
SUMS = (
    "gross_credits", "gross_debits", "returned_in_count", "returned_in_amount", "returned_out_count", "returned_out_amount", "cash_count", "cash_amount",
    "tax_count", "tax_amount", "hrdf_count", "hrdf_amount", "round_count", "round_amount", "large_count", "large_amount", "own_credits", "own_debits",
    "related_credits", "related_debits", "loans_in", "loans_out", "fx_credits", "fx_debits", "review_count",
)


def summary(classified: DataFrame) -> DataFrame:
    """One row with all that the flags read.

    One pass gives groups by month, side, category and text; months are summed from them, and the row from the months.
    High-value credits, gaps and low closings are one-row sides of their own.
    """
    groups = text_groups(classified, *TEXTS, by=("month", "primary"))
    col, zero = F.col, F.lit(0)
    cr, dr = col("side9") == "CR", col("side9") == "DR"
    rows = lambda k: F.coalesce(F.sum(F.when(k, col("n"))), zero)
    paid = lambda k, side: F.coalesce(F.sum(F.when(k, col(side))), zero)
    both = lambda n, k, side: (rows(k).alias(f"{n}_count"), paid(k, side).alias(f"{n}_amount"))
    of = lambda n, c, side: paid(col("primary") == c, side).alias(n)
    sums = (
        F.sum("credit").alias("gross_credits"), F.sum("debit").alias("gross_debits"),
        *both("returned_in", col("is_returned") & dr, "debit"), *both("returned_out", col("is_returned") & cr, "credit"),
        *both("cash", col("is_cash") & cr, "credit"), *both("tax", col("is_tax") & dr, "debit"), *both("hrdf", col("is_hrdf") & dr, "debit"),
        *both("round", col("is_round"), "credit"), *both("large", col("is_large"), "credit"),
        of("own_credits", "C01", "credit"), of("own_debits", "C02", "debit"), of("related_credits", "C03", "credit"), of("related_debits", "C04", "debit"),
        of("loans_in", "C10", "credit"), of("loans_out", "C11", "debit"),
        paid(col("is_fx") & cr, "credit").alias("fx_credits"), paid(col("is_fx") & dr, "debit").alias("fx_debits"),
        rows(col("primary").isNull() & col("is_loan")).alias("review_count"),
    )
    months = groups.groupBy("month").agg(*sums, *statutory_sums())
    total = lambda n: (F.coalesce(F.sum(n), zero) if n.endswith("_count") else dbl(F.sum(n)) if n.startswith("gross") else F.coalesce(dbl(F.sum(n)), F.lit(0.0))).alias(n)
    one = judged(months.agg(*map(total, SUMS), *statutory_totals()))
    high = high_value_credits(classified).agg(F.count("*").alias("high_count"), F.coalesce(dbl(F.sum("credit")), F.lit(0.0)).alias("high_amount"))
    gaps = completeness(classified).agg(F.sum("gaps").alias("gap_months"), F.count_if(F.col("gaps") > 0).alias("gap_accounts"))
    low = monthly(classified).where(F.col("closing") < R.LOW_CLOSING).agg(F.count("*").alias("low_months"), F.min("closing").alias("lowest_closing"))
    out = one
    for part in (high, gaps, low):
        out = out.crossJoin(part)
    return out


def flags(s: DataFrame, account_type: str = "CR", od_limit: float | None = None, monthly_rows: DataFrame | None = None) -> DataFrame:
    """Sixteen rows ``(id, name, detected, remarks)`` from the one-row summary."""
    col = F.col
    pct = lambda a, b: F.format_string("%.1f%%", F.coalesce(col(a) / F.nullif(col(b), F.lit(0.0)) * 100, F.lit(0.0)))
    say = lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    n = lambda c: col(c).cast("string")
    counted = lambda c, a, yes, no: (col(c) > 0, F.when(col(c) > 0, say(n(c), f" {yes} totalling ", money(col(a)), ".")).otherwise(no))
    share = lambda fund, p, miss: (col(p) < 100, F.when(col(p) < 100, say(f"{fund} coverage ", F.format_string("%.1f%%", col(p)), " of salary months; missing: ", F.coalesce(col(miss), F.lit("")), ".")).otherwise(f"{fund} coverage 100% across salary months."))
    active = col("salary_months") > 0
    noted = lambda c, a, what: (F.when(col(c) > 0, False).otherwise(active), F.when(col(c) > 0, say(f"{what} payments detected: ", n(c), " tx totalling ", money(col(a)), ".")).when(active, f"No {what} payments detected despite active salary months.").otherwise(f"No {what} payments detected; no salary activity."))
    moved = lambda a, b, what, none: ((col(a) > 0) | (col(b) > 0), F.when((col(a) > 0) | (col(b) > 0), say(f"{what} CR ", money(col(a)), " (", pct(a, "gross_credits"), " of gross credits); DR ", money(col(b)), " (", pct(b, "gross_debits"), " of gross debits).")).otherwise(none))
    loans = (col("loans_in") > 0) | (col("loans_out") > 0) | (col("review_count") > 0)
    fx = (col("fx_credits") > 0) | (col("fx_debits") > 0)
    if account_type == "OD":
        if od_limit:
            drawn = monthly_rows.where(F.abs("closing") >= od_limit * R.OD_UTILISATION).agg(F.count("*").alias("drawn_months"))
            s = s.crossJoin(drawn)
            closing = (col("drawn_months") > 0, F.when(col("drawn_months") > 0, say("OD utilisation at or above 90% in ", n("drawn_months"), " months.")).otherwise("OD utilisation healthy across all months."))
        else:
            closing = (F.lit(False), F.lit("OD account without a limit; utilisation is not judged."))
    else:
        closing = (col("low_months") > 0, F.when(col("low_months") > 0, say("Closing balance below ", money(F.lit(R.LOW_CLOSING)), " in ", n("low_months"), " account-months.")).otherwise(say("Closing balance stayed at or above ", money(F.lit(R.LOW_CLOSING)), " every month.")))
    parts = [
        counted("returned_in_count", "returned_in_amount", "inward returned cheques", "No inward returned cheques in the period."),
        counted("returned_out_count", "returned_out_amount", "outward returned cheques", "No outward returned cheques in the period."),
        counted("round_count", "round_amount", "round-figure credits", "No round-figure credits flagged."),
        counted("high_count", "high_amount", "credits above 3x end-of-day balance", "No credits exceeded 3x end-of-day balance."),
        (col("cash_count") > 0, F.when(col("cash_count") > 0, say(n("cash_count"), " cash deposits totalling ", money(col("cash_amount")), " (", pct("cash_amount", "gross_credits"), " of gross credits).")).otherwise("No cash deposits in the period.")),
        share("EPF", "epf_pct", "epf_missing"),
        share("SOCSO", "socso_pct", "socso_missing"),
        noted("tax_count", "tax_amount", "LHDN"),
        counted("large_count", "large_amount", "large credits (>=RM100K)", "No credits at or above RM100,000."),
        moved("own_credits", "own_debits", "Own-party", "No own-party transactions detected."),
        moved("related_credits", "related_debits", "Related-party", "No related-party transactions detected."),
        (loans, F.when(loans, say("Loan disbursements ", money(col("loans_in")), "; repayments ", money(col("loans_out")), "; ", n("review_count"), " loan-shaped rows to review.")).otherwise("No loan disbursements or repayments detected.")),
        (col("gap_months") > 0, F.when(col("gap_months") > 0, say("Statement data INCOMPLETE: ", n("gap_months"), " months missing in ", n("gap_accounts"), " accounts.")).otherwise("Statement data complete across the period.")),
        (fx, F.when(fx, say("FX credits ", money(col("fx_credits")), "; FX debits ", money(col("fx_debits")), ".")).otherwise("No FX activity detected.")),
        closing,
        noted("hrdf_count", "hrdf_amount", "HRDF"),
    ]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("id"), F.lit(name).alias("name"), F.coalesce(d, F.lit(False)).alias("detected"), r.alias("remarks")) for k, (name, (d, r)) in enumerate(zip(R.FLAGS, parts, strict=True), 1)))).alias("f")
    return s.select(rows).select("f.*")


def observations(s: DataFrame, most: int = 8) -> DataFrame:
    """Up to eight positive points and eight concerns, as rows."""
    positive = [(F.col("epf_pct") >= 100, "EPF paid in every salary month"), (F.col("socso_pct") >= 100, "SOCSO paid in every salary month"), (F.col("returned_in_count") == 0, "No inward returned cheques"), (F.col("gross_credits") >= F.col("gross_debits"), "Credits cover debits"), (F.col("gap_months") == 0, "Statements are complete")]
    concern = [(F.col("returned_in_count") > 0, "Inward returned cheques"), (F.col("round_count") > 0, "Round-figure credits"), (F.col("cash_count") > 0, "Cash deposits"), (F.col("low_months") > 0, "Low closing balances"), (F.col("gap_months") > 0, "Months are missing"), (F.col("gross_credits") < F.col("gross_debits"), "Debits exceed credits"), (F.col("review_count") > 0, "Loan-shaped rows to review")]
    listed = lambda xs, kind: F.transform(F.slice(F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in xs))), 1, most), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    return s.select(F.explode(F.concat(listed(positive, "positive"), listed(concern, "concern"))).alias("o")).select("o.*")


def account_meta(meta: DataFrame) -> DataFrame:
    """Of several entries of an account an overdraft one wins and the largest limit holds."""
    return meta.groupBy("account_no").agg(F.when(F.bool_or(F.col("account_type") == "OD"), "OD").otherwise("CR").alias("account_type"), F.max("od_limit").alias("od_limit"))


def formula_checks(tx: DataFrame) -> DataFrame:
    """V1 to V6 as rows: net, balance identity, debit and credit sums, and mean contribution ratios in their bands."""
    from .monthly import contribution_ratios, statutory_months

    m = monthly(tx).agg(F.round(F.sum("gross_credits"), 2).alias("c"), F.round(F.sum("gross_debits"), 2).alias("d"))
    t = tx.agg(F.round(dbl(F.sum("credit")), 2).alias("tc"), F.round(dbl(F.sum("debit")), 2).alias("td"), F.count_if((F.col("credit") > 0) & (F.col("debit") > 0)).alias("both_sides"), F.count_if((F.col("credit") < 0) | (F.col("debit") < 0)).alias("negative"))
    months = statutory_months(tx)
    r = months.agg(F.sum(F.when((F.col("salary") > 0) & (F.col("epf") > 0), F.col("epf"))).alias("epf"), F.sum(F.when((F.col("salary") > 0) & (F.col("epf") > 0), F.col("salary"))).alias("es"), F.sum(F.when((F.col("salary") > 0) & (F.col("socso") > 0), F.col("socso"))).alias("soc"), F.sum(F.when((F.col("salary") > 0) & (F.col("socso") > 0), F.col("salary"))).alias("ss"))
    one = m.crossJoin(t).crossJoin(r)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 0.02
    band = lambda a, b, lo, hi: F.coalesce((F.col(a) / F.col(b) * 100).between(lo, hi), F.lit(True))
    checks = [("V1", near("c", "tc")), ("V2", near("d", "td")), ("V3", F.col("both_sides") == 0), ("V4", F.col("negative") == 0), ("V5", band("epf", "es", 8.0, 16.0)), ("V6", band("soc", "ss", 1.0, 5.0))]
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("id"), F.when(c, "PASS").otherwise("REVIEW").alias("status")) for k, c in checks))).alias("v")).select("v.*")

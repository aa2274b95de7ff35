"""Row detectors: every rule is one boolean column of a single projection, then one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.scalar import bill_code_only, has_corporate_suffix, is_person, is_round, row_side


def has(pattern: str, c: str | Column = "description") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(f"(?i){pattern}"), F.lit(False))


def salary_text() -> Column:
    """A salary word that is no commission, own-account transfer or fee blob."""
    return (has(R.SALARY) | has(R.SALARY_JOINED)) & ~has(R.COMMISSION) & ~has(R.OWN_ACCOUNT) & ~has(R.FEE_BLOB)


def fx_text() -> Column:
    """The negative list first."""
    return ~has(R.FX_NOT) & (has(R.FX_WORDS) | has(R.FX_AMOUNT))


#: Detector id -> (column, side or None). The amount is the side's.
DETECTORS = {
    "D04_returned_cheque_inward": (lambda: has(R.RETURNED_CHEQUE), "DR"),
    "D04_returned_cheque_outward": (lambda: has(R.RETURNED_CHEQUE), "CR"),
    "D05_epf": (lambda: has(R.EPF), "DR"),
    "D06_socso": (lambda: has(R.SOCSO), "DR"),
    "D07_lhdn": (lambda: has(R.LHDN), "DR"),
    "D08_hrdf": (lambda: has(R.HRDF), "DR"),
    "D09_salary": (salary_text, "DR"),
    "D10_reversal": (lambda: has(R.REVERSAL), "CR"),
    "D11_inward_return": (lambda: has(R.INWARD_RETURN), "CR"),
    "D12_cash_deposit": (lambda: has(R.CASH_DEPOSIT), "CR"),
    "D13_cash_withdrawal": (lambda: has(R.CASH_WITHDRAWAL), "DR"),
    "D14_cheque_deposit": (lambda: has(R.CHEQUE_DEPOSIT), "CR"),
    "D15_cheque_issue": (lambda: has(R.CHEQUE_ISSUE), "DR"),
    "D16_bank_fees": (lambda: has(R.BANK_FEES), "DR"),
    "D17_loan_disbursement": (lambda: has(R.LOAN_IN), "CR"),
    "D17_loan_repayment": (lambda: has(R.LOAN_OUT), "DR"),
    "D18_fx_credit": (fx_text, "CR"),
    "D18_fx_debit": (fx_text, "DR"),
    "D20_cheque_like": (lambda: has(R.CHEQUE_LIKE), "DR"),
}


def flagged(tx: DataFrame) -> DataFrame:
    """All detectors' columns in one projection; rules that share a text are evaluated once by Catalyst."""
    tx = tx.withColumn("side9", row_side(F.col("credit"), F.col("debit")))
    return tx.select("*", *((f() & (F.col("side9") == s)).alias(k) for k, (f, s) in DETECTORS.items()))


#: Texts that the report groups by.
TEXTS = {
    "returned": lambda: has(R.RETURNED_CHEQUE), "cash": lambda: has(R.CASH_DEPOSIT), "tax": lambda: has(R.LHDN), "hrdf": lambda: has(R.HRDF),
    "epf": lambda: has(R.EPF), "socso": lambda: has(R.SOCSO), "salary": salary_text, "fx": fx_text, "cheque": lambda: has(R.CHEQUE_LIKE),
    "loan": lambda: has(R.LOAN_SHAPED) & ~has(R.LOAN_NOISE) & (F.greatest("credit", "debit") > 0),
    "round": lambda: (F.col("credit") >= R.ROUND_STEP) & (F.pmod(F.round(F.col("credit") * 100).cast("bigint"), F.lit(R.ROUND_STEP * 100)) == 0),
    "large": lambda: F.col("credit") >= R.LARGE_CREDIT,
}


def text_groups(tx: DataFrame, *texts: str, by: tuple[str, ...] = ("month",)) -> DataFrame:
    """Rows and exact sums by month, side and which of ``TEXTS`` a row shows: every pattern is run once a row.

    All that reports say of sides, texts and months is a second aggregate of these groups, of which there are as many as
    months times combinations that occur.
    """
    keys = [*by, "side9", "pays", *(f"is_{t}" for t in texts)]
    seen = tx.withColumn("side9", row_side(F.col("credit"), F.col("debit"))).withColumn("pays", F.col("debit") > 0)
    seen = seen.select(*by, "side9", "pays", "credit", "debit", *(TEXTS[t]().alias(f"is_{t}") for t in texts))
    return seen.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("credit").alias("credit"), F.sum("debit").alias("debit"))


def totals(tx: DataFrame, *by: str) -> DataFrame:
    """Count and amount of every detector, one aggregate over one scan; ``(detector, n, amount)`` per group."""
    amount = lambda s: F.col("credit" if s == "CR" else "debit")
    sums = F.count("*").alias("n"), F.sum("credit").alias("credit"), F.sum("debit").alias("debit")
    groups = flagged(tx).groupBy(*by, *DETECTORS).agg(*sums)  # each pattern once a row; few combinations occur
    cols = [c for k, (_, s) in DETECTORS.items() for c in (F.coalesce(F.sum(F.when(F.col(k), F.col("n"))), F.lit(0)).alias(f"n_{k}"), F.coalesce(F.sum(F.when(F.col(k), amount(s))), F.lit(0)).cast("double").alias(f"a_{k}"))]
    wide = groups.groupBy(*by).agg(*cols)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("detector"), F.col(f"n_{k}").alias("n"), F.col(f"a_{k}").alias("amount")) for k in DETECTORS))).alias("r")
    return wide.select(*by, rows).select(*by, "r.*")


def round_credits(tx: DataFrame, step: int = R.ROUND_STEP) -> DataFrame:
    """Credits of at least a step that are whole multiples of it, in cents."""
    return tx.where((F.col("credit") >= step) & (F.pmod(F.round(F.col("credit") * 100).cast("bigint"), F.lit(step * 100)) == 0))


def large_credits(tx: DataFrame, least: int = R.LARGE_CREDIT) -> DataFrame:
    """D02."""
    return tx.where(F.col("credit") >= least)


def end_of_day(tx: DataFrame, *by: str) -> DataFrame:
    """The last balance of each day that has one, by row order."""
    return tx.where("balance is not null").groupBy(*by, "month", "dt").agg(F.max_by("balance", "row_order").alias("eod"))


def high_value_credits(tx: DataFrame, times: int = R.HIGH_VALUE_TIMES) -> DataFrame:
    """Credits above ``times`` the month's mean end-of-day balance; months without a positive mean give none."""
    mean = end_of_day(tx, "account_no").groupBy("account_no", "month").agg((F.sum("eod").cast("double") / F.count("eod")).alias("eod_average"))
    return tx.join(mean.where("eod_average > 0"), ["account_no", "month"]).where(F.col("credit").cast("double") > F.col("eod_average") * times)


def unbooked_loans(classified: DataFrame) -> DataFrame:
    """Rows shaped like loan activity that no rule booked."""
    return booked(classified).where(F.col("primary").isNull() & has(R.LOAN_SHAPED) & ~has(R.LOAN_NOISE) & (F.greatest("credit", "debit") > 0))


def channel_blind(tx: DataFrame) -> DataFrame:
    """Cheque-like debits of 500,000 or more that are a tenth of all debits or more."""
    agg = tx.where("debit > 0").agg(F.coalesce(F.sum(F.when(has(R.CHEQUE_LIKE), F.col("debit"))), F.lit(0)).cast("double").alias("cheque_debits"), F.coalesce(F.sum("debit"), F.lit(0)).cast("double").alias("gross_debits"))
    share = F.when(F.col("gross_debits") > 0, F.col("cheque_debits") / F.col("gross_debits")).otherwise(0.0)
    return agg.withColumn("blind", (F.col("cheque_debits") >= R.BLIND_AMOUNT) & (share >= R.BLIND_SHARE))


def small_payroll(tx: DataFrame) -> DataFrame:
    """Salaries above zero and at most 30,000 in all."""
    total = tx.agg(F.coalesce(F.sum(F.when(salary_text() & (F.col("debit") > 0), F.col("debit"))), F.lit(0)).cast("double").alias("salaries"))
    return total.withColumn("small", (F.col("salaries") > 0) & (F.col("salaries") <= R.SMALL_PAYROLL))


def high_value(tx: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """Either side at or (strict) above a threshold."""
    top = F.greatest("credit", "debit")
    return tx.withColumn("is_high_value", top > least if strict else top >= least)


def round_share(tx: DataFrame, *by: str) -> DataFrame:
    """Suspicious if over a quarter of the rows have a non-zero multiple of 1,000 on a side."""
    hit = ((F.col("credit") != 0) & (F.col("credit") % 1000 == 0)) | ((F.col("debit") != 0) & (F.col("debit") % 1000 == 0))
    return tx.groupBy(*by).agg((F.count_if(hit).cast("double") / F.count("*")).alias("round_share")).withColumn("suspicious", F.col("round_share") > 0.25)


def round_rows(tx: DataFrame) -> DataFrame:
    """Rows whose signed amount is a round one."""
    signed = F.when(F.col("credit") > 0, F.col("credit")).otherwise(-F.col("debit"))
    return tx.withColumn("signed", signed.cast("double")).where(is_round(F.col("signed")))


def token_hits(tx: DataFrame, company: str, least: int, text: str = "description") -> DataFrame:
    """Rows whose text holds at least ``least`` of the company's words of three letters or more as words."""
    words = [w for w in dict.fromkeys(company.upper().split()) if len(w) >= 3 and not w.isdigit() and w not in ("SDN", "BHD", "BERHAD", "THE", "AND")]
    found = [F.when(has(rf"\b{w}\b", text), F.lit(1)).otherwise(0) for w in words]
    return tx.withColumn("hits", sum(found, F.lit(0))).where(F.col("hits") >= least)


def salary_recipients(ledger: DataFrame) -> DataFrame:
    """Parties with two or more salary debits that make up half of what they got."""
    paid = ledger.where("debit > 0")
    agg = paid.groupBy("party").agg(F.count_if(salary_text()).alias("salary_rows"), F.coalesce(F.sum(F.when(salary_text(), F.col("debit"))), F.lit(0)).cast("double").alias("salary"), F.sum("debit").cast("double").alias("paid"))
    return agg.where("salary_rows >= 2 AND salary >= 0.5 * paid")


def director_benefit(ledger: DataFrame) -> DataFrame:
    """Persons for whom a debit pays a hire purchase, housing or personal loan or card."""
    benefit = r"\bHP\b|HIRE\s*PURCHASE|CAR\s+LOAN|HOUSING\s+LOAN|PERSONAL\s+LOAN|CREDIT\s+CARD"
    return ledger.where(is_person(F.col("party"))).groupBy("party").agg(F.coalesce(F.bool_or(has(benefit) & (F.col("debit") > 0)), F.lit(False)).alias("benefit"))


def classify(tx: DataFrame, companies: tuple[str, ...] = (), related: tuple[str, ...] = (), factoring: tuple[str, ...] = (), party: str = "party") -> DataFrame:
    """The first rung that fits gives category, reason and mode; the ladder is one CASE over one projection."""
    from ..functions.scalar import own_party

    tx = tx.withColumn("side9", row_side(F.col("credit"), F.col("debit")))
    cr, dr = F.col("side9") == "CR", F.col("side9") == "DR"
    name = F.upper(F.coalesce(F.col(party), F.lit("")))
    memo = has(R.LOAN_IN) | has(R.LOAN_OUT)
    within = lambda names, c: [c.contains(n.upper()) for n in names if n]
    any_of = lambda xs: F.coalesce(sum((F.when(x, 1).otherwise(0) for x in xs), F.lit(0)) > 0, F.lit(False))
    text = F.upper(F.coalesce(F.col("description"), F.lit("")))
    related_hit = any_of(within(related, name) + within(related, text))
    side_of = {k: v for k, v in R.SIDES.items()}
    rungs: list[tuple[Column, Column | str, str, str]] = [
        (has(R.BALANCE_ROW), "C25", "balance row", "KEYWORD"),
        (cr & has(r"\(OWN[ -]PARTY\)", party) & ~memo, "C01", "own-party marker", "KEYWORD"),
        (dr & has(r"\(OWN[ -]PARTY\)", party) & ~memo, "C02", "own-party marker", "KEYWORD"),
        (cr & own_party(F.col(party), F.col("description"), list(companies)) & ~memo, "C01", "own company", "KEYWORD"),
        (dr & own_party(F.col(party), F.col("description"), list(companies)) & ~memo, "C02", "own company", "KEYWORD"),
        (dr & salary_text(), "C05", "salary", "KEYWORD"),
        (cr & has(R.LOAN_IN), "C10", "loan disbursement", "KEYWORD"),
        (cr & any_of(within(factoring, name) + within(factoring, text)), "C10", "factoring", "KEYWORD"),
        (dr & has(R.LOAN_OUT) & ~has(R.FEE_BLOB) & ~has(R.BANK_FEES), "C11", "loan repayment", "KEYWORD"),
        (cr & related_hit, "C03", "related party", "KEYWORD"),
        (dr & related_hit, "C04", "related party", "KEYWORD"),
        *((name.eqNullSafe(b) & F.col("side9").isNotNull() & ((F.lit(side_of[c]) == "ANY") | (F.col("side9") == side_of[c])), c, f"bucket {b}", "BUCKET") for b, c in R.BUCKETS.items()),
        *((dr & ~bill_code_only(F.col("description")) & has(p), c, r, "KEYWORD") for p, c, r in ((R.EPF, "C06", "epf"), (R.SOCSO, "C07", "socso"), (R.LHDN, "C08", "lhdn"), (R.HRDF, "C09", "hrdf"))),
        (dr & has(R.FINANCIER, party) & ~has(R.FINANCIER_NOT, party) & ~is_person(F.col(party)), "C11", "financier", "HEURISTIC"),
        (cr & has(R.REVERSAL), "C13", "reversal", "KEYWORD"),
        (dr & has(R.RETURNED_CHEQUE), "C14", "returned cheque", "KEYWORD"),
        (cr & has(R.RETURNED_CHEQUE), "C15", "returned cheque", "KEYWORD"),
        (cr & has(R.INWARD_RETURN), "C16", "inward return", "KEYWORD"),
        (cr & has(R.CASH_DEPOSIT), "C17", "cash deposit", "KEYWORD"),
        (dr & has(R.CASH_WITHDRAWAL), "C18", "cash withdrawal", "KEYWORD"),
        (cr & has(R.CHEQUE_DEPOSIT), "C19", "cheque deposit", "KEYWORD"),
        (dr & has(R.CHEQUE_ISSUE), "C20", "cheque issue", "KEYWORD"),
        (dr & has(R.BANK_FEES), "C24", "bank fees", "KEYWORD"),
        (cr & has_corporate_suffix(F.col(party)) & ~is_person(F.col(party)), "C26", "trade income", "HEURISTIC"),
        (dr & has_corporate_suffix(F.col(party)) & ~is_person(F.col(party)), "C27", "trade expense", "HEURISTIC"),
    ]
    hit = F.coalesce(*(F.when(c, F.struct(F.lit(k).alias("primary"), F.lit(r).alias("reason"), F.lit(m).alias("mode"))) for c, k, r, m in rungs))
    return tx.withColumn("hit", hit).select("*", "hit.primary", "hit.reason", "hit.mode").drop("hit")


def booked(classified: DataFrame) -> DataFrame:
    """Classified rows for filters on their category: it comes out of a generator, below which no filter on it is pushed.

    Pushed, the filter would run the ladder a second time, with the party's expression written out in every rung.
    """
    return classified.withColumn("primary", F.explode(F.array("primary")))



"""Dedupe, parties, ledgers, patterns, return pairing and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.scalar import business_days, fingerprint, merchant_key, no_counterparty, normalize_text, party_name, round_debit, unknown_label
from .anchors import names_in
from .detect import has, salary_text


def dbl(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def first_of(df: DataFrame, *keys, order: str = "row_order") -> DataFrame:
    """The first row of each key; nulls are equal."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_fingerprint(tx: DataFrame, account: bool = True) -> DataFrame:
    """Day, text, sides and balance of a row, with its account unless told otherwise."""
    two = lambda c: F.format_string("%.2f", dbl(c))
    parts = [F.col("dt").cast("string"), normalize_text(F.col("description")), two("debit"), two("credit"), F.when(F.col("balance").isNull(), "").otherwise(two("balance"))]
    return tx.withColumn("fp", fingerprint(*parts, *([F.col("account_no").cast("string")] if account else [])))


def dedupe(tx: DataFrame) -> DataFrame:
    """U01/X01."""
    return first_of(with_fingerprint(tx), "fp")


def duplicate_rows(tx: DataFrame) -> DataFrame:
    """Rows that share day, text and amount with another."""
    amount = F.when(F.col("credit") > 0, F.col("credit")).otherwise(F.col("debit"))
    w = Window.partitionBy("dt", F.upper(normalize_text(F.col("description"))), amount)
    return tx.withColumn("copies", F.count("*").over(w)).where("copies > 1")


def duplicate_merchants(tx: DataFrame) -> DataFrame:
    """The same by account, day, merchant, direction and amount."""
    way = F.when(F.col("credit") > 0, "CR").otherwise("DR")
    w = Window.partitionBy("account_no", "dt", merchant_key(F.col("description")), way, F.greatest("credit", "debit"))
    return tx.withColumn("copies", F.count("*").over(w)).where("copies > 1")


def with_party(tx: DataFrame) -> DataFrame:
    """The deterministic party of each row."""
    return tx.withColumn("party", party_name(F.col("description")))


def ledger(tx: DataFrame) -> DataFrame:
    """Counts and sums of each party."""
    return with_party(tx).groupBy("party").agg(F.count("*").alias("n"), F.count_if(F.col("credit") > 0).alias("credit_n"), F.count_if(F.col("debit") > 0).alias("debit_n"), dbl(F.sum("credit")).alias("credits"), dbl(F.sum("debit")).alias("debits"), dbl(F.sum("credit") - F.sum("debit")).alias("net"))


def ledger_months(tx: DataFrame) -> DataFrame:
    """Sums of each party, side and month."""
    return with_party(tx).groupBy("party", "side", "month").agg(F.count("*").alias("n"), dbl(F.sum("amount")).alias("amount"))


def top_parties(tx: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` parties with the largest sums of each side, ties by name. The ranking runs on party sums."""
    sums = with_party(tx).groupBy("side", "party").agg(dbl(F.sum("amount")).alias("amount"), F.count("*").alias("n"))
    w = Window.partitionBy("side").orderBy(F.desc("amount"), "party")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_by_frequency(tx: DataFrame, k: int = 20) -> DataFrame:
    """By amount, then frequency, then name."""
    return with_party(tx).groupBy("party").agg(dbl(F.sum("amount")).alias("amount"), F.count("*").alias("n")).orderBy(F.desc("amount"), F.desc("n"), "party").limit(k)


def top_known(tx: DataFrame, k: int = 10) -> DataFrame:
    """Without unknown, purpose-only and charge labels before the limit."""
    l = ledger(tx).where(~unknown_label(F.col("party")) & ~no_counterparty(F.col("party")) & ~has(r"\bBILL\b|\bCHARGE", "party"))
    return l.orderBy(F.desc(F.abs("net")), "party").limit(k)


def party_totals(tx: DataFrame) -> DataFrame:
    """Totals over the ledger and over parties without a name."""
    l = ledger(tx)
    return l.agg(F.count("*").alias("parties"), F.count_if(unknown_label(F.col("party"))).alias("unknown"), F.count_if(no_counterparty(F.col("party"))).alias("droppable"), F.round(F.sum("credits"), 2).alias("credits"), F.round(F.sum("debits"), 2).alias("debits"))


def parties(tx: DataFrame) -> DataFrame:
    """Parties without balance rows, by volume."""
    return with_party(tx.where(~has(R.BALANCE_ROW))).groupBy("party").agg(F.count("*").alias("n"), dbl(F.sum("credit")).alias("credits"), dbl(F.sum("debit")).alias("debits"), dbl(F.sum(F.greatest("credit", "debit"))).alias("volume"), F.max("dt").cast("string").alias("last_day"))


def merge_by_name(l: DataFrame, name: str = "party") -> DataFrame:
    """Ledger rows whose names agree in letters and digits become one; the largest keeps its name."""
    key = F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")
    return l.groupBy(key.alias("key")).agg(F.max_by(name, F.struct("n", F.length(name), F.col("credits") + F.col("debits"), name)).alias("party"), F.sum("n").alias("n"), F.round(F.sum("credits"), 2).alias("credits"), F.round(F.sum("debits"), 2).alias("debits"), F.array_join(F.sort_array(F.collect_set(name)), "|").alias("raw_names"))


def attach_party(tx: DataFrame, names: DataFrame) -> DataFrame:
    """Party by account, day, text, amount and side; of several ledger rows with one key the last counts."""
    keys = ["account_no", "dt", "description", "amount", "side"]
    last = names.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("row_order")))).where("__n = 1").select(*keys, "party")
    return tx.join(last, keys, "left")


def named_only(l: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without parties that stand for nobody and without listed ones."""
    return l.where(~unknown_label(F.col("party"))).join(excluded, "party", "left_anti")


def substring_parties(tx: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the longest listed name that stands in their description; rows without one are left out.

    The list may be of any size (``names_in``).
    """
    hits = names_in(tx, names, "row_order", F.col("description"))
    best = hits.groupBy(F.col("row_order").alias("__row")).agg(F.min(F.struct((-F.length("name")).alias("n"), "name"))["name"].alias("__name"))
    listed = names.withColumn("__upper", F.upper("name")).groupBy("__upper").agg(F.min("name").alias("name"))
    return tx.join(best, F.col("row_order") == F.col("__row")).join(listed, F.col("__name") == F.col("__upper")).drop("__row", "__name", "__upper")


def report_order(tx: DataFrame) -> DataFrame:
    """By day, nulls last, then row order."""
    return tx.orderBy(F.col("dt").asc_nulls_last(), "row_order")


def calendar(first: Column, last: Column, days: DataFrame, holidays: DataFrame) -> DataFrame:
    """``(day, number)`` of every day from the first to the last of ``days``: business days up to it, without holidays.

    A business-day distance is then the difference of two numbers. The table has a row a day, so it is small whatever the rows.
    """
    span = days.agg(first.alias("a"), last.alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    free = holidays.select(F.col("day").cast("date").alias("__free")).where("__free IS NOT NULL").distinct()
    works = (F.weekday("day") < 5) & F.col("__free").isNull()
    return span.join(F.broadcast(free.where(F.weekday("__free") < 5)), F.col("day") == F.col("__free"), "left").withColumn("number", F.sum(works.cast("int")).over(Window.orderBy("day"))).select("day", "number")


def return_candidates(tx: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Outward transfers and later credits of the same account and amount within five business days.

    Equal amounts to the cent are an equality join on cents; neighbours of a cent are met by three keys per transfer. Without
    ``holidays(day)`` a week and a half bounds each key's range; with them business days are counted by ``calendar``.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    out = tx.where((F.col("debit") > 0) & has(R.OUTWARD_TRANSFER) & ~has(R.RETURN_WORDS)).select(F.col("row_order").alias("dr"), "account_no", F.col("dt").alias("dr_dt"), F.col("debit").alias("dr_amount"), F.explode(F.array(*(cents("debit") + k for k in (-1, 0, 1)))).alias("cents"))
    back = tx.where("credit > 0").select(F.col("row_order").alias("cr"), "account_no", F.col("dt").alias("cr_dt"), F.col("credit").alias("cr_amount"), F.col("description").alias("cr_text"), cents("credit").alias("cents"))
    if holidays is None:
        pairs = out.join(back, ["account_no", "cents"]).where((F.col("cr_dt") >= F.col("dr_dt")) & (F.col("cr_dt") <= F.date_add("dr_dt", 9)))
        return pairs.withColumn("days", business_days(F.col("dr_dt"), F.col("cr_dt"))).where(F.col("days") <= R.PAIR_DAYS)
    days = calendar(F.min("dt"), F.max("dt"), tx, holidays)
    at = lambda n: F.broadcast(days.select(F.col("day").alias(f"__{n}"), F.col("number").alias(f"__{n}_no")))
    out = out.join(at("dr"), F.col("dr_dt") == F.col("__dr"))
    back = back.join(at("cr"), F.col("cr_dt") == F.col("__cr"))
    apart = F.col("__cr_no") - F.col("__dr_no")
    pairs = out.join(back, ["account_no", "cents"]).where((F.col("cr_dt") >= F.col("dr_dt")) & (apart <= R.PAIR_DAYS))
    return pairs.withColumn("days", apart.cast("bigint")).drop("__dr", "__cr", "__dr_no", "__cr_no")


def pair_returns(tx: DataFrame) -> DataFrame:
    """Each outward transfer, by day and order, takes the first credit that no earlier one took.

    Only transfers that compete for credits of one account and amount meet in a task.
    """
    import pandas as pd

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, taken, rows = set(), set(), []
        for r in pdf.sort_values(["dr_dt", "dr", "cr_dt", "cr"]).itertuples():
            if r.dr not in taken and r.cr not in used:
                used.add(r.cr)
                taken.add(r.dr)
                rows.append((r.account_no, r.dr, r.cr, r.days))
        return pd.DataFrame(rows, columns=["account_no", "dr", "cr", "days"])

    c = return_candidates(tx).withColumn("c", F.round(F.col("dr_amount") * 100).cast("bigint"))
    w = Window.partitionBy("account_no").orderBy("c")
    c = c.withColumn("new", F.when(F.col("c") - F.lag("c").over(w) <= 2 * R.PAIR_CENTS, 0).otherwise(1)).withColumn("block", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return c.select("account_no", "block", "dr", "dr_dt", "cr", "cr_dt", "days").groupBy("account_no", "block").applyInPandas(greedy, "account_no bigint, dr bigint, cr bigint, days bigint")


def unkeyworded(tx: DataFrame) -> DataFrame:
    """Candidate pairs whose credit does not say that it is a return."""
    return return_candidates(tx).where(~has(R.INWARD_RETURN, "cr_text"))


def related_signals(tx: DataFrame) -> DataFrame:
    """Signals, score and confidence of each party as a related one."""
    l = with_party(tx)
    gross = l.agg(dbl(F.sum("debit")).alias("gross"))
    personal = r"\bADVANCE\b|\bPERSONAL\b|\bDIRECTOR\b|\bALLOWANCE\b|\bCLAIM\b|\bWIFE\b|\bHUSBAND\b|\bFAMILY\b"
    rounds = (F.col("debit") > 0) & round_debit(F.col("debit"))
    agg = l.groupBy("party").agg(
        dbl(F.sum("debit")).alias("debits"), dbl(F.sum("credit")).alias("credits"), F.count_if(F.col("debit") > 0).alias("dr"), F.count_if(F.col("credit") > 0).alias("cr"),
        F.countDistinct(F.when(F.col("debit") > 0, F.col("month"))).alias("months"), F.count_if(has(personal) & (F.col("debit") > 0)).alias("personal"),
        F.count_if(rounds).alias("rounds"), F.countDistinct(F.when(rounds, F.col("month"))).alias("round_months"),
    ).crossJoin(F.broadcast(gross))
    ratio = F.least("debits", "credits") / F.nullif(F.greatest("debits", "credits"), F.lit(0.0))
    signals = [("personal_keyword_sweep", F.col("personal") >= 2, 2), ("concentration_dr", F.col("debits") >= 0.05 * F.col("gross"), 2), ("monthly_recurrence", F.col("months") >= 3, 1), ("bidirectional_flow", (F.least("dr", "cr") >= 2) & (ratio >= 0.05), 2), ("round_amount_sustained", (F.col("rounds") >= 5) & (F.col("round_months") >= 4), 2), ("round_amount_advance", (F.col("rounds") >= 2) & ~((F.col("rounds") >= 5) & (F.col("round_months") >= 4)), 1)]
    names = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c, _ in signals))), ",")
    score = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0) for _, c, w in signals), F.lit(0))
    anchor = F.coalesce((F.col("personal") >= 2) | ((F.least("dr", "cr") >= 2) & (ratio >= 0.05)), F.lit(False))
    out = agg.withColumn("signals", names).withColumn("score", score).withColumn("anchor", anchor)
    return out.select("party", "debits", "credits", "signals", F.col("score").cast("bigint").alias("score"), F.when((F.col("score") >= 3) & F.col("anchor"), "HIGH").when(F.col("score") >= 2, "MEDIUM").otherwise("LOW").alias("confidence"))


def pattern_summary(tx: DataFrame) -> DataFrame:
    """Headline counts of duplicates, repeats, round and high values."""
    step = tx.agg(F.count("*").alias("rows"), F.count_if((F.greatest("credit", "debit") >= R.LARGE_CREDIT)).alias("high_value"), F.count_if((F.greatest("credit", "debit") >= 10000) & (F.greatest("credit", "debit") % 10000 == 0)).alias("rounds"), F.count_if(salary_text()).alias("salary"))
    return step.crossJoin(duplicate_rows(tx).agg(F.count("*").alias("duplicates")))  # two one-row sides

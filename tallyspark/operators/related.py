"""Related and own parties, statutory pattern detectors, and the pieces a report takes from the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import has_corporate_suffix, is_person, no_counterparty, normalize_text, unknown_label
from .anchors import BROADCAST_BYTES, names_in
from .detect import booked, has
from .ledger import first_of, ledger, related_signals, with_party
from .names import equivalent, names_in_text, person_in_text

#: Texts that are parts of a statement's print, not of a transaction.
ARTIFACTS = (
    r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", r"\bENDING\s+BALANCE\b", r"\bLEDGER\s+BALANCE\b", r"\bBAKI\s+AKHIR\b", r"\bBAKI\s+LEGAR\b",
    r"\bNOT\s+PROTECTED\s+BY\s+PIDM\b", r"\bPROTECTED\s+BY\s+PIDM\b", r"\bOVERDRAWN\s+BALANCES\b", r"\bPERHATIAN\s*/\s*NOTE\b", r"\bPLEASE\s+NOTIFY\b",
    r"\bSEMUA\s+MAKLUMAT\b", r"\bSTART\s+SUBMITTING\s+YOUR\s+AUDIT\s+CONFIRMATION\s+REPORT\b", r"\bAUDIT\s+CONFIRMATION\s+REPORT\s+REQUEST\b",
    r"\bREQUESTS,\s+PLEASE\s+VISIT\s+OUR\s+WEBSITE\b", r"\bTRANSFER\s+FUNDS\s+OVERSEAS\s+QUICKLY\s+AND\s+EASILY\b", r"\bBUSINESS\s+MOBILE\s+APP\.?\s*ENJOY\b",
    r"\bOCBC\s+FLASH\b", r"\bTHROUGH\s+OCBC\s+VELOCITY\b", r"\bOUR\s+SMES,\s+FOR\s+MORE\s+INFORMATION\b",
    r"\bBUILD\s+YOUR\s+BUSINESS\s+STARTING\s+WITH\s+THE\s+OCBC\s+EBIZ\s+ACCOUNT\b", r"\bECONFIRM\s+PORTAL\b", r"\bSILA\s+HANTAR\s+PERMINTAAN\b",
    r"\bUNTUK\s+BORANG\s+DAN\s+SOALAN\s+LAZIM\b", r"\bYOUR\s+BANKING\s+QUESTIONS\s+ANSWERED\b", r"\bA\s+MEMBER\s+OF\s+OCBC\s+GROUP\b",
    r"\bIF\s+THE\s+PROPERTY\s+OR\s+ASSET\b", r"\bLOCAL\s+CHEQUES\b", r"\bCEK-CEK\s+TEMPATAN\b", r"\bWITH\s+EFFECT\s+FROM\b", r"\bBASE\s+LENDING\s+RATE\b",
    r"\bINSURANCE\s+KADAR\s+PINJAMAN\b", r"\bEFFECTIVE\s+30\s+SEPTEMBER\b", r"\bPROPRIETORSHIP\s+WILL\s+NO\s+LONGER\b", r"\bI-MUAMALAT\.COM\.MY\b",
    r"\bSEGALA\s+BILANGAN\s+DAN\s+BAKI\b", r"\bALL\s+ITEMS\s+AND\s+BALANCES\b", r"\bTOTAL\s+ENDING\s+BALANCE\b", r"\bCURRENT\s+I-MUAMALAT\s+ONLINE\b",
    r"\bANY\s+CHEQUES\s+DEPOSITED\b",
)
#: Fixed value: what a report says of such a text.
ARTIFACT_REASON = "Footer/header text leaked into transaction description"
#: The wider statutory words of the pattern view, which count on either side.
WIDE = {
    "epf": r"\bEPF\b|\bKWSP\b|\bKUMPULAN\s+WANG\s+SIMPANAN\s+PEKERJA\b",
    "socso": r"\bSOCSO\b|\bPERKESO\b|\bEIS\b|\bSIP\b|\bPERTUBUHAN\s+KESELAMATAN\s+SOSIAL\b",
    "lhdn": r"\bLHDN\b|\bLEMBAGA\s+HASIL\s+DALAM\s+NEGERI\b|\bINLAND\s+REVENUE\b|\bTAX\s+PAYMENT\b|\bPCB\b|\bPOTONGAN\s+CUKAI\s+BULANAN\b|\bCUKAI\s+PENDAPATAN\b|\bINCOME\s+TAX\b|\bHASIL\s+DALAM\s+NEGERI\b",
    "hrdf": r"\bHRDF\b|\bPSMB\b|\bPEMBANGUNAN\s+SUMBER\s+MANUSIA\b|\bHUMAN\s+RESOURCE\s+DEVELOPMENT\b|\bHRD\s+CORP(?:ORATION)?\b",
}
NOT_EPF = r"\b(?:SOCSO|PERKESO|EIS|SIP)\b"


def dbl(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def artifact(c: Column) -> Column:
    """whether a description is print, as one alternation."""
    return F.coalesce(c.rlike("(?i)" + "|".join(ARTIFACTS)), F.lit(False))


def artifact_reason(c: Column) -> Column:
    """the reason for a description that is print, empty for any other."""
    return F.when(artifact(normalize_text(c)), ARTIFACT_REASON).otherwise("")


def expand_suffix(c: Column) -> Column:
    """F16: a trailing SDN, SDN B, SDN BH or SB written out."""
    return F.regexp_replace(c, r"(?i)(?<=[A-Za-z)])\s+(?:SDN\.?(?:\s+BH?\.?)?|SB)\s*$", " SDN BHD")


#: Beginnings or whole names that stand for one party.
CANONICAL = (
    (r"^JANM\s+CAWANGAN\b", "JANM"),
    (r"^PLANWORTH\s+GLOBAL(?:\s+(?:FAC|FACTORING))?\s*$", "PLANWORTH GLOBAL"),
)


def canonical_name(c: Column, rules: tuple[tuple[str, str], ...] = CANONICAL) -> Column:
    """F16: the name of the first rule that fits, else the trimmed name with its legal form written out; null and empty stay."""
    s = F.trim(c)
    named = F.coalesce(*(F.when(s.rlike(f"(?i){p}"), name) for p, name in rules)) if rules else F.lit(None).cast("string")
    return F.coalesce(named, expand_suffix(s))


def statutory_patterns(tx: DataFrame) -> DataFrame:
    """Rows and amounts of the four wide detectors, the debit or else the credit; EPF without SOCSO words."""
    amount = F.when(F.col("debit") > 0, F.col("debit")).otherwise(F.col("credit"))
    hit = {k: has(p) & (~has(NOT_EPF) if k == "epf" else F.lit(True)) for k, p in WIDE.items()}
    one = tx.agg(*(x for k, h in hit.items() for x in (F.count_if(h).alias(f"n_{k}"), F.coalesce(dbl(F.sum(F.when(h, amount))), F.lit(0.0)).alias(f"a_{k}"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.col(f"a_{k}").alias("amount")) for k in WIDE))).alias("r")).select("r.*")


def gross_debits(tx: DataFrame) -> DataFrame:
    """A32."""
    return tx.agg(dbl(F.coalesce(F.sum("debit"), F.lit(0))).alias("gross_debits"))


def party_groups(tx: DataFrame, own: DataFrame, related: DataFrame) -> DataFrame:
    """Sums of own, related and other parties; ``name`` stands in party or text, the lists may be of any size (``names_in``)."""
    listed = own.select(F.upper("name").alias("name"), F.lit("own").alias("kind"), F.lit(1).alias("rank")).unionByName(related.select(F.upper("name").alias("name"), F.lit("related").alias("kind"), F.lit(2).alias("rank")))
    rows = with_party(tx)
    found = names_in(rows, listed, "row_order", F.concat_ws(" ", "party", "description"))
    hits = found.join(listed, "name")
    kind = hits.groupBy("row_order").agg(F.min_by("kind", F.struct("rank", -F.length("name"), "name")).alias("kind"), F.min_by("name", F.struct("rank", -F.length("name"), "name")).alias("listed"))
    return rows.join(kind, "row_order", "left").groupBy(F.coalesce("kind", F.lit("other")).alias("kind"), F.coalesce("listed", F.lit("")).alias("listed")).agg(F.count("*").alias("n"), dbl(F.sum("credit")).alias("credits"), dbl(F.sum("debit")).alias("debits"))


def align_to_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Parties under the longest target whose words, three letters or more, all stand in them; sums per target."""
    small = targets.count() * 128 <= BROADCAST_BYTES  # beyond that size Spark chooses the join
    hit = rows.join(F.broadcast(targets) if small else targets, names_in_text(F.col("target"), F.col("party")), "left")
    w = Window.partitionBy("party").orderBy(F.desc(F.size(F.split(F.coalesce("target", F.lit("")), " "))), F.desc(F.length("target")), "target")
    best = hit.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return best.groupBy(F.coalesce("target", "party").alias("party")).agg(F.sum("n").alias("n"), F.round(F.sum("credits"), 2).alias("credits"), F.round(F.sum("debits"), 2).alias("debits"))


def top_party_view(tx: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """``(side, rank, party, amount)``: the ledger's parties under their targets, without labels that name nobody, by
    the sum of each side, ties by name. The first ``k`` of a side are taken by partial sorts before they are ranked.
    """
    rows = align_to_targets(ledger(tx).select("party", "n", "credits", "debits"), targets)
    named = rows.where(~unknown_label(F.col("party")) & ~no_counterparty(F.col("party")) & ~has(r"\bBILL\b|\bCHARGE", "party"))
    side = lambda s, c: named.where(F.col(c) > 0).orderBy(F.desc(c), "party").limit(k).select(F.lit(s).alias("side"), "party", F.col(c).alias("amount"))
    both = side("payer", "credits").unionByName(side("payee", "debits"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("amount"), "party")).cast("bigint"))


def candidates(tx: DataFrame, excluded: DataFrame) -> DataFrame:
    """Signalled parties without companies, labels and listed names, strongest first."""
    s = related_signals(tx).where((F.col("score") > 0) & ~unknown_label(F.col("party")) & (~has_corporate_suffix(F.col("party")) | is_person(F.col("party"))))
    rank = F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2)
    return s.join(excluded, "party", "left_anti").orderBy(rank, F.desc("debits"), "party")


def keyword_people(tx: DataFrame) -> DataFrame:
    """Persons named in texts with a personal keyword, their debits, one row for each distinct transaction."""
    hit = tx.where(has(r"\bADVANCE\b|\bPERSONAL\b|\bDIRECTOR\b|\bALLOWANCE\b|\bCLAIM\b")).withColumn("person", person_in_text(F.col("description"))).where("person is not null")
    valid = ~has_corporate_suffix(F.col("person")) & is_person(F.col("person"))
    distinct = first_of(hit.where(valid), "account_no", "dt", "description", "amount", "side")
    return distinct.groupBy("person").agg(F.count("*").alias("n"), dbl(F.sum("debit")).alias("debits"), dbl(F.sum("credit")).alias("credits"))


def display_names(names: DataFrame) -> DataFrame:
    """Of equivalent names of a report the first by order, ``(report, name, place)``.

    A report's display list is short; its distinct names are compared in one task per report.
    """
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[str] = []
        for n in pdf.sort_values(["place", "name"])["name"]:
            if not any(equivalent(n, x) for x in out):
                out.append(n)
        return pd.DataFrame({"report": pdf["report"].iloc[0], "name": out})

    firsts = names.where("name is not null").groupBy("report", "name").agg(F.min("place").alias("place"))
    return firsts.groupBy("report").applyInPandas(keep, "report string, name string")


def sync_flags(flags: DataFrame, round_n: int, round_amount: float, large_n: int, large_amount: float) -> DataFrame:
    """Flags 3 and 9 set again from the report's own tables."""
    new = {3: (round_n, f"{round_n} round-figure credits totalling RM {round_amount:,.2f}."), 9: (large_n, f"{large_n} large credits totalling RM {large_amount:,.2f}.")}
    d, r = F.col("detected"), F.col("remarks")
    for k, (n, text) in new.items():
        d, r = F.when(F.col("id") == k, F.lit(n > 0)).otherwise(d), F.when(F.col("id") == k, F.lit(text)).otherwise(r)
    return flags.select("id", "name", d.alias("detected"), r.alias("remarks"))


def company_choice(headers: DataFrame) -> DataFrame:
    """A file's company: in the fewest descriptions, then most frequent, then longest, ``(file, name, in_text)``."""
    agg = headers.groupBy("file", "name").agg(F.sum(F.col("in_text").cast("int")).alias("texts"), F.count("*").alias("n"))
    return agg.groupBy("file").agg(F.min_by("name", F.struct("texts", -F.col("n"), -F.length("name"), "name")).alias("company"))


def assembly(parts: dict[str, DataFrame]) -> DataFrame:
    """The sections of a report with their row counts, in order; sections stay relations until they are written."""
    out = None
    for k, (name, df) in enumerate(parts.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("place"), F.lit(name).alias("section"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def loan_lists(classified: DataFrame) -> DataFrame:
    """Disbursements and repayments as rows."""
    return booked(classified).where(F.col("primary").isin("C10", "C11")).select("row_order", F.when(F.col("primary") == "C10", "disbursement").otherwise("repayment").alias("kind"), dbl(F.greatest("credit", "debit")).alias("amount"))


def flexible(c_name: str, *others: str) -> Column:
    """The first of several columns that reads as a number."""
    return F.coalesce(*(F.col(x).try_cast("double") for x in (c_name, *others)), F.lit(0.0))

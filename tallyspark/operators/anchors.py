"""Names that share a beginning, a run of words or a spelling (E02, E04, M5, M7), and many names sought in texts.

Names that belong together meet under a key that each of them can tell by itself, and a group is reduced by partial
aggregates: no list of pairs is made. Null names are left out, an empty table gives no rows, equal names count once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import NAMELESS, PERSON_MARKERS

c = F.col

# Fixed values, from here to the next comment: legal forms, given names, words before and after a name without a marker.
LEGAL_FORMS = ("BHD", "BERHAD", "PLT", "LLP")
NOBODY = ("", "UNKNOWN")
GIVEN_NAMES = (
    "MOHD", "MOHAMAD", "MOHAMED", "MOHAMMAD", "MUHAMMAD", "MUHAMAD", "MAT", "AHMAD", "ABDUL", "ABD", "NUR", "NURUL", "NOOR", "NOR", "SITI", "WAN", "TENGKU", "SYED", "SHARIFAH", "NIK", "CHE", "KU",
    "FATIN", "FARAH", "AINA", "AISYAH", "AIMAN",
)
MARRIED_MARKERS = ("BINTI", "BINTE", "BIN", "BI", "A/L", "A/P")
HONORIFICS = ("CIK", "PUAN", "ENCIK", "EN", "TUAN", "MS", "MR", "MRS", "DR", "HJ", "HJH", "HAJI", "MISS", "MADAM", "TUN", "DATO", "DATUK", "DATIN")
LEADING = (
    "EXPENSES", "ALLOWANCE", "TRIP", "PUMP", "MRC", "SAMB", "REPAYMENT", "POSLAJU", "BALANCE", "SUBCON", "ADVANCE", "INTERN", "PETTYCASH", "REIMBURSMT", "WAGES", "OT", "EXPENSE", "TRANSPORT", "RENTAL",
    "RENT", "COMMISSION", "INCENTIVE", "BONUS",
)
MEMO = (
    "REIMBURSE", "CLAIM", "PETTY", "ADV", "ADDITIONAL", "HIRE", "PURCHASE", "TECHNICAL", "SERVICE", "EMAIL", "DCSE", "FLIGHT", "HOTEL", "MOB", "FUEL", "INV", "STARTUP", "WALLET", "PROJECT", "MANAGER",
    "MEDICAL", "OFFSHORE", "ADMINISTRATION", "INTERN", "HOMESTAY", "PARKING", "PARKRITE", "TOUCH", "DINNER", "MEETIN", "MEETING", "CLIENT", "TRAVELLING", "FINAL", "QAQC", "CHECKER", "PEST", "CONTROL",
    "WATCHES", "BIL", "BILL", "EXTEND", "LOAN", "ELECTRIC", "PANTRY", "CAR", "NO", "OPENING", "BANK", "REFUND", "CASH", "ABZ", "FUND",
)
TRAILING_BANKS = ("MBB", "MAYB", "CIMB", "BIMB", "RHB", "PBB", "HLB", "HLBB", "UOB", "OCBC", "BSN", "AMFB", "AMBB", "AFFIN", "AGRO", "BKRM", "KFH", "MBSB", "BMMB")
DISTINCTIVE = 6
# End of the fixed values.

#: Letters of the pieces by which names are sought in texts; largest estimated size of a list that is sent to every task.
GRAM, BROADCAST_BYTES = 4, 16 << 20


def _tidy(names: DataFrame, name: str) -> DataFrame:
    return names.where(c(name).isNotNull()).select(F.upper(F.trim(F.regexp_replace(name, r"\s+", " "))).alias("name")).distinct()


def _order(name: Column, *more: Column) -> Column:
    """Names by words, length and letters."""
    return F.struct(F.size(F.split(name, " ")).alias("words"), F.length(name).alias("n"), name.alias("name"), *more)


def legal(name: Column) -> Column:
    """M7: the name up to its legal form, written out; null without one."""
    sdn = F.regexp_extract(name, r"^(\S.*? SDN)(?: |$)", 1)
    other = [F.when(F.regexp_extract(name, rf"^(\S.*?) {f}(?: |$)", 1) != "", F.concat(F.regexp_extract(name, rf"^(\S.*?) {f}(?: |$)", 1), F.lit(f" {'BHD' if f == 'BERHAD' else f}"))) for f in LEGAL_FORMS]
    return F.coalesce(F.when(sdn != "", F.concat(sdn, F.lit(" BHD"))), *other)


def front_aliases(names: DataFrame, name: str = "name", sizes: tuple[int, ...] = (3, 2)) -> DataFrame:
    """``(name, alias)``: names with the same first three words, then first two, become one.

    A group of two names or more takes its shortest name with a legal form, else the words that it shares. Names with a
    parentage marker, shorter ones and those that name nobody stay; what three words made is what two words see.
    """
    now = _tidy(names, name).withColumn("alias", c("name"))
    for size in sizes:
        words = F.split("alias", " ")
        able = now.select("alias").distinct().where(~c("alias").isin(*NOBODY) & (F.size(words) >= size) & ~F.exists(words, lambda w: F.btrim(w, F.lit(" .,-")).isin(*sorted(PERSON_MARKERS))))
        keyed = able.withColumn("front", F.array_join(F.slice(words, 1, size), " ")).withColumn("form", F.exists(words, lambda w: w.isin(*LEGAL_FORMS)))
        groups = keyed.groupBy("front").agg(F.count("*").alias("n"), F.min(F.when(c("form"), _order(c("alias"))))["name"].alias("best")).where("n > 1")
        made = keyed.join(groups, "front").select(c("alias").alias("old"), F.coalesce("best", "front").alias("new"))
        now = now.join(made, c("alias") == c("old"), "left").select("name", F.coalesce("new", "alias").alias("alias"))
    return now


def shared_runs(names: DataFrame, name: str = "name", least: int = 2) -> DataFrame:
    """M5/M7: ``(name, run, alias)``: each name's longest run of words that carry a name and that another name holds too.

    Runs of ``least`` words or more count, of equally long ones that with more letters, then the first by letters. All runs
    of a name are keys, so two names meet under every run that they share. The alias of a run is the shortest legal entity
    that holds it among the names that do, else the run itself; names without such a run are not returned.
    """
    carrying = F.filter(F.split("name", " "), lambda w: (w != "") & ~w.isin(*sorted(NAMELESS)) & ~w.rlike(r"^\d+$"))
    rows = _tidy(names, name).withColumn("w", carrying).where(F.size("w") >= least)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - least + 1), lambda s: F.transform(F.sequence(F.lit(least), F.size("w") - s + 1), lambda n: F.array_join(F.slice(c("w"), s, n), " "))))
    runs = rows.select("name", F.explode(F.array_distinct(spans)).alias("run"))
    whole = F.concat(F.lit(" "), legal(c("name")), F.lit(" "))
    entity = F.when(F.contains(whole, F.concat(F.lit(" "), c("run"), F.lit(" "))), legal(c("name")))
    shared = runs.groupBy("run").agg(F.count("*").alias("n"), F.min(F.when(entity.isNotNull(), _order(entity)))["name"].alias("entity")).where("n > 1").select("run", F.coalesce("entity", "run").alias("alias"))
    best = F.struct(F.size(F.split("run", " ")).alias("words"), F.length(F.replace("run", F.lit(" "), F.lit(""))).alias("n"))
    held = runs.join(shared, "run").withColumn("size", best)
    top = held.groupBy("name").agg(F.max("size").alias("top")).withColumnRenamed("name", "t_name")
    return held.join(top, (c("name") == c("t_name")) & (c("size") == c("top"))).groupBy("name").agg(F.min(F.struct("run", "alias")).alias("b")).select("name", "b.run", "b.alias")


def markerless_run(name: Column) -> Column:
    """The words of a name without a parentage marker from its first given name on, memo and bank words off its end.

    Null unless all words before are honorifics or memo, and one of at least six letters that is no given name stands in it.
    """
    words = F.split(name, " ")
    memo = lambda w: w.isin(*MEMO) | w.rlike(r"\d") | w.rlike(r"^(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\w*$")
    at = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w.isin(*GIVEN_NAMES), i + 1)), lambda i: i.isNotNull()))
    lead = F.forall(F.slice(words, F.lit(1), at - 1), lambda w: memo(w) | w.isin(*HONORIFICS) | w.isin(*LEADING))
    run = F.slice(words, at, F.size(words))
    last = F.array_max(F.transform(run, lambda w, i: F.when((i == 0) | ~(memo(w) | w.isin(*TRAILING_BANKS)), i + 1).otherwise(0)))
    cut = F.slice(run, F.lit(1), last)
    own = F.exists(cut, lambda w: (F.length(w) >= DISTINCTIVE) & ~memo(w) & ~w.isin(*GIVEN_NAMES))
    plain = ~F.exists(words, lambda w: w.isin(*MARRIED_MARKERS)) & ~F.exists(words, lambda w: w.isin(*LEGAL_FORMS, "SDN")) & ~F.contains(name, F.lit("(POSSIBLY MULTIPLE PARTIES)"))
    return F.when(at.isNotNull() & plain & lead & own, cut)


def compatible_runs(a: list[str], b: list[str]) -> bool:
    """Equal but for a last word cut short, or one the other's beginning word for word."""
    if len(a) == len(b):
        return a[:-1] == b[:-1] and (a[-1].startswith(b[-1]) or b[-1].startswith(a[-1]))
    return all(x == y for x, y in zip(a, b, strict=False))


def clustered(runs: list[list[str]]) -> list[list[str]]:
    """For each run its cluster's name: runs by words, letters and text join the first cluster whose members all fit."""
    clusters: list[list[list[str]]] = []
    for run in sorted(map(list, {tuple(r) for r in runs}), key=lambda r: (len(r), sum(map(len, r)), r)):
        home = next((k for k in clusters if all(compatible_runs(run, m) for m in k)), None)
        if home is None:
            clusters.append([run])
        else:
            home.append(run)
    named = {tuple(m): max(k, key=lambda r: (len(r), sum(map(len, r)))) for k in clusters for m in k}
    return [named[tuple(r)] for r in runs]


def markerless_aliases(names: DataFrame, name: str = "name") -> DataFrame:
    """``(name, alias)`` of names without a parentage marker that are spellings of one person.

    Two runs that fit have their first word and the first six letters of their second in common (one of two words is
    distinctive, and in longer ones the second is equal), so they meet under those; a task clusters the distinct runs of one
    such spelling. Names without a run, or alone in their cluster, are not returned.
    """
    runs = _tidy(names, name).withColumn("run", markerless_run(c("name"))).where("run IS NOT NULL")
    key = F.concat_ws(" ", c("run")[0], F.substring(F.coalesce(F.get("run", F.lit(1)), F.lit("")), 1, DISTINCTIVE))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        split = [t.split(" ") for t in pdf["run"]]
        return pd.DataFrame({"run": pdf["run"], "alias": [" ".join(r) for r in clustered(split)]})

    distinct = runs.select(F.array_join("run", " ").alias("run"), key.alias("key")).distinct()
    made = distinct.groupBy("key").applyInPandas(cluster, "run string, alias string")
    out = runs.select("name", F.array_join("run", " ").alias("run")).join(made, "run")
    many = out.groupBy(c("alias").alias("m_alias")).agg(F.count("*").alias("n")).where("n > 1")
    return out.join(many, c("alias") == c("m_alias"), "left_semi").select("name", "alias")


def names_in(rows: DataFrame, names: DataFrame, key: str, text: Column, name: str = "name") -> DataFrame:
    """``(key, name)`` for every listed name that stands anywhere in a row's text, in upper case; a list of any size.

    Each name is kept under its rarest piece of four letters (a shorter one under itself); texts are cut into the pieces of
    the lengths that occur, and only names under a piece of the text are tried. The list is broadcast below a counted size,
    else both sides are shuffled by piece. Null and empty names and null texts match nothing.
    """
    listed = names.select(F.upper(name).alias("name")).where("name <> ''").distinct()
    piece = lambda t, q: F.transform(F.sequence(F.lit(1), F.length(t) - q + 1), lambda i: F.substring(t, i, F.lit(q)))
    pieces = listed.select("name", F.explode(F.when(F.length("name") < GRAM, F.array("name")).otherwise(piece(c("name"), GRAM))).alias("piece")).distinct()
    common = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    index = pieces.join(common, "piece").groupBy("name").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    facts = index.agg(F.count("*").alias("n"), F.collect_set(F.length("piece")).alias("sizes")).first()
    if not facts.n:
        return rows.select(key, F.lit("").alias("name")).where("false")
    index = F.broadcast(index) if facts.n * 128 <= BROADCAST_BYTES else index
    slim = rows.select(key, F.upper(text).alias("t_"))
    every = F.concat(*(F.when(F.length("t_") >= q, piece(c("t_"), q)).otherwise(F.expr("cast(array() as array<string>)")) for q in sorted(facts.sizes)))
    tried = slim.select(key, "t_", F.explode(F.array_distinct(every)).alias("piece")).join(index, "piece")
    return tried.where(F.contains("t_", c("name"))).select(key, "name")

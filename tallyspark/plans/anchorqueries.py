"""Queries of shared beginnings, runs and spellings of names, many names sought in texts, and returns around holidays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import anchors as A
from ..operators import ledger as L
from ..operators import names as N
from . import sqltext as T
from .fixtures import RETURNS, STATEMENT, sql, statement, statement_returns

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, text: str | None = None) -> None:
    QUERIES[name] = fn
    if text:
        SQL[name] = text


WORDS = (("ALPHA", "BRAVO", "CHARLIE", "DELTA", "ECHO", "FOXTROT", "GOLF"), ("WORKS", "METAL", "FOODS", "GLASS", "PAPER"), ("NORTH", "SOUTH", "BIN", "55", "BANK"), ("", " SDN BHD", " TRADING", " HOLDINGS BERHAD", " MBB", " SDN B"))
_pick = lambda words, n: f"(CASE c_custkey % {n} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words)) + " END)"
NAMES = f"SELECT DISTINCT CASE WHEN c_custkey % 11 = 0 THEN 'ACE ' ELSE '' END || {_pick(WORDS[0], 7)} || ' ' || {_pick(WORDS[1], 5)} || CASE WHEN c_custkey % 9 < 7 THEN ' ' || (CASE CAST(floor(c_custkey / 5) AS INT) % 5 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORDS[2])) + " END) ELSE '' END || (CASE CAST(floor(c_custkey / 3) AS INT) % 6 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORDS[3])) + " END) AS name FROM {customer}"


def names(s, d) -> DataFrame:
    return s.sql(NAMES, customer=s.read.parquet(f"{d}/customer.parquet"))


_names = NAMES.replace("{customer}", "customer")
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def _front(size: int, source: str) -> str:
    return f"""k{size} AS (SELECT DISTINCT alias, string_split(alias, ' ') AS w FROM {source} WHERE alias NOT IN ('', 'UNKNOWN') AND len(string_split(alias, ' ')) >= {size} AND NOT list_has_any(string_split(alias, ' '), {_list(A.PERSON_MARKERS)})),
 g{size} AS (SELECT array_to_string(w[1:{size}], ' ') AS front, coalesce(arg_min(alias, (len(w), length(alias), alias)) FILTER (list_has_any(w, {_list(A.LEGAL_FORMS)})), array_to_string(w[1:{size}], ' ')) AS best FROM k{size} GROUP BY 1 HAVING count(*) > 1),
 a{size} AS (SELECT s.name, coalesce(g.best, s.alias) AS alias FROM {source} s LEFT JOIN k{size} k ON k.alias = s.alias LEFT JOIN g{size} g ON g.front = array_to_string(k.w[1:{size}], ' '))"""


add("E02_M7_front_aliases", lambda s, d: A.front_aliases(names(s, d)), f"WITH a0 AS (SELECT name, name AS alias FROM ({_names})), {_front(3, 'a0')}, {_front(2, 'a3')} SELECT name, alias FROM a2")
_entity = "CASE WHEN regexp_matches(name, '^\\S.* SDN( |$)') THEN regexp_extract(name, '^(\\S.*?) SDN(?: |$)', 1) || ' SDN BHD' WHEN regexp_matches(name, '^\\S.* (BHD|BERHAD)( |$)') THEN regexp_extract(name, '^(\\S.*?) (?:BHD|BERHAD)(?: |$)', 1) || ' BHD' END"
add(
    "M5_M7_shared_runs",
    lambda s, d: A.shared_runs(names(s, d)),
    f"""WITH n AS (SELECT name, list_filter(string_split(name, ' '), lambda x: NOT list_contains({_list(A.NAMELESS)}, x) AND NOT regexp_full_match(x, '\\d+')) AS w, {_entity} AS entity FROM ({_names})),
 r AS (SELECT DISTINCT name, entity, array_to_string(w[i:j], ' ') AS run, j - i + 1 AS size FROM n, range(1, 9) a(i), range(2, 10) b(j) WHERE j > i AND j <= len(w)),
 s AS (SELECT run, coalesce(arg_min(entity, (len(string_split(entity, ' ')), length(entity), entity)) FILTER (contains(' ' || entity || ' ', ' ' || run || ' ')), run) AS alias FROM r GROUP BY run HAVING count(*) > 1)
 SELECT name, run, alias FROM r JOIN s USING (run) QUALIFY row_number() OVER (PARTITION BY name ORDER BY size DESC, length(replace(run, ' ', '')) DESC, run) = 1""",
)


def people(s, d) -> DataFrame:
    """Names without markers, cut short, drawn out, behind memo and before bank codes."""
    k = c("c_custkey")
    pick = lambda n, *w: F.element_at(F.array(*map(F.lit, w)), (n % len(w) + 1).cast("int"))
    name = F.concat(pick(k, "", "TRIP ALLOWANCE ", "CIK ", "", "INTAN "), pick(F.floor(k / 3), "MOHD", "SITI", "MUHAMMAD"), F.lit(" "), pick(F.floor(k / 7), "KHAWAZATUL", "KHAWAZ", "NURAFIFAH", "DANIAL", "FARHANA"), pick(F.floor(k / 11), "", " FAEZ", " FA", " HANIM", " HAN", " BIN ALI"), pick(k, "", " MBB", " 123", "", " CLAIM", "", " SDN BHD"))
    return s.read.parquet(f"{d}/customer.parquet").select(name.alias("name"))


add("E04_markerless_aliases", lambda s, d: A.markerless_aliases(people(s, d)))


def listed(s, d) -> DataFrame:
    """A name for each customer, and some that stand in many texts."""
    made = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("supplier "), (c("c_custkey") % 60).cast("string"), F.when(c("c_custkey") % 3 == 0, " sdn").otherwise("")).alias("name"))
    return made.unionByName(s.createDataFrame([("EPF",), ("ALA",), ("X",), ("CHQ D",)], "name string")).distinct()


add("J10_many_names", lambda s, d: A.names_in(statement(s, d), listed(s, d), "row_order", c("description")).select("row_order", "name"), sql("SELECT row_order, name FROM st, (SELECT DISTINCT upper(name) AS name FROM (SELECT 'supplier ' || c_custkey % 60 || CASE WHEN c_custkey % 3 = 0 THEN ' sdn' ELSE '' END AS name FROM customer UNION ALL VALUES ('EPF'), ('ALA'), ('X'), ('CHQ D'))) WHERE contains(upper(description), name)"))
add("E03_M7_merge_by_rank", lambda s, d: N.merge_rounds(names(s, d), choose=N.by_rank))

#: Every day of a month that three divides, and the first of May, are holidays of the fixture.
_free = "dt IS NOT NULL AND (day(dt) % 3 = 0 OR (day(dt) = 1 AND month(dt) = 5))"
add(
    "J07_holidays",
    lambda s, d: L.return_candidates(statement_returns(s, d), statement_returns(s, d).where(_free).select(c("dt").alias("day"))).select("dr", "cr", "days"),
    sql(
        f"""SELECT o.row_order AS dr, i.row_order AS cr, CAST((SELECT count(*) FROM range(CAST(0 AS BIGINT), CAST(i.dt - o.dt AS BIGINT)) g(k) WHERE isodow(o.dt + CAST(g.k + 1 AS INT)) < 6 AND o.dt + CAST(g.k + 1 AS INT) NOT IN (SELECT dt FROM free)) AS BIGINT) AS days
 FROM statement_returns o JOIN statement_returns i ON i.account_no = o.account_no AND i.credit > 0 AND o.debit > 0 AND abs(round(i.credit * 100) - round(o.debit * 100)) <= 1 AND i.dt >= o.dt AND i.dt <= o.dt + 60
 WHERE {T.has(R.OUTWARD_TRANSFER, 'o.description')} AND NOT {T.has(R.RETURN_WORDS, 'o.description')} AND days <= {R.PAIR_DAYS}""",
        STATEMENT,
        RETURNS,
        more=f"free AS (SELECT DISTINCT dt FROM statement_returns WHERE {_free})",
    ),
)

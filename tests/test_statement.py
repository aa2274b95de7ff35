import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalar as S
from tallyspark.operators import detect as D
from tallyspark.operators import ledger as L
from tallyspark.operators import monthly as M
from tallyspark.operators import names as N
from tallyspark.operators import report as P
from tallyspark.plans import fixtures, registry
from tallyspark.sources import statements as Z

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf, name):
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*(f"`{x}`" for x in cols)).collect()]
    other = [tuple(map(plain, r)) for r in want.select(", ".join(f'"{x}"' for x in cols)).fetchall()]
    key = lambda r: tuple("" if v is None else v for v in r)
    assert sorted(rows, key=key) == sorted(other, key=key)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_literal_amounts_and_names(spark):
    for text, want in (("(1,234.56)", -1234.56), ("123.45-", -123.45), ("RM 5", 5.0), ("abc", 0.0), (None, 0.0), ("7+", 7.0)):
        assert one(spark, text, S.to_amount) == want
    for text in ("ABC SDN B", "ABC SB"):
        assert one(spark, text, S.company_suffix) == "ABC SDN BHD"
    assert one(spark, "JOMPAY 12345", S.bill_code_only) and not one(spark, "JOMPAY SYABAS 1", S.bill_code_only)
    assert one(spark, "a  b", S.normalize_text) == "a b"
    days = spark.createDataFrame([(dt.date(2024, 1, 5), dt.date(2024, 1, 8))], "a date, b date").select(S.business_days(F.col("a"), F.col("b")).alias("n")).first().n
    assert days == 1


def test_dates_with_and_without_a_year(spark):
    cases = [("2024-02-29", "2024-02-29"), ("5/3/2024", "2024-03-05"), ("05-03-24", "2024-03-05"), ("1/1/69", "1969-01-01"), ("1/1/68", "2068-01-01"), ("7 mar 2023", "2023-03-07"), ("7 MAR 23", "2023-03-07"), ("7-Mar-23", "2023-03-07"), ("31/2/2024", None), ("n/a", None), (None, None), ("5/3", None), ("5 Mar", None), ("5-3", None)]
    df = spark.createDataFrame(cases, "x string, y string")
    assert [(r.a, r.y) for r in df.select(S.to_date(F.col("x")).cast("string").alias("a"), "y").collect() if r.a != r.y] == []
    short = spark.createDataFrame([("5/3",), ("5 Mar",), ("05-3",), ("5/13",)], "x string")
    assert [str(r.a) for r in short.select(S.to_date(F.col("x"), 2021).alias("a")).collect()] == ["2021-03-05"] * 3 + ["None"]


def test_name_rules():
    assert N.shared_three("ONE TWO THREE SDN BHD", "ONE TWO THREE CASH") and not N.shared_three("ONE TWO THREE", "ONE TWO FOUR") and not N.shared_three("ONE TWO", "ONE TWO")
    assert N.contained("ALI AHMAD", "ALI AHMAD BIN ABU") and not N.contained("ALPHA WORKS", "ALPHA WORKS NORTH GATE") and not N.contained("ALPHA", "ALPHA CASH")
    assert N.legal_entity("ALPHA WORKS SDN B 12") == "ALPHA WORKS SDN BHD" and N.legal_entity("ALPHA BERHAD X") == "ALPHA BHD" and N.legal_entity("SDN X") == "" and N.legal_entity("ALPHA") == ""
    assert N.canonical(["ALPHA WORKS CASH", "ALPHA WORKS SDN BHD X", "ALPHA WORKS"], ["ALPHA", "WORKS"]) == "ALPHA WORKS SDN BHD"
    assert N.canonical(["ALPHA WORKS CASH", "B ALPHA WORKS"], ["ALPHA", "WORKS"]) == "ALPHA WORKS"


def test_aliases_equal_the_unblocked_map(spark):
    """Names of one word that begin differently, cut last words, parentage, shared words, prefixes: as over all names at once."""
    import random

    draw = random.Random(4)
    stems = ["ALPHA HARDWARE TRADING SDN BHD", "ALPHAHARDWARETRADINGCOMPANY", "BETA WORKS", "AHMAD BIN ABDULLAH", "SITI BINTI OMAR ZAKI", "GREEN FIELD SUPPLIES", "ONE TWO THREE", "UNITEDSUPPLIERSENTERPRISE"]
    listed = ["BLPHAHARDWARETRADINGCOMPANY", "ALPHA HARDWARETRADINGCOMPANY", "UNITEDSUPPLIERSENTERPRISES", "AL WORKS", "ALPHA WORKS CASH", "", "X", "ONE TWO THREE LOAN", "BE WORKS SDN BHD"]
    for _ in range(160):
        t = list(draw.choice(stems))
        for _ in range(draw.randrange(3)):
            k = draw.randrange(len(t))
            t[k : k + 1] = draw.choice([[], [t[k], "S"], ["E"], [" "]])
        listed.append(" ".join("".join(t).split()))
    counts = {n: listed.count(n) for n in listed}
    df = spark.createDataFrame([(n,) for n in listed], "name string")
    for rules in ((N.similar,), N.RULES):
        got = {r.name: r.alias for r in N.aliases(df, rules=rules).collect()}
        assert got == N.alias_map(counts, rules)
    assert N.similar("ALPHAHARDWARETRADINGCOMPANY", "BLPHAHARDWARETRADINGCOMPANY")


def test_risk_sheet_of_one_row(spark):
    from tallyspark.operators import flags as G

    row = {n: 0.0 for n in G.SUMS} | {"gross_credits": 200.0, "gross_debits": 100.0, "own_credits": 50.0, "cash_amount": 20.0, "salary_months": 2, "epf_pct": 99.6, "socso_pct": 50.0, "tax_months": 3, "hrdf_months": 0, "gap_months": 0}
    row |= {n: 0 for n in G.SUMS if n.endswith("_count")} | {"cash_count": 4, "tax_amount": 1234.5}
    low = spark.createDataFrame([("2024-01, 2024-02",)], "low_list string")
    got = {r.id: (r.signal, r.remarks) for r in P.risk_sheet(spark.createDataFrame([row]), low).collect()}
    assert len(got) == 16 and sum(s == "YES" for s, _ in got.values()) == 4
    assert got[5] == ("YES", "4 cash deposits totalling RM 20.00 (10.0% of gross credits).")
    assert got[6] == ("NO", "EPF coverage 99.6% across salary months.") and got[7][0] == "YES"
    assert got[8] == ("NO", "LHDN payments detected: 3 tx totalling RM 1,234.50 (PCB/CP204/SST — schedules differ; informational only).")
    assert got[10] == ("YES", "Own-party CR RM 50.00 (25.0% of gross credits); DR RM 0.00 (0.0% of gross debits).")
    assert got[15] == ("YES", "Closing balance below RM 1,000.00 in: 2024-01, 2024-02.")


CASES = [
    ("OPENING BALANCE", "DR", "C25"), ("STAFF SALARY JAN", "DR", "C05"), ("STAFF SALARY JAN", "CR", None), ("SALARY COMMISSION", "DR", None), ("INTERNET PAYMENT", "DR", None),
    ("KWSP/123", "DR", "C06"), ("KWSPX", "DR", None), ("RETURN CHQ", "DR", "C14"), ("RETURN CHQ", "CR", "C15"), ("LOAN REPAYMENT SERVICE TAX 8%", "DR", "C24"), ("FACTORING ACME", "CR", "C10"),
    ("CDM CASH DEPOSIT", "CR", "C17"), ("IBG INWARD RETURN", "CR", "C16"), ("ABC SDN BHD", "CR", "C26"), ("ABC SDN BHD", "DR", "C27"), ("GAJIJAN23", "DR", "C05"),
]


def test_ladder(spark):
    rows = [(k, d, 5.0 if s == "CR" else 0.0, 0.0 if s == "CR" else 5.0, d) for k, (d, s, _) in enumerate(CASES)]
    got = {r.k: r.primary for r in D.classify(spark.createDataFrame(rows, "k int, description string, credit double, debit double, party string")).collect()}
    assert [got[k] for k in range(len(CASES))] == [c for _, _, c in CASES]


def test_fx(spark):
    df = spark.createDataFrame([("DUITNOW USD 1,000",), ("FOREX USD 1,000",), ("USD 5",), (None,)], "description string").select(D.fx_text().alias("f"))
    assert [r.f for r in df.collect()] == [False, True, True, False]


def test_runs_above_the_band(spark):
    above, ok = 0.5, 0.13
    months = [(f"2024-{k:02d}", 100.0, 100.0 * r, 2.0, 0.0, 0.0) for k, r in enumerate([ok, above, above, above, above, ok, above], 1)]
    df = spark.createDataFrame(months, "month string, salary double, epf double, socso double, tax double, hrdf double")
    got = [r.status for r in M.contribution_ratios(df).where("fund = 'EPF'").orderBy("month").collect()]
    assert got == ["OK", *["STRUCTURAL"] * 4, "OK", "CATCH_UP"]


def test_pairing_is_one_to_one_and_earliest(spark, sf):
    tx = fixtures.statement_returns(spark, "/root/testdata/sf0.01")
    pairs = L.pair_returns(tx).collect()
    cands = L.return_candidates(tx).collect()
    assert pairs and len({p.dr for p in pairs}) == len({p.cr for p in pairs}) == len(pairs)
    used, taken, want = set(), set(), set()
    for c in sorted(cands, key=lambda c: (c.account_no, c.dr_dt, c.dr, c.cr_dt, c.cr)):
        if c.dr not in taken and c.cr not in used:
            taken.add(c.dr)
            used.add(c.cr)
            want.add((c.dr, c.cr))
    assert {(p.dr, p.cr) for p in pairs} == want


def test_dedupe_is_idempotent_and_conserves(spark, sf):
    tx = fixtures.statement(spark, sf)
    once = L.dedupe(tx.unionByName(tx))
    assert once.count() == L.dedupe(once).count() == L.with_fingerprint(tx).select("fp").distinct().count()
    total = tx.agg(F.sum("credit"), F.sum("debit")).first()
    assert L.ledger(tx).agg(F.sum("credits"), F.sum("debits")).first() == pytest.approx(tuple(map(float, total)))


def test_order_of_partitions_does_not_matter(spark, sf):
    tx = fixtures.statement(spark, sf)
    a, b = (sorted(map(str, M.monthly(t).collect())) for t in (tx, tx.repartition(13, F.rand(3))))
    assert a == b


def test_names():
    assert N.similar("ALPHA HARDWARE", "ALPHA HARDWAR") and not N.similar("ALPHA HARDWARE", "BETA HARDWARE")
    assert N.equivalent("ALI BIN ABU", "ALI ABU") and not N.equivalent("ALI", "ALI ABU")
    assert N.similar_person("AHMAD BIN ABDULLAH", "AHMAD BIN ABDULLA")
    assert N.clean("DUITNOW TRANSFER TO ALPHA INV 1234") == "ALPHA" and N.clean("  ") == "UNKNOWN"
    assert N.without_owner("ALPHA BRAVO WORKS CHARLIE", "ALPHA BRAVO SDN BHD") == "WORKS CHARLIE"
    made = N.alias_map({"A HARDWARE": 3, "A HARDWAR": 1, "B": 1})
    assert made == {"A HARDWARE": "A HARDWARE", "A HARDWAR": "A HARDWARE", "B": "B"}
    assert N.shared_run("A B C D", "X B C Y") == 2


def test_text_source_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("HEADER\n01/02/2024 OPENING BALANCE 1.00 100.00\n02/02/2024  PAYMENT X  30.00 - 70.00\n3/2/2024 SALES 5.00 75.00\n4/2/2024 FEE 1.00 74.00\nFOOTER\n")
    rows = Z.canonical(Z.read(spark, str(tmp_path), "text")).orderBy("line").collect()
    assert [(str(r.dt), r.description, r.credit, r.debit, r.balance) for r in rows] == [("2024-02-01", "OPENING BALANCE", 1.0, 0.0, 100.0), ("2024-02-02", "PAYMENT X", 0.0, 30.0, 70.0), ("2024-02-03", "SALES", 5.0, 0.0, 75.0), ("2024-02-04", "FEE", 0.0, 1.0, 74.0)]
    assert Z.banks() == [*Z.BANKS, "text"]
    assert Z.quality_counts(Z.canonical(Z.read(spark, str(tmp_path), "text"))).first().both_sides == 0


def test_nearest_balances(spark):
    rows = [("f", dt.date(2024, 1, 1), [100.0, 5.0]), ("f", dt.date(2024, 1, 2), [4.0, 120.0]), ("f", dt.date(2024, 1, 3), [7.0, 90.0])]
    got = Z.nearest_balances(spark.createDataFrame(rows, "file string, dt date, candidates array<double>")).orderBy("dt").collect()
    assert [r.balance for r in got] == [100.0, 120.0, 90.0]


def test_flags_are_sixteen_in_order(spark, sf):
    rows = registry.QUERIES["R01_flags"](spark, sf).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 17)) and rows[0].detected and all(r.remarks for r in rows)


def test_report_round_trip(spark, sf, tmp_path):
    docs = P.documents(fixtures.statement(spark, sf), "m")
    assert P.changed(docs, docs).where("status <> 'UNCHANGED'").count() == 0
    P.export_json(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == docs.count()


@pytest.mark.parametrize("name", ["ST3_repeats", "ST4_sessions", "ST5_detectors", "E03_merge_rounds", "R08_observations", "A27_formula_checks", "R13_risk_sheet", "P22_nearest_balances", "J07_paired_returns"])
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries())


def test_parties_of_banks_and_layouts_take_nulls_and_empty_tables(spark):
    from tallyspark.sources import bankparties as B
    from tallyspark.sources import layouts as Y

    none = spark.createDataFrame([("Maybank", None), ("Maybank", ""), ("OCBC", ""), (None, "x"), ("Affin Bank", "x")], "bank string, t string")
    assert [r.p for r in none.select(B.bank_party(F.col("bank"), F.col("t")).alias("p")).collect()] == ["UNKNOWN"] * 3 + [None] * 2
    held = spark.createDataFrame([("INWARD IBG CREDIT | RPP | ACME SDN BHD",), ("X MBISMYKL",), ("INWARD IBG CREDIT | ACME SDN | BETA",)], "t string")
    assert [r.p for r in held.select(B.agro(F.col("t"), F.lit("Acme Sdn Bhd")).alias("p")).collect()] == ["ACME SDN BHD", "ACME SDN BHD", "BETA"]
    tx = spark.createDataFrame([(None, "Maybank", None, "mine"), ("a", "Maybank", "TRANSFER FR A/C ALPHA WORKS", None)], "file string, bank string, description string, party string")
    assert sorted((r.file or "", r.party_raw, r.party) for r in B.annotate(tx).collect()) == [("", "UNKNOWN", "UNKNOWN"), ("a", "ALPHA WORKS", "ALPHA WORKS")]
    empty = spark.createDataFrame([], "file string, page int, line int, text string")
    blank = spark.createDataFrame([("f", 1, 1, None), ("f", 1, 2, "no row 1.00")], "file string, page int, line int, text string")
    for layout in (Y.alliance, Y.public_bank, Y.ocbc):
        assert tuple(layout(empty).columns) == Y.ROWS and layout(empty).count() == 0 and layout(blank).count() == 0


def test_layouts_read_files_by_bank(spark, tmp_path):
    (tmp_path / "a.txt").write_text("01 JAN 2024 PAY ALPHA 20.00 120.00\nREF: a b c d e\n\fBalance B/F 1.00\n02 JAN 2024 CASH DR 5.00 115.00\nREF: a b REF: c d\nx\n")
    rows = Z.read(spark, str(tmp_path), "OCBC").orderBy("seq").collect()
    assert [(r.page, str(r.dt), r.description, r.debit, r.credit) for r in rows] == [(1, "2024-01-01", "PAY ALPHA REF: a b c d", 0.0, 0.0), (2, "2024-01-02", "CASH DR REF: a b REF: c d x", 5.0, 0.0)]
    (tmp_path / "a.txt").write_text("01/03 DEP ALPHA 5.00 15.00\nBalance C/F 15.00\n\f\n\fBalance B/F 15.00\nnot carried over an empty page\n02/03 FEE 1.00 14.00\n")
    rows = Z.read(spark, str(tmp_path), "Public Bank (PBB)").orderBy("seq").collect()
    assert [(r.page, r.dt, r.description, r.debit, r.credit) for r in rows] == [(1, None, "DEP ALPHA", 0.0, 5.0), (3, None, "FEE", 1.0, 0.0)]

"""Parties among notes (F34): texts of four banks with the names that their rules read, null and very long texts."""

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import registry
from tallyspark.sources import bankparties as B
from tallyspark.sources.headers import company_name

CASES = (
    ("Bank Muamalat", "FPX DEBIT 1 2 3 ALPHA WORKS SDN. BHD. X", "ALPHA WORKS SDN BHD"),
    ("Bank Muamalat", "SERVICE CHARGE/MISC Fund Transfer PAYMENT 3RD CLAIM ALI BIN ABU", "ALI BIN ABU"),
    ("Bank Muamalat", "Direct Debit DELTA SN BH MBIBT 1", "DELTA SDN BHD"),
    ("Bank Muamalat", "X CEK 1", "CHEQUE"),
    ("Bank Muamalat", "profit paid", "PROFIT PAID"),
    ("RHB Bank", "RFLX INSTANT TRF DR 1234567890 ALPHA WORKS SDN B / note", "ALPHA WORKS SDN BHD"),
    ("RHB Bank", "RPP INWARD INST TRF CR 1234567890 MUTHU A / L RAJ 12345678901", "MUTHU A/L RAJ"),
    ("RHB Bank", "MYDEBIT - 1234567890 KEDAI ABC LMY CARD 1234", "KEDAI ABC"),
    ("RHB Bank", "RPP INWARD INST TRF CR 1234567890", "UNKNOWN"),
    ("RHB Bank", "CDM CASH DEPOSIT 1", "CASH DEPOSIT"),
    ("Hong Leong", "Instant Transfer RENT GAJI AHMAD BIN ABU 20240101ABCDMYKL001X", "AHMAD BIN ABU"),
    ("Hong Leong", "Instant Transfer ALPHA & PARTNERS 1,000.00", "ALPHA & PARTNERS"),
    ("Hong Leong", "Fund Transfer OMEGA ENTERPRISE", "OMEGA ENTERPRISE"),
    ("Hong Leong", "Bulk DuitNow 1", "BULK DUITNOW"),
    ("CIMB Bank", "TR TO C/A KLINIK SUNWAY JOE TAN CLAIM 1", "JOE TAN"),
    ("CIMB Bank", "JOMPAY TNB 123", "TNB"),
    ("CIMB Bank", "HOUSE CHQ DR 1", "CHEQUE"),
    ("CIMB Bank", "SIGMA LINE\nfoo", "FOO"),
    ("CIMB Bank", "12345", "UNKNOWN"),
)
MORE = sorted({bank for bank, _, _ in CASES})


def test_names_among_notes(spark):
    rows = spark.createDataFrame(CASES, "bank string, t string, expected string")
    wrong = [(r.bank, r.t, r.p) for r in rows.select("*", B.bank_party(F.col("bank"), F.col("t")).alias("p")).collect() if r.p != r.expected]
    assert wrong == []


def test_null_empty_and_long_texts(spark):
    rows = spark.createDataFrame([(b, t) for b in MORE for t in (None, "", "1 2 " * 2000)], "bank string, t string")
    assert {r.p for r in rows.where("bank <> 'Hong Leong' OR t IS NULL OR t = ''").select(B.bank_party(F.col("bank"), F.col("t")).alias("p")).collect()} == {"UNKNOWN"}
    assert rows.limit(0).select(B.bank_party(F.col("bank"), F.col("t"))).count() == 0
    assert len(rows.where("bank = 'Hong Leong'").select(B.bank_party(F.col("bank"), F.col("t")).alias("p")).collect()) == 3


@pytest.mark.parametrize(("name", "cols"), [("F34_names_among_notes", ["row_order", "bank", "party"]), ("P19_company_name", ["file", "company"]), ("F16_canonical_parties", ["party", "n", "credits", "debits"])])
def test_query_matches_sql(spark, sf, name, cols):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "supplier", "part", "nation", "region", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = lambda q: sorted([tuple(map(str, r)) for r in q])
    want = rows(con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    assert rows(registry.QUERIES[name](spark, sf).select(*cols).collect()) == want and want


def test_company_names_in_headers(spark):
    files = {
        "label": ["ACCOUNT NO 5123456789", "Nama Akaun:", "ACME(M) SDN. BHD. 12 Jalan X"],
        "number": ["Account Name: 1234567890", "Pemegang Akaun - BETA STORES"],
        "code": ["Statement", "AB123 GAMMA ENTERPRISE STATEMENT OF ACCOUNT"],
        "date": ["01/02/2024 DELTA TRADING", "www.delta.com GROUP"],
        "none": [None, "  ", "Balance 1.00"],
        "tie": ["FIRST HOLDINGS", "SECOND HOLDINGS"],
    }
    rows = [(f, 1, k, t) for f, texts in files.items() for k, t in enumerate(texts)] + [("none", 3, 1, "LATE HOLDINGS"), (None, 1, 1, "NULL FILE GROUP"), ("tie", 1, 0, "FIRST HOLDINGS")]
    lines = spark.createDataFrame(rows, "file string, page int, line int, text string")
    got = {r.file: r.company for r in company_name(lines.withColumn("n", F.lit(1))).collect()}
    assert got == {"label": "ACME (M) SDN BHD", "number": "BETA STORES", "code": "GAMMA ENTERPRISE", "date": None, "none": None, "tie": "FIRST HOLDINGS", None: "NULL FILE GROUP"}
    assert company_name(lines.limit(0)).count() == 0


def test_canonical_names(spark):
    from tallyspark.operators import related as R

    rows = spark.createDataFrame([(None,), ("",), (" JANM CAWANGAN X",), ("XJANM CAWANGAN",), ("PLANWORTH GLOBAL FUND",), ("abc sdn",)], "t string")
    assert [r.p for r in rows.select(R.canonical_name(F.col("t")).alias("p")).collect()] == [None, "", "JANM", "XJANM CAWANGAN", "PLANWORTH GLOBAL FUND", "abc SDN BHD"]
    assert [r.p for r in rows.select(R.canonical_name(F.col("t"), ()).alias("p")).collect()][2] == "JANM CAWANGAN X"

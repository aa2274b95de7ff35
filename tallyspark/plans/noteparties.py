"""Queries of parties among notes and of companies in headers: texts made of the rows' own numbers, names read back out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import related as R
from ..sources import bankparties as B
from ..sources.headers import company_name
from .fixtures import sql, statement

c = F.col

#: Bank, text as the bank prints it and the party in it; ``{n}`` is the row's name, ``{r}`` its number, ``{t}`` its number in ten digits.
PRINTED = (
    ("Bank Muamalat", "DEBIT ADVICE {r} INV {r} PAYMENT {n} TRADING SDN. B", "{n} TRADING SDN BHD"),
    ("Bank Muamalat", "TFR/SAL/MISC CLAIM 3RD {n} BIN ABU", "{n} BIN ABU"),
    ("Bank Muamalat", "SERVICE CHARGE/MISC {r}", "BANK CHARGES"),
    ("Bank Muamalat", "BILL PAYMENT DEBIT Fund Transfer JAN INV {r} {n} LOGISTICS", "{n} LOGISTICS"),
    ("RHB Bank", "RPP INWARD INST TRF CR {t} {n} A / L RAJ Fund transfer", "{n} A/L RAJ"),
    ("RHB Bank", "INWARD IBG {t} AB{t} payment for {n} TRADING", "{n} TRADING"),
    ("RHB Bank", "MYDEBIT - {t} {n} MART {n} MART", "{n} MART"),
    ("RHB Bank", "DUITNOW QR P2P CR {t} 12{t} QR P2P Payment {n} BINTI OMAR 12{t}", "{n} BINTI OMAR"),
    ("Hong Leong", "CIB Instant Transfer at KL RENT {n} WORKS S/B 1,250.00", "{n} WORKS SDN BHD"),
    ("Hong Leong", "Instant Transfer GAJI {n} ALI BIN ABU 20240101ABCDMYKL001X", "{n} ALI BIN ABU"),
    ("Hong Leong", "Cheque Processing Fee {r}", "BANK FEES"),
    ("CIMB Bank", "DUITNOW TO ACCOUNT | {t} | {n} GLASS SDN BH", "{n} GLASS SDN BHD"),
    ("CIMB Bank", "TR FROM CA payment from {n} BAKERY", "{n} BAKERY"),
    ("CIMB Bank", "TR TO SAVINGS {n} BIN ABU HOUSE RENTAL MAY", "{n} BIN ABU"),
    ("CIMB Bank", "AUTOPAY CR {t} {n} STORES", "{n} STORES"),
    ("CIMB Bank", "REMITTANCE CR {t} {n} MOTORS", "{n} MOTORS"),
    ("CIMB Bank", "OTHER TRANSFER FEE {r}", "TRANSFER FEE"),
)


def printed(s, d) -> DataFrame:
    """Rows with a bank and a text; the name is the row's number in letters."""
    st = statement(s, d).select("row_order").withColumn("r", c("row_order").cast("string"))
    st = st.withColumn("n", F.concat(F.lit("W"), F.translate("r", "0123456789", "ABCDEFGHIJ"))).withColumn("t", F.lpad("r", 10, "7"))
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in PRINTED)), (c("row_order") % len(PRINTED) + 1).cast("int"))
    text = pick(1)
    for k in "nrt":
        text = F.replace(text, F.lit("{" + k + "}"), c(k))
    return st.select("row_order", pick(0).alias("bank"), text.alias("description"))


_name = "'W' || translate(CAST(row_order AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"
_kind = " ".join(f"WHEN {k} THEN " + (f"{_name} || '{p[2][3:]}'" if p[2].startswith("{n}") else f"'{p[2]}'") for k, p in enumerate(PRINTED))
QUERIES: dict = {"F34_names_among_notes": lambda s, d: printed(s, d).select("row_order", "bank", B.bank_party(c("bank"), c("description")).alias("party"))}
SQL: dict[str, str] = {"F34_names_among_notes": sql(f"SELECT row_order, CASE row_order % {len(PRINTED)} " + " ".join(f"WHEN {k} THEN '{p[0]}'" for k, p in enumerate(PRINTED)) + f" END AS bank, CASE row_order % {len(PRINTED)} {_kind} END AS party FROM st")}


#: Header lines by the account's number mod six, ``{n}`` is its name, and the company they name.
HEADERS = (
    (("Bank Statement", "Account Name : {n} WORKS SDNBHD  Page 1"), "{n} WORKS SDN BHD"),
    (("Penyata Akaun", "{n} TRADING", "ACCOUNT NO 5123456789"), "{n} TRADING"),
    (("Company / Account Account Balance", "Company Available Balance", "{n} CORPORATION SDN. BHD. MYR 55,744.04"), "{n} CORPORATION SDN BHD"),
    (("TARIKH PENYATA", "{n} BIN ABU 結單日期: 1/2"), "{n} BIN ABU"),
    (("Page 1", "{n} CLEAR WATER", "SDN. BHD."), "{n} CLEAR WATER SDN BHD"),
    (("Page 1", "Balance 12.00"), None),
)


def headers(s, d) -> DataFrame:
    """Lines of one header for each account."""
    a = statement(s, d).select("account_no").distinct()
    name = F.concat(F.lit("W"), F.translate(c("account_no").cast("string"), "0123456789", "ABCDEFGHIJ"))
    kinds = F.array(*(F.array(*map(F.lit, texts)) for texts, _ in HEADERS))
    lines = a.select(c("account_no").cast("string").alias("file"), F.lit(1).alias("page"), name.alias("n"), F.posexplode(F.element_at(kinds, (c("account_no") % len(HEADERS) + 1).cast("int"))).alias("line", "t"))
    return lines.select("file", "page", "line", F.replace("t", F.lit("{n}"), c("n")).alias("text"))


_holder = "'W' || translate(CAST(account_no AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"
QUERIES["P19_company_name"] = lambda s, d: company_name(headers(s, d))
SQL["P19_company_name"] = sql(f"SELECT DISTINCT CAST(account_no AS VARCHAR) AS file, CASE account_no % {len(HEADERS)} " + " ".join(f"WHEN {k} THEN {_holder} || '{h[1][3:]}'" for k, h in enumerate(HEADERS) if h[1]) + " END AS company FROM st")


#: Names by the row's number mod five, ``{n}`` is the row's own, and the one that each stands for.
SPELT = (("JANM Cawangan {n}", "JANM"), (" Planworth Global fac ", "PLANWORTH GLOBAL"), ("{n} Works Sdn B", "{n} Works SDN BHD"), (" {n} BERHAD ", "{n} BERHAD"), ("{n} (M) SB", "{n} (M) SDN BHD"))


def spelt(s, d) -> DataFrame:
    name = F.concat(F.lit("W"), F.translate(c("row_order").cast("string"), "0123456789", "ABCDEFGHIJ"))
    pick = F.element_at(F.array(*(F.lit(x) for x, _ in SPELT)), (c("row_order") % len(SPELT) + 1).cast("int"))
    return statement(s, d).select(F.replace(pick, F.lit("{n}"), name).alias("name"), "credit", "debit")


#: The sums of names that stand for one party come together.
QUERIES["F16_canonical_parties"] = lambda s, d: spelt(s, d).groupBy(R.canonical_name(c("name")).alias("party")).agg(F.count("*").alias("n"), F.sum("credit").cast("double").alias("credits"), F.sum("debit").cast("double").alias("debits"))
SQL["F16_canonical_parties"] = sql(f"SELECT CASE row_order % {len(SPELT)} " + " ".join(f"WHEN {k} THEN " + (f"{_name} || '{x[1][3:]}'" if x[1].startswith("{n}") else f"'{x[1]}'") for k, x in enumerate(SPELT)) + " END AS party, count(*) AS n, CAST(sum(credit) AS DOUBLE) AS credits, CAST(sum(debit) AS DOUBLE) AS debits FROM st GROUP BY 1")

"""Parties in bank texts (F34) and their attachment to rows (N11): a table of rules per bank, run inside the JVM.

A bank's rules are cuts, labels and captures, each in order. The first label that fits names the row; else the first
capture's group does, once the bank's cleaning has gone over it. Nothing here is a Python function of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def off(c: Column, *patterns: str, by: str = "") -> Column:
    for p in patterns:
        c = F.regexp_replace(c, f"(?i){p}", by)
    return c


def edges(c: Column, chars: str = " ,.-") -> Column:
    return F.btrim(spaced(c), F.lit(chars))


def group(c: Column, pattern: str) -> Column:
    """The first group of a fitting pattern, else null."""
    return F.when(c.rlike(f"(?i){pattern}"), F.regexp_extract(c, f"(?i){pattern}", 1))


def suffix(c: Column) -> Column:
    return off(c, r"\bSDN\.?\s*BHD\.?\b", r"\bSDN\.?\s*BH\b", r"\bSDN\.?\s*B\b", by="SDN BHD")


def legal_words(c: Column, whole: bool) -> Column:
    """Spellings of the legal form word by word: SND and SD as SDN, behind it BH, BDH and B as BHD; ``whole`` adds a missing BHD."""
    words = F.transform(F.split(c, " "), lambda w: F.when(w.isin("SND", "SD"), "SDN").otherwise(w))

    def rest(w: Column) -> Column:
        at = F.array_position(w, "SDN")
        named = F.transform(w, lambda x, i: F.when((at > 0) & (i >= at) & x.isin("BH", "BDH", "B"), "BHD").otherwise(x))
        return F.array_join(F.when((at > 0) & ~F.array_contains(named, "BHD") & F.lit(whole), F.array_append(named, "BHD")).otherwise(named), " ")

    return bound(words, rest)


def without_generic(c: Column, words: Iterable[str], digits: bool = False) -> Column:
    """Null where every word is one that names nobody."""
    nobody = lambda w: w.isin(*sorted(words), "") | (w.rlike(r"^\d+$") if digits else F.lit(False))
    return F.when(F.exists(F.split(F.regexp_replace(c, r"[^A-Z0-9/&\s]", " "), r"\s+"), lambda w: ~nobody(w)), c)


@dataclass(frozen=True)
class Rules:
    """``go_on``: a capture that cleaning leaves empty lets the next one try; else the first that fits decides."""

    labels: tuple[tuple[str, str], ...]
    captures: tuple[tuple[str, str | None], ...]
    clean: Callable[[Column], Column]
    cuts: tuple[str, ...] = ()
    go_on: bool = False
    upper: bool = False

    def party(self, text: Column) -> Column:
        s = spaced(text)
        s = off(F.upper(s) if self.upper else s, *self.cuts)
        return bound(s, self._named)

    def _named(self, s: Column) -> Column:
        if self.go_on:
            found = F.transform(F.array(*(group(s, p) for p, _ in self.captures)), lambda x: F.when(x.isNotNull(), F.nullif(self.clean(x), F.lit(""))))
            found = F.get(F.filter(found, lambda x: x.isNotNull() & (x != UNKNOWN)), F.lit(0))
        else:
            raw = F.coalesce(*(group(s, p) for p, _ in self.captures))
            kept = [(p, b) for p, b in self.captures if b]
            instead = F.lit(UNKNOWN)
            for p, label in reversed(kept):
                instead = F.when(s.rlike(f"(?i){p}"), label).otherwise(instead)
            found = F.when(raw.isNotNull(), F.coalesce(F.nullif(bound(raw, self.clean), F.lit("")), instead))
        out = F.coalesce(found, F.lit(UNKNOWN))
        for p, label in reversed(self.labels):
            out = F.when(s.rlike(f"(?i){p}"), label).otherwise(out)
        return out


# Fixed values, from here on: each bank's patterns, labels and words that name nobody.

AGRO_NOBODY = ("RPP", "DUITNOW", "REFUND", "TOTAL", "DEBIT", "DEBITS", "CREDIT", "CREDITS", "GA", "ADVICE", "HIBAH/PROFIT", "HIBAH", "PROFIT", "UNKNOWN")
AGRO_SKIP = (r"RPP", r"RM\s*\.00", r"0", r"\d{1,2}:\d{2}(?::\d{2})?", r"IBG\s+FROM\s+AGROBANK", r"BRANCH\s+OTC", r"[A-Z]{4,}[A-Z0-9]{4,}", r"BIB\d+", r"\d{4,}")


def agro_name(c: Column) -> Column:
    return legal_words(spaced(F.regexp_replace(F.upper(c), r"[^A-Z0-9/&\s]", " ")), True)


def agro_clean(c: Column) -> Column:
    s = off(spaced(c), r"\b(?:REF(?:ERENCE)?|TRACE|ID|NO|TXN|TRANSACTION|ACC(?:OUNT)?|A/C|BANK|BKBK)\b.*$", r"(?:\s+|[-./])\d{5,}(?:[-./]\d+)*\s*$")
    return bound(agro_name(s), lambda x: without_generic(x, AGRO_NOBODY))


AGRO = Rules(
    labels=((r"\bCDM\s+CA\s+DEPOSIT\b", "CDM CA DEPOSIT"),),
    captures=(
        (r"\bDUITNOW/INSTANT\s+(?:DR|CR)\b\s+(.+)$", None),
        (r"\bOUTWARD\s+IBG\s+DEBIT\b\s+(.+)$", None),
        (r"\bINWARD\s+IBG\s+CREDIT\b\s+(.+)$", None),
        (r"\bINWARD\s+RENTAS\s+CREDIT\b\s+(.+)$", None),
        (r"\bFPX\s+PAYMENT\b\s+(.+)$", None),
        (r"\bIBFT\s+INEB-INWTRF\b\s*(?:-\s*\w+)?\s+(.+)$", None),
    ),
    clean=agro_clean,
    go_on=True,
    upper=True,
)


def agro(text: Column, holder: Column | None = None) -> Column:
    """Agro Bank: behind the first `` | `` the first part that names somebody but the account's holder, else the holder if
    the parts name them; a text of one part goes by the rules."""
    own = agro_name(F.coalesce(holder, F.lit(""))) if holder is not None else F.lit("")
    parts = F.transform(F.slice(F.filter(F.split(F.upper(F.coalesce(text, F.lit(""))), r"\s+\|\s+"), lambda p: spaced(p) != ""), 2, 1 << 20), spaced)
    other = lambda p: (agro_name(p) != own) & ~p.rlike("^(?:" + "|".join(AGRO_SKIP) + ")$") & without_generic(p, AGRO_NOBODY).isNotNull()

    def among(p: Column) -> Column:
        first = F.get(F.filter(p, other), F.lit(0))
        repeated = F.exists(p, lambda x: (own != "") & (agro_name(x) == own))
        return F.coalesce(bound(agro_name(first), lambda x: without_generic(x, AGRO_NOBODY)), F.when(repeated, own), F.lit(UNKNOWN))

    out = F.when(F.size(parts) > 0, bound(parts, among)).otherwise(AGRO.party(text))
    return F.when(F.upper(text).rlike(AGRO.labels[0][0]), AGRO.labels[0][1]).when((own != "") & F.upper(text).rlike(r"\bMBISM[YK]KL\b"), own).otherwise(out)


def ambank_clean(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"^[,\s]+|[,\s]+$", ""), r"\b\S*\d\S*\b", " ")
    s = off(s, r"\s+\b(?:INV|INVOICE|PB|PV|FIN|OTC|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\b.*$")
    return F.upper(edges(suffix(s), " -/,."))


AMBANK = Rules(
    cuts=(r"\s*AmBank Islamic Berhad.*$|\s*3060_0021\s*$", r"^[ ,]+|[ ,]+$"),
    labels=(
        (r"^$", UNKNOWN),
        (r"\b(?:CASH\s+DEPOSIT|CRM\s+CSH\s+DEP)\b", "CASH DEPOSIT"),
        (r"^\s*HIBAH\s*/\s*PROFIT\b", "HIBAH/PROFIT"),
        (r"^\s*MEPS\s+FEE\b", "MEPS FEE"),
        (r"\b(?:ATM\s+(?:CASH\s+)?WITHDRAWAL|CASH\s+WITHDRAWAL\s+(?:AT\s+)?ATM|ATM\s+WDL)\b", "ATM WITHDRAWAL"),
        (r"\b(?:CHQ|CHEQUE|CLEARING)\b", "CHEQUE"),
    ),
    captures=(
        (r"^DuitNow\s+(?:TRF|CR\s+TRF|Transfer)\s*/\s*(?:MISC\s+CREDIT|MISC\s+DEBIT|DEBIT\s+TRANSFER|CREDIT\s+TRANSFER)\s*,\s*([^,]*)", "DUITNOW"),
        (r"^Inst\s+Trf\b.*?/\s*(?:CREDIT|DEBIT)(?:\s+TRANSFER)?\s*,\s*([^,]*)", "INST TRF"),
        (r"^DEBIT\s+TRANSFER\s*,\s*([^,]*)", "DEBIT TRANSFER"),
        (r"^CREDIT\s+TRANSFER\s*,\s*([^,]*)", "CREDIT TRANSFER"),
        (r"^(?:MC\s+Retail\s+Off\s+Us(?:\s*-\s*\w+)?|MC\s+Retail\s*/\s*Pur(?:chase|cahse|hase)\s+Off|MyDebit\s+(?:Pur|Per)(?:chase|cahse|hase)\s+(?:Off|On))(?:\s*/\s*[^,]*)?\s*,\s*([^,]*)", "CARD PURCHASE"),
        (
            r"^(?:Fund\s+Transfer|DuitNow\s+(?:TRF|CR\s+TRF|Transfer)|STATUTORY\s+BODY\s+TXN|Salary|CTL\s+OUTWARD\s+CLEARING|INWARD\s+IBG|INW\s+AMI\s+CHQ|CHEQUE\s+PROCESSING\s+FEE|JomPAY|CMS\s+FPX\s+PAYMENT"
            r"|Interbank\s+GIRO|SI\s*-\s*INTERBANK\s+GIRO\s+TD-I\s+PFT/PFT\s+TF|INTERBANK\s+GIRO\s+STANDING\s+INSTRUCTION\s+FEE|CMS\s+INTER\s+ACC\s+TRF|HIBAH/PROFIT)\s*/?[^,]*,\s*(.*?)(?:,\s*.*$|$)",
            None,
        ),
    ),
    clean=ambank_clean,
)

ISLAM_CODE = r"^\s*(?:\d+\s+)?\d{4}"
ISLAM_PLAIN = r"^(?:(?:\d+\s+)?\d{4}\s+)?"


def islam_clean(c: Column) -> Column:
    s = edges(off(c, r"\bIBG\s+TRANSACTIO\s*N\b.*$"))
    s = edges(F.regexp_replace(s, ",.*$", ""))
    s = F.regexp_replace(s, r"(?:\s+\d{5,}(?:\s+\d+)?|\s+[A-Z]{2,}[A-Z0-9]{4,}\s+\d{1,3}|\s+[A-Z0-9]*\d[A-Z0-9]*(?:\s+[A-Z])?)+$", "")
    s = off(s, r"\bSDN\.?\s*BHD\.?\b", r"\bSDN\s+BH\b", by="SDN BHD")
    for short, long in (("BERH", "BERHAD"), ("CAPITA", "CAPITAL"), ("ACCOU", "ACCOUNT"), ("GR", "GROUP")):
        s = off(s, rf"\b{short}\b", by=long)
    cut = lambda x: F.when(x.rlike(r"(?i)\bSDN\s+BHD\b"), off(x, r"(\bSDN\s+BHD\b).*$", by="$1")).when(x.rlike(r"(?i)\bSDN\b"), off(x, r"\s*\bSDN\b.*$", by=" SDN BHD")).when(x.rlike(r"(?i)\bSD\b"), off(x, r"\s*\bSD\b.*$", by=" SDN BHD")).otherwise(x)
    s = F.regexp_replace(bound(s, cut), r"^(\S+\s+\S+(?:\s+[^a-z\s]+)*)\s+\S*[a-z].*$", "$1")
    s = F.upper(edges(F.regexp_replace(s, r"\s+\d{5,}(?:\s+\d+)?$", "")))
    return bound(s, lambda x: F.when(x.rlike("[A-Z]"), x))


ISLAM = Rules(
    labels=(),
    captures=(
        (ISLAM_CODE + r"HSECHQDEP-CR/DR\s+\d+\s+(.+?)\s+\d+$", None),
        (ISLAM_CODE + r"IBDuitNow\(ACCNO\)\s+.+\s+([^\s]+)\s+\d{7}(?:\s+140N)?$", None),
        (ISLAM_CODE + r"IBDuitNow\(ACCNO\)\s+.+\s+([^\s]+)$", None),
        (ISLAM_CODE + r"IBFPX\(DEBIT\)-CA\s+.*?\s+([A-Z][A-Z0-9&/.]+)\s+EFPX\d+$", None),
        (ISLAM_CODE + r"IBCATRFSA3RDPTY\s+.*?\s+([A-Z][A-Z0-9&/.]+)\s+EFO\d+(?:\s+140N)?$", None),
        (ISLAM_CODE + r"INWDuitNowTransfer\s+TRANSFER(?:\s+BI)?\s+(.+?)\s+XRPP\d+$", None),
        (ISLAM_CODE + r"ATMCASHWDRWL-CA\s+(.+?)(?:\s+140N)?$", None),
        (ISLAM_CODE + r"CANONCHQWDRL\s+\d+(Withdrawalwithoutcheque)\s+\d+$", None),
        (ISLAM_CODE + r"(PROFITPAID)$", None),
        (ISLAM_CODE + r"(SERVICECHARGE)$", None),
        (ISLAM_CODE + r"CADR&CRADVICE\(BOC\)\s+.*?\s+([A-Z][A-Z0-9&/.]+)\s+BOC_\d+$", None),
        (r"^(?=.*\b(?:SERVICE\s+CHARGE|CHQ\s+PRCSG\s+FEE|PROFIT\s+PAID|REVERSE\s+POSTED|GUARANTEE\s+FEE|CAJ\s+PENGESAHAN\s+AKAUN)\b)()", "BANK / SYSTEM"),
        (ISLAM_PLAIN + r"INW\s+DuitNow\s+Transfer\s+(.+)$", None),
        (ISLAM_PLAIN + r"CA\s+(?:DR&CR|DR|CR)\s+ADVICE\s+(?:\d{4,6}\s+)?(?:TRANSFER\s+FUND|TRF\s+FUND|REFUND)\s+(.+?)(?:\s+\d{5,}.*)?$", None),
        (ISLAM_CODE + r"\s+CA\s+(?:DR&CR|DR|CR)\s+ADVICE\s+(.+?)(?:\s+\d{4,}.*)?$", None),
        (ISLAM_CODE + r"\s+CDB\s+(?:JOMPAY|JPMPAY)\s+(?:ON-US|OFF-US)(?:\s+U\d+\s+\d+)?\s+(.+)$", None),
        (ISLAM_PLAIN + r"IBG\s+TRANSFER\s+TO\s+CA\s+(.+?)(?:\s+\d{5,}.*)?$", None),
        (ISLAM_PLAIN + r"INW\s+RENTAS\s+CR\s+CA\s+(.+?)(?:\s+\d{5,}.*)?$", None),
        (ISLAM_PLAIN + r"MYC\s+DD\s+CASA\s*-\s*DR\s+(.+?)(?:\s+\d{6,}.*)?$", None),
        (ISLAM_PLAIN + r"CDB\s+FPX\(DR\)-CA\s+TO\s+GL\s+\d+\s+\d+\s+(.+?)(?:\s+EFPX[A-Z0-9]+)?$", None),
        (ISLAM_PLAIN + r"CDB\s+CA\s+TRF\s+IBG\s+INTERBANK\s+TRANSFER\s+[A-Z0-9]+\s+(.+?)(?:\s+\d{5,}.*)?$", None),
        (ISLAM_PLAIN + r"CDB\s+CA\s+TRF\s+IBG\s+(.+)$", None),
        (ISLAM_PLAIN + r"CDB\s+CS\s+TO\s+IBFTS3\s+(.+)$", None),
        (ISLAM_PLAIN + r"eSPICK\s+INW\s+(.+)$", None),
        (ISLAM_PLAIN + r"(?:TRANSFER\s+FUND|TRF\s+FUND|REFUND)\s+(.+?)(?:\s+\d{5,}.*)?$", None),
        (ISLAM_PLAIN + r"(.*\b(?:SDN\.?\s*(?:BHD\.?|BH|BDH)?|BERHAD|ENTERPRISE|TRADING|SERVICES|HOLDINGS|PLT)\b.*)$", None),
    ),
    clean=islam_clean,
)


def rakyat_clean(c: Column) -> Column:
    s = off(F.upper(edges(c)), r"^\(?IBG\)?\s+")
    s = off(suffix(off(s, r"\bSDNBHD\b", by="SDN BHD")), r"\bBERHAD\b", by="BHD")
    tail = (
        r"\b(?:AGROBIZ|TRADING|SIMPANAN|STAFFID\d+|GAJI\s+\w+\d*|GAJI|BAYARAN|BAY\d*|PWR|PINDAHAN|REFUND|LEKUPAN|SUMBANGAN|FUND(?:\s+TRANSFER)?|INV[-/\w]*|KZ[\w/-]*|PBWPHG/[\w/-]*"
        r"|PAKKF[\w/-]*|MMB\w*|MMBEKAL|ANGKUT|SEWA|PERUBATAN|TUNTUTAN|SERVICE|BELIAN|TRANSFERFROM.*|FUNDTRANSFER|CASHW?DRAWAL|PAYMENT|REFERENCE|REF)\b.*$"
    )
    ended = lambda x: F.when(x.rlike(r"\b(?:SDN\s+BHD|BHD|PLT)\b"), F.regexp_replace(x, r"^(.*?\b(?:SDN\s+BHD|BHD|PLT)\b).*$", "$1")).otherwise(off(x, tail, r"\b\d{6,}\b.*$"))
    return edges(bound(s, ended))


RAKYAT_LEAD = r"^(?:\d{5}\s+)?"
RAKYAT = Rules(
    labels=(
        (r"\b(?:CHEQUE|CHQ|CEK|CHECK|CLEARING|CHEQUE\s*DEPOSIT|CHQ\s*WDL|CHQ\s*PROCESSING)\b", "CHEQUE"),
        (RAKYAT_LEAD + r"BILL\s*PAYMENT\s*TO\s*FIN\b", "BILLS"),
        (RAKYAT_LEAD + r"CREDIT\s*PROFIT\s*/?\s*HIBAH\b", "CREDIT PROFIT / HIBAH"),
        (r"^CDM\s*CASH\s*DEPOSIT\b", "CASH DEPOSIT"),
    ),
    captures=(
        (
            RAKYAT_LEAD + r"DUITNOW\s*TRANSFER\s+(.+?)(?:\s+(?:AGROBIZ|TRADING|SIMPANAN|STAFFID\d+|BAYARAN|BAY\d+|PWR|GAJI|REFUND|LEKUPAN|MMB|MMBEKAL|ANGKUT|SEWA|PERUBATAN|TUNTUTAN|FUND(?:\s+TRANSFER)?|INV|KZ\d+|PAKKF|PBWPHG|$).*)?$",
            None,
        ),
        (RAKYAT_LEAD + r"DUITNOW\s*FEE\s+(.+?)(?:\s+(?:AGROBIZ|TRADING|STAFFID\d+|BAY\d+|PENDAHULUAN|GAJI|FUND(?:\s+TRANSFER)?|$).*)?$", None),
        (RAKYAT_LEAD + r"CIB\s+(?:DR|CR)\s+(?:ADVICE|CHARGES)\s+(.+?)(?:\s+(?:AGROBIZ|STAFFID\d+|GAJI|PINDAHAN|PWR|SEWA|BELIAN|SERVICE|TUGASAN|PERUBATAN|$).*)?$", None),
        (RAKYAT_LEAD + r"CIB\s+SMS\s+FEE\s+(.+?)(?:\s+(?:AGROBIZ|TRADING|STAFFID\d+|GAJI|PINDAHAN|PWR|BAYARAN|BAY\d+|$).*)?$", None),
        (RAKYAT_LEAD + r"CIB\s+(?:DR\s+ADVICE|COMMISSION)\s*\(IBG\)\s+(.+?)(?:\s+(?:AGROBIZ|SUMBANGAN|$).*)?$", None),
        (RAKYAT_LEAD + r"IBG\s+(?:CREDIT|INWARD\s+RETURN)\s+(.+?)(?:\s+(?:KZ|BAY|PBWPHG|INV|STAFFID\d+|AGROBIZ|$).*)?$", None),
        (RAKYAT_LEAD + r"CASH\s*DEPOSIT\s*(.*)$", None),
        (r"^DUITNOWTRANSFER\s+(.+?)(?:\s+(?:FUNDTRANSFER|PAYMENT|REF).*)?$", None),
        (r"^TRTOSAVINGS\s+(.+?)(?:\s+\d{6,}.*|\s+TRANSFERFROM.*|$)", None),
        (r"^CASHWITHDRAWAL\s+(.+?)(?:\s+\d{6,}.*|\s+CASHW?DRAWAL.*|$)", None),
        (r"^(?:(?:\d{2,6}\s+)?(?:BANK\s+RAKYAT\s+(?:TRANSFER|PAYMENT)|TRANSFER\s+(?:TO|FROM)|PAYMENT\s+(?:TO|FROM))\s+)?.*?\b([A-Z0-9][A-Z0-9 &'()./-]*?\b(?:SDN\.?\s*BHD\.?|BHD\.?|BERHAD|PLT)\b)", None),
    ),
    clean=rakyat_clean,
)

OCBC_NOBODY = ("APPROVED", "CR", "CREDIT", "DEBIT", "DESC", "DR", "DUITNOW", "INWARD", "INST", "PAYMENT", "PYMT", "REF", "SC", "TO", "TRF", "TT", "UNKNOWN")


def ocbc_clean(c: Column) -> Column:
    s = off(F.upper(spaced(c)), r"\b(?:DESC|REF|REFERENCE|TRACE|ID|NO|TXN|TRANSACTION|ACC(?:OUNT)?|A/C|BILL|INV(?:OICE)?)\s*:?.*$", r"(?:\s+|[-./])\d{5,}(?:[-./]\d+)*\s*$", r"^/?IB\b\s*")
    s = spaced(F.regexp_replace(s, r"[^A-Z0-9/&().\s-]", " "))
    s = legal_words(spaced(F.array_join(F.transform(F.split(s, " "), lambda w: F.btrim(w, F.lit(" .,-"))), " ")), False)
    s = F.trim(off(s, r"\b(SB|SDN\s*\.?\s*BHD\.?|SDN\s*\.?\s*BH|SDN\s*\.?\s*B|SDN\.?)\s*$", by="SDN BHD"))
    return bound(s, lambda x: without_generic(x, OCBC_NOBODY, digits=True))


OCBC = Rules(
    labels=((r"^NO TRANSACTIONS", UNKNOWN),),
    captures=(
        (r"\bPYMT\s+TO\s+APPROVED\s+(.+?)(?=\s+DUITNOW|$)", None),
        (r"DUITNOW\(INST\s+TRF\)\s+(?:DR|CR)\b\s+(.+?)(?=\s+DESC:|\s+REF:|$)", None),
        (r"\bDUITNOW\s+SC\s+(.+?)(?=\s+DESC:|\s+REF:|$)", None),
        (r"\bCr\s+Inward\s+\(TT\)\s+\d+\s+(.+?)$", None),
    ),
    clean=ocbc_clean,
    go_on=True,
    upper=True,
)

PBB_BANKS = r"(?:CIM|CIMB|HSB|HSBC|RHB|MBB|PBB|HLB|AMB|BIMB|BMMB|BSN|UOB|OCBC|CIT|BOT)"
PBB_REMARK = (
    "ADV", "BALANCE", "BAYAR", "BAYARAN", "BOOKING", "CLAIM", "CLAIMS", "DEPOSIT", "FUND", "GAJI", "INVOICE", "INV", "KERETA", "LOAN", "ORDER", "PAYMENT", "PYMT", "REF", "REFERENCE", "RENTAL",
    "REPAIR", "ROADTAX", "SALARY", "SENT", "SEWA", "TRANSFER",
)
PBB_COMPANY = rf"^(?:DEP|DR)-ECP\s+\d+\s+\S+\s+(?:{PBB_BANKS}\s+)?(.+?\b(?:SDN\.?\s*(?:BHD|BH|B)\.?|BHD|BERHAD))\b"


def pbb_clean(c: Column) -> Column:
    person = r"^((?:\S+ )*?[.,()-]*(?:BIN|BINTI|BT|B)[.,()-]* \S+"
    s = F.upper(edges(c))
    s = F.regexp_replace(s, person + r".*?) [.,()-]*(?:" + "|".join(PBB_REMARK) + r")[.,()-]*(?: .*)?$", "$1")
    s = F.regexp_replace(s, person + r"[^(]*?) \([^)]*\).*$", "$1")
    s = off(
        edges(s),
        r"\bSIFAR\s+TOLERANSI\b.*$|\bTOLERANCE\s+APPROACH\b.*$",
        r"\b(?:CIM|HSB|RHB|MBB|PBB)\s+(?:TNG|GRB|/GHL/).*?$",
        r"\b(?:PVCWS[-/\w]*|PR/\S+|CWS-ALPHA-\S+|CWS-\S+|IFTAR|PURCHASE|IMPORT\s+DUTY|SALARY|INTERBANK\s+TRANSFER|FUND\s+TRANSFER|MONTHLY|INSTALLMENT|RENTAL|DUTY\s+CHARGES|KONTRA|ADV\s+STAF|STAF|SME\s+BANK\s+LOAN"
        r"|PAYMENT\s+BP|PAYMENT|PYMT|LOAN|CLAIMS?|REPAIR|ROADTAX|INSURAN|INSURANCE|PRODUCTS|BORROW|TRANSFER|RETURNS?|FROM\s+\w+.*|THANKS\s+\w+|CC|INS|(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\d{1,2}"
        r"|NO\s+DEFINE\s+FPX.*|FPX\s*-\s*\S+|202\d{5,}[A-Z0-9]+|OCB\d+|ORM\d+|OCM\d+|OOT\d+|TNG\d+|GRB\d+|66174[A-Z0-9]+|[A-Z]{1,3}\d{3,5})\b.*$",
        r"\b\d{8,}\b.*$",
        r"\b\d{3,4}\s+(?:LOAN|PAYMENT|PYMT)\b.*$",
        r"\b\d{3,4}\s*$",
    )
    s = F.regexp_replace(suffix(off(s, r"\bS\s*/\s*B\b", by="SDN BHD")), r"\b(SDN\s+BHD)\b.*$", "$1")
    return edges(off(s, r"\bBERHA\b", r"\bBERH\b", by="BERHAD"))


PBB = Rules(
    labels=(
        (r"\b(?:CHEQ|CHEQUE|CHQ|DEP-LOC\s+CHEQ|LOCAL\s+CHEQUE)\b", "CHEQUE"),
        (r"^HANDLING\s+CHRG\b", "BANK CHARGES"),
        (r"^DEP-CASH\s+CDT\b", "CASH DEPOSIT"),
        (r"^MISC\s+DR\b", "MISC DEBIT"),
    ),
    captures=(
        (
            r"^DUITNOW\s+TRSF\s+(?:DR|CR)\s+\d+\s+(.+?)(?=(?:\s+(?:KONTRA|ADV\s+STAF|STAF|SME\s+BANK\s+LOAN|PVCWS|BALANCE|SENT\s+FROM|REFUND|FUND\s+TRANSFER|INTERBANK\s+TRANSFER|CWS-|PR/|PBBEMYKL|MBBEMYKL|OCB|ORM|202\d{5,}))|$)",
            None,
        ),
        (rf"^DEP-ECP\s+\d+\s+\S+\s+(?:{PBB_BANKS}\s+)?(.+?)(?=(?:\s+(?:CIM|HSB|RHB|MBB|PBB|/GHL/|TNG|GRB|66174|CIT|BOT|MTHLY|XREF|APPY|\.|202\d{{5,}}))|$)", None),
        (r"^DR-ECP\s+(?!000001\b)\d+\s+\S+\s+(.+?)(?=(?:\s+(?:CP_|A\d+|T\d+|\d{6,}|GD\d+|NO\s+DEFINE|FPX))|$)", None),
        (r"^GIRO\s+PYMT-ATM/EFT\s+\d+\s+JOMPAY\s*-\s*[^-]+-\s*(.+)$", None),
        (r"^TSFR\s+FUND\s+(?:DR|CR)-ATM/EFT\s+\d+\s+\S+\s+(.+)$", None),
        (r"^CR\s+CARD\s+PYMT-ATM/EFT\s+\d+\s+\S+&&\s+(.+)$", None),
        (r"^LOAN\s+PYMT-ATM/EFT\s+\d+\s+\S+\s+(.+)$", None),
        (r"^RMT\s+DR\s+\S+\s+OUTWARD\s+(?:TT\s+)?(?:EBK\s+)?(.+?)(?=\s+[A-Z]{3}\s*\d|\s+USD|\s+AED|\s+@|$)", None),
        (r"^IBG\s+RTN\s+ITEM\s+\d{8}\s+\S+\s+[A-Z]{3,4}\s+(.+?)(?=$|\s+(?:NO\s+ACCOUNT|ACCOUNT\s+NOT\s+FOUND|INVALID\s+ACCOUNT|RENTAL))", None),
        (r"^RTN\s+ITEM\s+\d+\s+IBG\s+RTN\s+ITEM\s+\d+\s+\S+\s+[A-Z]{3}\s+(.+?)(?=$|\s+(?:NO\s+ACCOUNT|ACCOUNT\s+NOT\s+FOUND|INVALID\s+ACCOUNT|RENTAL))", None),
        (r"^AUTOMATED\s+LOAN\s+PYMT\s+TO\s+(\d+)", None),
        (PBB_COMPANY, None),
    ),
    clean=pbb_clean,
    go_on=True,
)

UOB_BANKS = r"\b(?:PBB|MBB|HLB|CIMB|RHB|ABMB|ABB|AMBG|OCBC|UOB)\b"


def uob_clean(c: Column) -> Column:
    s = F.regexp_replace(F.upper(spaced(c)), r"\|.*$", "")
    s = off(s, r"\b(?:C\d{5,}|INV\s*NO[: ]*\S+|PARTIAL\s+PAYMENT|PAYMENT|BILL\s+PAYMENT|SENT\s+FROM\s+AMONLINE)\b", r"\b\d{10,}\b", by=" ")
    s = edges(suffix(s), " ,.-|")

    def once(x: Column) -> Column:
        parts = F.filter(F.transform(F.split(x, UOB_BANKS), spaced), lambda p: p != "")
        longest = F.aggregate(parts, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
        front, back = r"^(\S+(?: \S+)*) \1(?= |$)", r"(?<!\S)(\S+(?: \S+)*) \1$"
        return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: F.contains(longest, p)), longest).when(x.rlike(front), F.regexp_replace(x, front, "$1")).otherwise(F.regexp_replace(x, back, "$1"))

    return edges(bound(s, once), " ,.-|")


UOB_LAST = r"(?:PBB|MBB|HLB|CIMB|RHB|ABMB|ABB|AMBG|OCBC|UOB)\s+([A-Z0-9&().'\-/ ]+?)(?=\|\||\||$)"
UOB = Rules(
    labels=(
        (r"^$", UNKNOWN),
        (r"\b(?:CHQ|CHEQUE|CHEQUE\s+DEPOSIT|CHQ\s+WDL|CHQ\s+PROCESSING\s+FEE)\b", "CHEQUE"),
        (r"\b(?:OD\s+INT\s+CHARGE|OD\s+COMMITMENT\s+FEE|OD\s+MAINTENANCE\s+FEE|SERVICE\s+CHARGE)\b", "BANK CHARGES"),
        (r"^DR\s+\S+\s+Trade\s+Bill\s+Transfer\b", "TRADE BILL TRANSFER"),
    ),
    captures=(
        # the last bank's code with a name behind it: a part between bars holds one, so the last bar's part decides
        (rf"^(?:.*\|\s*)?[^|]*?\b{UOB_LAST}(?!.*\b{UOB_LAST})", None),
        (r"^DuitNow/Instant\s+Trf\s+(?:C\d{5,}\s+)*(.+)$", None),
        (r"^Fund\s+Trf\s+EB\s+(.+)$", None),
    ),
    clean=uob_clean,
)

MAYBANK_STOP = ("REFUND", "PAYMENT", "PAY", "TRANSFER", "FUND", "MBB", "CT", "ADVANCE", "BAS", "HST", "REPAYMENT", "TRAIN", "ENCIK", "CIK")


def maybank_clean(c: Column) -> Column:
    s = off(spaced(c), r"^(?:TRANSFER\s+(?:TO|FR)\s+A/C|DUITNOW\s+TO\s+A/C|IBG\s+TO\s+A/C)\s+")
    s = off(s, r"^(?:TM\s+)?(UNIFI)\b.*$", by="$1")
    s = off(s, r"\*.*$", r"\b(?:REFUND|PAYMENT|PAY|TRANSFER|FUND|MBB|CT)\b.*$", r"\b(?:OR\s+CALL\s+US\s+AT|REF(?:ERENCE)?|ID|NO|INV(?:OICE)?|BILL)\b.*$")
    s = off(s, r"\bIBG\b(?:\s+(?:TRANSACTION|THROUGH)(?:\b.*)?)?$", r"(?:\s+|[-./])\d{6,}(?:[-./]\d+)*\s*$")
    return bound(F.split(spaced(F.regexp_replace(s, r"[^A-Z0-9/&()\s]", " ")), " "), maybank_words)


def maybank_words(raw: Column) -> Column:
    """Words that name somebody: no stop words, numbers or references; a single letter or ``&`` only between or before letters."""
    letters = lambda w: F.coalesce(w.rlike("^[A-Z]+$"), F.lit(False))

    def kept(w: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get(raw, i - 1)).otherwise(""), F.coalesce(F.get(raw, i + 1), F.lit(""))
        coded = w.rlike(r"\d") & (~w.rlike("[A-Z]") | (w.rlike(r"^[^A-Z]*(?:[A-Z][^A-Z]*){1,2}$") & w.rlike(r"(?:\d.*){3}")))
        single = (letters(before) & letters(after)) | ((i == 0) & letters(after) & (F.size(raw) >= 2)) | (before == "&") | (after == "&") | before.isin("BIN", "BINTI", "BT", "A/L", "A/P")
        return (w != "") & ~w.isin(*MAYBANK_STOP) & ~coded & ~w.rlike(r"^[A-Z]\d+$") & ((F.length(w) != 1) | single) & ((w != "&") | (letters(before) & letters(after)))

    found = F.filter(F.transform(raw, lambda w, i: F.when(kept(w, i), w)), lambda w: w.isNotNull())
    named = bound(found, lambda w: legal_words(F.array_join(w, " "), True))
    return F.array_join(F.slice(F.transform(F.split(named, " "), lambda w: F.when(w == "ENTERPR", "ENTERPRISE").otherwise(w)), 1, 5), " ")


MAYBANK = Rules(
    labels=((r"\bCDM\s+CASH\s+DEPOSIT\b", "CASH DEPOSIT"), (r"\bCASH\s+DEPOSIT\b", "CASH DEPOSIT"), (r"\bCASH\s+WITHDRAWAL\b", "CASH WITHDRAWAL")),
    captures=(
        # either side of a star may be the party: the left one behind a reference, the right one if the left holds a reference only
        (r"\bPAYMENT\s+FR\s+A/C\b\s+([^*]+)$", None),
        (r"\bPAYMENT\s+FR\s+A/C\b\s+([^*]+?)\s*\*\s*$", None),
        (r"\bPAYMENT\s+FR\s+A/C\b\s+[^\s*]*[_\d][^\s*]*\s+([^*]*[^*\s])\s*\*", None),
        (r"\bPAYMENT\s+FR\s+A/C\b\s+[^*]*[_\d][^*]*\*\s*(.+)$", None),
        (r"\bPAYMENT\s+FR\s+A/C\b\s+([^*]*[^*\s])\s*\*", None),
        (r"\bINTER-BANK\s+PAYMENT\s+INTO\s+A/C\b\s+([A-Z][A-Z\s]+?\b(?:BIN|BINTI|BT|A/L|A/P)\b\s+[A-Z]+)\b", None),
        (r"\bCMS\s*-\s*CR\s+PYMT\s+MARS\b\s+(.+)$", None),
        (r"\bCREDIT\s+INWARD\s+RENTAS\b\s+(.+)$", None),
        (r"\bESI\s+PAYMENT\s+DEBIT\b\s+(.+)$", None),
        (r"\bPAYMENT\s+FR\s+A/C\b(?:\s+(?=[A-Z0-9]*\d)[A-Z0-9]+)?\s*\*?\s*(.+)$", None),
        (r"\bELECTRONIC\s+REMITTANCE\s*-\s*GIR\b\s+(.+)$", None),
        (r"\bA/C\b\s+(.+)$", None),
    ),
    clean=maybank_clean,
    upper=True,
)

#: The banks with rules, by the names that ``statements.BANKS`` gives them; ``banks.register_all`` adds those of ``partybanks``.
BANK_RULES: dict[str, Callable[[Column], Column]] = {
    "Agro Bank": agro,
    "Ambank": AMBANK.party,
    "Bank Islam": ISLAM.party,
    "Bank Rakyat": RAKYAT.party,
    "Maybank": MAYBANK.party,
    "OCBC": OCBC.party,
    "Public Bank (PBB)": PBB.party,
    "UOB Bank": UOB.party,
}


def bank_party(bank: Column, text: Column) -> Column:
    """the party that the row's bank names in its text; UNKNOWN for null texts, and null for banks without rules."""
    out = F.lit(None).cast("string")
    for name, rule in BANK_RULES.items():
        out = F.when(bank == name, rule(text)).otherwise(out)
    return out


def annotate(tx: DataFrame, file: str = "file", bank: str = "bank", text: str = "description", given: tuple[str, ...] = ()) -> DataFrame:
    """``party_raw`` and ``party`` for every row: a given name or the bank's, then one spelling per statement.

    Spellings are merged over the distinct names of one file, which a statement's length bounds; rows are not grouped.
    Null files merge among themselves. Columns of these two names are replaced.
    """
    from ..operators.names import alias_map

    named = F.coalesce(*(F.nullif(F.upper(spaced(F.col(c))), F.lit("")) for c in given), bank_party(F.col(bank), F.col(text)), F.lit(UNKNOWN))
    rows = tx.drop("party", "party_raw").withColumn("party_raw", named)
    counts = rows.groupBy(F.col(file).alias("__file"), F.col("party_raw").alias("__raw")).agg(F.count("*").alias("__n"))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        made = alias_map(dict(zip(pdf["__raw"], pdf["__n"], strict=True)))
        return pd.DataFrame({"__file": pdf["__file"], "__raw": pdf["__raw"], "party": pdf["__raw"].map(made)})

    kind = dict(tx.dtypes)[file]
    names = counts.groupBy("__file").applyInPandas(merged, f"__file {kind}, __raw string, party string")
    return rows.join(names, rows[file].eqNullSafe(names["__file"]) & (rows["party_raw"] == names["__raw"])).drop("__file", "__raw")

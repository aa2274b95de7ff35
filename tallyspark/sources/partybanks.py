"""Parties in texts of Bank Muamalat, CIMB Bank, Hong Leong and RHB Bank (F34): notes stand before and behind the name, or the
name is a line of its own, so the rules peel words off both ends and choose among lines instead of capturing one group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S
from .bankparties import UNKNOWN, bound, edges, group, off, spaced, suffix

#: Notes before a name are peeled off up to so many deep; regular expressions recurse once for each.
DEEP = 64


def peeled(c: Column, patterns: tuple[str, ...], between: str = r"[ ,.-]*") -> Column:
    """Without what fits any of the patterns at the beginning, again and again."""
    return F.regexp_replace(c, "(?i)^(?:(?:" + "|".join(patterns) + rf"){between}){{1,{DEEP}}}", "")


def from_word(words: Column, first: Column) -> Column:
    """The words from the index ``first`` on, counted from 0; none where it is null."""
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(words, first + 1, F.greatest(F.size(words) - first, F.lit(0))))


def first_index(words: Column, fits) -> Column:
    """The index of the first word that fits, null if none does."""
    return F.get(F.filter(F.transform(words, lambda w, i: F.when(fits(w), i)), lambda i: i.isNotNull()), F.lit(0))


def trimmed_words(words: Column, front, back) -> Column:
    """Without the words at the front that ``front`` is true of, then those at the back for ``back``."""
    kept = bound(words, lambda x: from_word(x, first_index(x, lambda w: ~front(w))))
    turned = bound(F.reverse(kept), lambda x: from_word(x, first_index(x, lambda w: ~back(w))))
    return F.reverse(turned)


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


# --- Bank Muamalat ----------------------------------------------------------------------------------------------

# Notes before a name, and the channels' layouts.
MUAMALAT_NOTES = (
    r"(?:\d+(?:ST|ND|RD|TH)\s+)+",
    r"\d+[A-Z]\s+",
    r"(?:INV(?:OICE)?(?:\s+NO\.?|\s+NO:|\s+NO\s+KP|\.?)?|NO\.?|NO:|YOUR\s+REF:?|REF:?)\b\s*[:./-]?\s*(?:KP\s+)?(?:[A-Z]*\d[A-Z0-9/.,&:-]*\s+)*",
    r"(?:JAN|FEB|MAR|MARCH|APR|MAY|JUN|JUNE|JUL|AUG|AUGUST|SEP|SEPT|OCT|OCTOBER|NOV|DEC)\s+(?:INV(?:OICE)?\s+)?",
    r"(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\d{2,4}\s+",
    r"\(\d+(?:ST|ND|RD|TH)\)\s+",
    r"\(?\d+\s*PAX\)?\s+",
    r"\([A-Z0-9]+\s+[A-Z0-9]+\s+[A-Z]{2,}\d+\s+",
    r"(?:HP[- ]?)?[A-Z]{2,6}\s+\d{2,}\s+",
    r"(?:[A-Z]{1,8}[-_/]*)?\d[A-Z0-9()./,&:-]*(?:\s*&\s*[A-Z]{0,8}\d[A-Z0-9()./,&:-]*)*\s+",
    r"(?:CLAIM|PAYMENT|REPAYMENT|PARTIAL\s+PAYMENT\s+LOAN|PARTIAL\s+PAYMENT|EXP(?:ENSES?)?|NONE|SETTLEMENT|ENTERTAINMENT|ADVANCE\s+OUTSTATION|OUTSTATION(?:\s+EXP(?:ENSES?)?)?"
    r"|OFFICE\s+SUPPLIES|OFFICE\s+EQUIPMENT|OFFICE\s+MAINTENANCE|FLIGHT\s+(?:TICKET|TIX)|FUND(?:\s+OVERHEAD(?:\s+[A-Z0-9]+)?)?|INSURAN\s+ROADTAX(?:\s+[A-Z0-9]+)?|TRANSFER\s+TO\s+BMMB|TO\s+BMMB"
    r"|PURCHASE(?:\s+OF|\s+FOR)?|RENEW\s+INSURANCE|ROADTAX(?:\s+[A-Z0-9]+)?|STAFF\s+REMUNERATION|TAJAAN\s+RAMADAN|PHONE\s+ALLOWANCE(?:\s+JUN)?|PETTY\s+CASH|DISBURSE(?:\s+\([^)]*\))?|LOAN|OVERHEAD|GRAB|CR|TR)\b[\s,./&:-]*",
)
MUAMALAT_REFERENCES = (r"INV(?:OICE)?", r"INV NO\.?", "CLAIM", "PAYMENT", "REPAYMENT", "FUND", "JV", "EMS", "HP", "SR-", "QM-", "TT", "PE-", "MBINV", r"L-\d+", r"B\d+\w+", r"\d{5,}", r"[:\-/&.,\s]")
MUAMALAT_CAPTURES = (
    (r"^FPX DEBIT\s+\S+\s+\S+\s+\S+\s+(.+)$", False),
    (r"^DEBIT ADVICE\s+\S+\s+(.+)$", False),
    (r"^Direct Debit\s+(.+?)(?:\s+MBIBT|\s+E-\d|$)", False),
    (r"^(?:BILL PAYMENT DEBIT|SERVICE CHARGE/MISC)\s+Fund Transfer\s+(.+)$", True),
    (r"^BILL PAYMENT DEBIT\s+\S+\s+\S+\s+(.+)$", False),
    (
        r"^(?=.*\bDUITNOW\b)(?:DUITNOW TRANSFER\s+)?(?:\S+\s+){1,4}(?:DuitNow\s+.*?)?([A-Z0-9&().'\-/ ]+(?:SDN\.?\s*BHD|SDN\s+BHD|BHD|BERH|MAXIS|UNIFI|IWK|AIR SELANGOR|TENAGA NASIONAL|PERBADANAN|LEMBAGA).*)$",
        False,
    ),
    (r"^(?:TFR/SAL/MISC|TRF/SAL/MISC/AFT)\s+(.+)$", True),
)
MUAMALAT_PERSON = r"([A-Z][A-Z .']+\s+(?:BIN|BINTI|A/L|A/P)\s+[A-Z .']+)$"
MUAMALAT_COMPANY = (
    r"([A-Z0-9&().'\-/ ]+\b(?:SDN BHD|BHD|ENTERPRISE|RESOURCE|RESOURC|SERVIC|SERVICES|LOGISTIC|LOGISTICS|ENGINEERING|TRADING|AGENCIES|OFFSHORE|EMPIRE|CORONA|CREDIT|UNIFI|MAXIS|TENAGA NASIONAL|AIR SELANGOR|IWK"
    r"|PERBADANAN|LEMBAGA|PERTUBUHAN|KUMPULAN WANG SIMPAN|ZAKAT SELANG|HASIL DALAM))$"
)


def muamalat_suffix(c: Column) -> Column:
    """Spellings of SDN, and behind it of BHD; nothing stands behind the legal form."""
    words = F.transform(F.split(c, " "), lambda w: bound(F.btrim(w, F.lit(" .,-")), lambda x: F.when(x.isin("SN", "SND", "SD"), "SDN").otherwise(x)))
    words = F.filter(words, lambda w: w != "")

    def ended(w: Column) -> Column:
        at = F.array_position(w, "SDN").cast("int")
        return F.when(at > 0, F.concat(F.slice(w, 1, F.greatest(at, F.lit(1))), F.array(F.lit("BHD")))).otherwise(w)

    return joined(bound(words, ended))


def muamalat_clean(c: Column) -> Column:
    notes = lambda x: edges(peeled(edges(x), (*MUAMALAT_NOTES, r"[&/.,:-]+\s*")))
    s = suffix(F.upper(edges(c)))
    s = peeled(s, MUAMALAT_REFERENCES, "")
    s = off(notes(s), r"^\*\d+(?:[*&./:-]\d+)*\s*", r"^(?:[*&./:-]*\d+){2,}[*&./:-]*\s+", r"\b\d{6,}\b")
    s = F.regexp_replace(notes(s), r"^(\S+(?: \S+){0,3}) (?=\1(?: |$))", "")
    return bound(muamalat_suffix(edges(s)), lambda x: F.when(x == "", UNKNOWN).otherwise(x))


def muamalat(text: Column) -> Column:
    """Bank Muamalat: the channel's name; in transfers the person or company that ends the text."""

    def inside(x: Column) -> Column:
        return F.coalesce(group(x, MUAMALAT_PERSON), group(x, MUAMALAT_COMPANY), x)

    def named(s: Column) -> Column:
        fit = F.coalesce(*(F.when(s.rlike(f"(?i){p}"), F.struct(F.regexp_extract(s, f"(?i){p}", 1).alias("raw"), F.lit(body).alias("body"))) for p, body in MUAMALAT_CAPTURES))
        found = bound(fit, lambda f: F.when(f.isNotNull(), bound(muamalat_clean(f["raw"]), lambda x: F.when(f["body"], muamalat_clean(inside(x))).otherwise(x))))
        cheque = F.when(s.rlike(r"(?i)\b(?:CHEQUE|CHQ|CEK|CHEQUE ISSUANCE|NO\.CEK)\b"), "CHEQUE").when(s.rlike(r"(?i)\bPROFIT PAID\b"), "PROFIT PAID")
        return F.coalesce(cheque, found, F.when(s.rlike(r"(?i)^SERVICE CHARGE/MISC\b"), "BANK CHARGES"), F.lit(UNKNOWN))

    return bound(spaced(text), named)


# --- RHB Bank ---------------------------------------------------------------------------------------------------

# Channels whose text holds a party behind ten digits, transfers, notes behind a name.
RHB_CHANNEL = (
    r"^(?:RFLX\s+INSTANT\s+TRF\s+DR|RFLX\s+INST\s+TRF\s+CR\s+REV|RPP\s+INWARD\s+INST\s+TRF\s+CR|MBK\s+INSTANT\s+TRF\s+DR|IBK\s+INSTANT\s+TRF\s+DR|MB\s+FUND\s+TRF-(?:CR|DR)|DUITNOW\s+QR\s+P2P\s+(?:CR|DR)"
    r"|DUITNOW\s+QR\s+POS\s+(?:CR|DR)|REFLEX-FUNDS\s+TFR\s+(?:CR|DR)|FPX\s+B2B\s+BUYER\s+DR|FPX\s+DD\s+SELLER\s+DR|INWARD\s+IBG|MB\s+NBPS\s+PYMT\s+DR|MYDEBIT\s+-|IBK\s+FPX-B2C\s+DR)\s+\d{10}\s*(.*)$"
)
RHB_TRANSFER = r"^(?:RPP\s+INWARD\s+INST\s+TRF|RFLX\s+INSTANT\s+TRF|REFLEX\s+INST\s+TRF)(?:\s+(?:CR|DR))?(?:\s+\d{6,})?\s+(.+)$"
RHB_NAMELESS = r"^(LOCAL CHQ DEP|RFLX INSTANT TRF SC DR|REFLEX INST TRF SC REV|RFLX INSTANT TRF DR \d{10}$|RPP INWARD INST TRF CR \d{10}$)"
RHB_NOTES = r"\s+(?:FUND\s+TRANSFER|QR\s+PAYMENT(?:\s+QR\s+\S*)?|PAYMENT\s+QR\s+\S*|INSTANT\s+TRANSFER|TRANSFER|REVERSAL|REV)"
RHB_COMPANY = r"(?i)\b(?:SDN\.?\s*BHD\.?|BHD\.?|ENTERPRISE|TRADING|SERVICES|RESOURCES|MARKETING)\b"
RHB_QR = r"^(?:(?=[A-Z0-9]*\d)[A-Z0-9]{12,}|[A-Z]{1,5}\d{8,}|\d{8,})?\s*QR\s+(?:P2P|POS)\s+PAYMENT\s+(.*?)(?:\s+(?:(?=[A-Z0-9]*\d)[A-Z0-9]{12,}|[A-Z]{1,5}\d{8,}|\d{8,})(?:\s+\S+)*)?$"
RHB_NUMBER = r"(?:\d{5,}|(?=[A-Z0-9]*\d)[A-Z0-9]{10,})"


def is_number(w: Column) -> Column:
    """A reference: five digits or more, or ten letters and digits."""
    return F.btrim(w, F.lit(" -/.")).rlike(f"(?i)^{RHB_NUMBER}$")


def or_all(made: Column, c: Column) -> Column:
    return F.coalesce(F.nullif(made, F.lit("")), c)


def rhb_without_tail(c: Column) -> Column:
    """Without the numbers that end a transfer, if one of them is a reference."""

    def cut(s: Column) -> Column:
        plain = lambda w: bound(F.btrim(w, F.lit(".,")), lambda x: is_number(x) | x.rlike(r"^\d+$"))
        words = F.split(s, " ")
        kept = trimmed_words(words, lambda w: F.lit(False), plain)
        return bound(kept, lambda k: F.when(F.exists(F.slice(words, F.size(k) + 1, F.size(words)), lambda w: is_number(F.btrim(w, F.lit(".,")))), or_all(joined(k), s)).otherwise(s))

    return bound(spaced(c), cut)


def rhb_company(c: Column) -> Column:
    """Without a note in small letters before a company in capitals."""

    def cut(w: Column) -> Column:
        capital = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")
        rest = F.transform(w, lambda x, i: F.when((i > 0) & capital(x) & joined(F.slice(w, i + 1, F.size(w))).rlike(RHB_COMPANY), i))
        at = F.get(F.filter(rest, lambda i: i.isNotNull()), F.lit(0))
        return bound(at, lambda i: F.when(i.isNotNull() & joined(F.slice(w, 1, F.greatest(i, F.lit(0)))).rlike(r"\p{Ll}"), F.btrim(joined(from_word(w, i)), F.lit(" -/."))).otherwise(joined(w)))

    return bound(F.split(spaced(c), " "), cut)


def rhb_clean(c: Column) -> Column:
    s = off(off(c, r"\bA\s*/\s*([LP])\b", by="A/$1"), r"^(?:\d{12,}\s+)+", r"^invoice\s+T\d+\s+", r"^(?:PV\d+\s+)?(?:AP-\d+(?:-\d+)?\s+)?", r"^(?:\d{12,}\s+|(?=[A-Z0-9]*\d)[A-Z0-9]{10,}\s+)+")
    s = off(s, r"^(?:IBK\s+)?", r"^(?:RHBQR\d+|MAEPP\d+|[0-9]{10,}RHBQR\d+)\s*")
    s = off(bound(s, lambda x: F.coalesce(F.trim(group(x, RHB_QR)), x)), r"^QR\s+(?:P2P|POS)\s+PAYMENT\s+")
    # a single letter before a reference goes with it
    s = bound(spaced(s), lambda x: or_all(F.trim(F.regexp_replace(x, rf"(?i)^(?:(?:[A-Z] )?[-/.]*{RHB_NUMBER}[-/.]*(?: |$))+", "")), x))
    s = spaced(off(s, r"\bQR\s+PAYMENT\b.*$", r"\bFUND\s+TRANSFER\b", r"\bQR\b", by=" "))
    s = bound(s, lambda x: or_all(joined(F.filter(F.split(x, " "), lambda w: ~is_number(w))), x))
    s = off(s, r"\b(TM UNIFI)\s+\1\b.*$", by="$1")
    s = rhb_company(off(s, r"\s+(?:[L]?MY\s+)?CARD\s+\d+\b.*$"))
    s = F.regexp_replace(s, r"(?i)^(([A-Z0-9/&@().\s-]+?)\s+\([A-Z0-9/&@().\s-]+\))\s+\2\b.*$", "$1")
    small = r"^([^\p{Ll}\s]+(?: [^\p{Ll}\s]+)+) \S*\p{Ll}.*$"
    s = bound(F.btrim(s, F.lit(" -/.")), lambda x: F.when(F.regexp_extract(x, small, 1).rlike(r"\p{Lu}"), F.btrim(F.regexp_extract(x, small, 1), F.lit(" -/."))).otherwise(x))
    s = off(s, rf"(?:{RHB_NOTES}){{1,{DEEP}}}\s*$", r"\s+(?:\d{5,}|RHBQR\d+|MAEPP\d+|(?=[A-Z0-9]*\d)[A-Z0-9]{12,})$")
    s = off(off(s, r"\bSDN\.\s*B(?:HD)?\.?\b", r"\bSDN\s+B\b", by="SDN BHD"), r"\b(SDN\s+BHD)\b.*$", by="$1")
    s = F.regexp_replace(spaced(s), r"^(\S+(?: \S+)*) \1$", "$1")
    return edges(F.regexp_replace(F.upper(s), r"[^A-Z0-9/&@().\s-]", " "), " -/.")


def rhb(text: Column) -> Column:
    """RHB Bank: behind the channel and its references, before notes in small letters."""

    def named(s: Column) -> Column:
        sent = bound(off(group(s, RHB_TRANSFER), r"\bA\s*/\s*([LP])\b", by="A/$1"), lambda x: F.when(x.isNotNull(), edges(rhb_without_tail(F.get(F.split(x, r"\s+/\s+"), F.lit(0))), " -/.")))
        raw = F.coalesce(F.nullif(sent, F.lit("")), group(s, RHB_CHANNEL))
        found = bound(raw, lambda x: F.when(x.isNotNull(), rhb_clean(x)))
        found = bound(found, lambda x: F.when((x == "") | x.isin("IBK", "RHBQR000000") | x.rlike(r"^\d+$"), UNKNOWN).otherwise(x))
        label = F.when(s.rlike(r"(?i)^(?:ATM\s+)?CASH WITHDRAWAL\b"), "CASH WITHDRAWAL").when(s.rlike(r"(?i)^(?:CDT\s+|CDM\s+)?CASH DEPOSIT\b"), "CASH DEPOSIT")
        return F.coalesce(label, F.when(s.rlike(r"(?i)^SERVICE CHARGE\b") | s.rlike(f"(?i){RHB_NAMELESS}"), UNKNOWN), found, F.lit(UNKNOWN))

    return bound(spaced(text), named)


# --- Hong Leong -------------------------------------------------------------------------------------------------

# Labels, what is cut, shapes of names, words that begin or end no name.
HONG_LABELS = (
    (r"^(?:Cheque\s+Processing\s+Fee|Serv\s+Charge|Remittance\s+Commission)\b", "BANK FEES"),
    (r"^(?:CA\s+Cash\s+Withdrawal|CA\s+IBT\s+Debit\s+Advice|CA\s+Debit\s+Advice)\b", "CASH WITHDRAWAL"),
    (r"^CDM\s+Deposit\b", "CASH DEPOSIT"),
    (r"^(?:CA\s+(?:IBT\s+)?Cash\s+Cheque|Local\s+Cheque)\b", "CHEQUE"),
    (r"^Bulk\s+DuitNow\b", "BULK DUITNOW"),
)
HONG_CUTS = (
    r"\bHong\s+Leong(?:\s+Islamic)?\s+Bank\s+Berhad\b.*$|\bProtected\s+by\s+PIDM\b.*$|\bDilindungi\s+oleh\s+PIDM\b.*$|\bMenara\s+Hong\s+Leong\b.*$",
    r"^\s*(?:HLConnect\s+DuitNow-previously\s+Inst|CIB\s+Instant\s+Transfer(?:\s+Reversal)?|Instant\s+Transfer|Cr\s+Adv-Interbank\s+GIRO|FPX\s+Collection|FPX\s+B2B1|JomPAY\s+Bill\s+Payment"
    r"|CIB\s+IBG\s+CA\s+Debit\s+Advice|Fund\s+Trf\s+fr\s+CA\s+to\s+CA-Internet|Fund\s+Transfer|Bulk\s+DuitNow)(?:\s+at\s+\w+)?\s*",
    r"\b(?:\d{8}[A-Z]{4}MYKL\d{3}[A-Z0-9]+|IBGCMP[A-Z0-9]+|CTHLCF[A-Z0-9]+|CPTJ[A-Z0-9]+|I\d{10,}|24IM\d+)\b.*$",
)
HONG_DIRECT = (
    r"\b(TENAGA\s+NASIONAL\s+BERHAD|TM\s+UNIFI|MAXIS|CITY-LINK\s+EXPRESS(?:\s+SHAH)?|NATIONAL\s+INSTITUTE\s+OF\s+OCCUPATI|LEMBAGA\s+HASIL\s+DALAM\s+NEGERI\s+MAL)\b",
    r"(?=\b([A-Z][A-Z0-9 &'()./@-]{2,}?\s+&\s+(?:ASSOCIATES|CONSULTANCY|PARTNERS(?:\s+\(?CLIENT'?S?\s+ACCOUNT\)?)?|CONSTRUCT(?:ION)?|CO(?:\s+CLIENT\s+ACCOUNT)?))\b)",
    r"(?=\b([A-Z][A-Z0-9 &'()./@-]{2,}?\s+(?:SDN\.?\s*BHD\.?|SDN\.?\s*B\.?|SDN\.?|S\s*/\s*B|SB|BHD\.?|BERHAD))\b)",
)
HONG_PERSON = (
    r"\b([A-Z][A-Z.'@/-]+(?:\s+[A-Z][A-Z.'@/-]+){1,5}\s+(?:BIN|BINTI|BINTE|BT|BTE|A/L|AL|BI)\s*(?:[A-Z][A-Z.'@/-]+(?:\s+[A-Z][A-Z.'@/-]+){0,4})?)\b",
    r"\b([A-Z][A-Z.'@/-]+(?:\s+[A-Z][A-Z.'@/-]+){0,5}\s+(?:BIN|BINTI|BINTE|BT|BTE|A/L|AL)\s*(?:[A-Z][A-Z.'@/-]+(?:\s+[A-Z][A-Z.'@/-]+){0,4})?)\b",
)
HONG_COMPANY = r"\b([A-Z0-9][A-Z0-9 &'()./@-]{2,}\b(?:SDN\.?\s*BHD\.?|SDN\.?\s*B\.?|BHD\.?|BERHAD|ENTERPRISE|RESOURCES|SERVICES|SERVICE|WORKS|MANAGEMENT|COUNCIL|INSURANCE|EXPRESS|UNIFI|MALAYSIA|MEDIA)\b(?:\s*-\s*[A-Z])?)"
HONG_FRONT = (
    "A/C", "ADV", "ADVANCE", "ADVANVE", "AMG", "AMPANG", "APR25", "APR2025", "ASDT", "ASDTNC", "BAKI", "BAL", "BALIK", "BAYARAN", "BERNIAGA", "BIZ", "BLN", "BRG2", "BYRN", "CARD", "CASH", "CATERING", "CC",
    "CLAIM", "CONSULTANCY", "CREDIT", "CCTV", "CYLINDER", "DEED", "DEPO", "DISBURSEMENT", "DTD", "DUIT", "FIRE", "FOR", "FUND", "GAJI", "GAJAH", "GAS", "GE", "HANG", "HIACE", "HILIR", "HITAM", "INV", "IV",
    "INTERBANK", "INVOICES", "INVOIS", "ISPS", "ITEMS", "JLN", "JUNE", "JUNE2", "KATERING", "KELANG", "KTERING", "KUBANG", "LAMA", "FEE", "LEGAL", "MAC", "MASJID", "MAY25", "MEI", "MODAL", "MONKIARA",
    "MOREH", "N", "NEGAR", "NEGARA", "NETWORK", "NITRO", "OFF", "ONM", "OPINION", "OPS", "P", "PAX", "PAY", "PAYMENT", "PEJABAT", "PEKERJA", "PETTY", "PLAQUE", "PLASTIK", "PPC", "PURCHASE", "RACK", "CARGO",
    "RAYA", "RENT", "RENTAL", "REPAIR", "RORO", "RR", "RTM", "SAMPLE", "SEMINAR", "SERVICE", "SERVICES", "SITE", "SOLAR", "STAFF", "SYSTEM", "TRANSPORT", "TRANSPORTATION", "TRANSFER", "TRAVEL", "TUAH",
    "INSTALMENT", "KSB", "KUIH", "ALLOWANCE", "CALIBRATE", "CHALOK", "JOHOR", "MMHE", "MTCE/RR", "SEPAT", "FNB", "PJO", "50PCT", "IP", "PBX",
)
HONG_BACK = ("C", "CA", "C/A", "_")
PARENTS = ("BIN", "BINTI", "BINTE", "BT", "BTE", "A/L", "AL")


def hong_clean(c: Column) -> Column:
    """A candidate in capitals without references and notes at its ends, at most three words before a parent's name."""
    s = F.regexp_replace(F.regexp_replace(F.upper(c), "_+", " "), r"[^A-Z0-9&'()./@ -]+", " ")
    s = off(s, r"^.*?\bADVANCE\s+PAYMENT\s+", r"^\s*2ND\s+INSTALMENT\s+")
    s = off(s, r"\bS\s*/\s*B\b", r"\bSB\b", r"\bSDN\.?\s*B\.?\b", r"\bSDN\.?\s*BHD\.?\b", r"\bSDNBHD\b", r"\bSDN\s*$", r"\bSD\s*$", by="SDN BHD")
    s = edges(off(s, r"\bBERHAD\b", by="BHD"), " .,-")
    reference = lambda w: w.rlike(r"^\d+$") | (F.contains(w, F.lit("/")) & (F.length(w) >= 4)) | (w.rlike(r"\d") & (F.length(w) >= 5))
    words = F.filter(F.transform(F.split(s, " "), lambda w: F.btrim(w, F.lit(" .,-"))), lambda w: w != "")
    words = trimmed_words(words, lambda w: w.isin(*HONG_FRONT) | reference(w), lambda w: w.isin(*HONG_BACK) | reference(w))

    def near(w: Column) -> Column:
        at = F.get(F.filter(F.transform(w, lambda x, i: F.when(x.isin(*PARENTS) & (i > 3), i)), lambda i: i.isNotNull()), F.lit(0))
        return joined(bound(at, lambda i: F.when(i.isNull(), w).otherwise(from_word(w, i - 3))))

    s = F.regexp_replace(F.regexp_replace(edges(bound(words, near), " .,-"), r"\s+\)", ")"), r"\(\s+", "(")
    opened = lambda x: F.length(F.regexp_replace(x, r"[^(]", "")) > F.length(F.regexp_replace(x, r"[^)]", ""))
    return bound(s, lambda x: F.when(opened(x) & ~F.endswith(x, F.lit(")")), F.concat(x, F.lit(")"))).otherwise(x))


def hong_longest(names: Column, legal: bool) -> Column:
    """Of the cleaned candidates the one with a legal form (if that counts), most words, most characters; the first of equals."""
    rated = lambda x: F.struct((F.lit(legal) & x.rlike(r"\b(?:SDN\s+BHD|BHD|BERHAD|S/B|SB)\b")).alias("l"), F.size(F.split(x, " ")).alias("w"), F.length(x).alias("c"))
    kept = F.filter(F.transform(names, hong_clean), lambda x: (x != "") & ~x.rlike(r"^(?:SDN\s+BHD|SDN|BHD|BERHAD|M\)?\s+BHD)$"))
    start = F.lit(None).cast("struct<r:struct<l:boolean,w:int,c:int>,x:string>")
    best = F.aggregate(kept, start, lambda a, x: bound(rated(x), lambda r: F.when(a.isNull() | (r > a["r"]), F.struct(r.alias("r"), x.alias("x"))).otherwise(a)))
    return best["x"]


def hong_leong(text: Column) -> Column:
    """Hong Leong: the best of the companies named anywhere in the text, else the last person, else what the notes leave."""

    def named(s: Column) -> Column:
        label = F.coalesce(*(F.when(s.rlike(f"(?i){p}"), to) for p, to in HONG_LABELS))
        return F.coalesce(label, F.nullif(bound(body(s), party), F.lit("")), F.lit(UNKNOWN))

    def body(s: Column) -> Column:
        return spaced(off(off(s, *HONG_CUTS), r"\b\d{1,3}(?:,\d{3})*\.\d{2}\b", r"\b[A-Z]{1,3}\d{4,}[A-Z0-9./-]*\b", by=" "))

    def every(b: Column, p: str) -> Column:
        return F.regexp_extract_all(b, F.lit(f"(?i){p}"), F.lit(1))

    def party(b: Column) -> Column:
        person = F.coalesce(*(F.element_at(F.when(F.size(every(b, p)) > 0, every(b, p)), -1) for p in HONG_PERSON))
        return F.coalesce(hong_longest(F.concat(*(every(b, p) for p in HONG_DIRECT)), True), F.nullif(hong_clean(person), F.lit("")), hong_longest(every(b, HONG_COMPANY), False), hong_clean(b))

    return bound(spaced(text), named)


# --- CIMB Bank --------------------------------------------------------------------------------------------------

# Lines that are no names, channels with their parties, purposes behind a person's name.
CIMB_NO_NAME = (
    r"^(?:IBG CREDIT|AUTOPAY CR|AUTOPAY DR|AUTOPAY CHARGES|DUITNOW TO ACCOUNT|TR TO SAVINGS|TR TO C/A|TR IBG|REMITTANCE CR|I-PAYMENT|JOMPAY|OTHER TRANSFER FEE|HOUSE CHQ DR|HSE CHQ DEPOSIT|2D LOCAL CHQ"
    r"|CHQ PROCESSING FEE|ACCOUNT STATUS CONFIRMATION CHARGE|IBG INWARD RETURN|I-FUNDS TR FROM SA)$|^\d{4,}$|^[A-Z0-9]{8,}$|\.TXT$|^[\d/., -]+$|\d{5,}"
)
CIMB_RULES = (
    (r"\b(?:CHQ|CHEQUE)\b", "CHEQUE"),
    (r"^(?:CDM\s+)?CASH\s+DEPOSIT$", "CASH DEPOSIT"),
    (r"\b(?:CHG|CHARGE|TAX|SST)\b", "SERVICE CHARGE"),
    (r"^JOMPAY\s+(\S+).*$", None),
    (
        r"^TR IBG\s+(.+?)(?:\s+(?:CLAIM|GENERAL LABOUR|AC|DET\s+\d+|ROADTAX.*|INSURANCE.*|HOUSE\s+RENTAL.*|RENTAL.*|SEWA.*|PAYMENT.*|INVOICE.*|PETTY\s+CASH.*|EC\s+EXCEL.*|TRANSFER\s+BACK.*|MONTHLY\s+INSTALMENT.*|[A-Z]{0,3}\d{3,}[A-Z0-9]*))?$",
        None,
    ),
    (r"^TR TO\s+(?:C/A|SAVINGS)\s+(.+?)(?:\s+(?:AC|FROM\s+.+|GENERAL LABOUR|SPONSER.*))?$", None),
    (r"^TR FROM\s+(?:CA|SA)\s+.+?\s+([A-Z][A-Z0-9&()./\- ]{3,})$", None),
    (r"^DUITNOW TO ACCOUNT\s+\S+\s+([A-Z][A-Z0-9&()./\- ]{3,})$", None),
    (r"^IBG CREDIT\s+(?:INTERBANK\s+GIRO\s+)*([A-Z][A-Z0-9&()./\- ]+)$", None),
    (r"^I-FUNDS TR FROM\s+(?:CA|SA)\s+.+?\s+([A-Z][A-Z0-9&()./\- ]{3,})$", None),
    (r"^I-PAYMENT\s+FPXPAY\s+(.+?)(?:\s+[A-Z]?\d{6,}.*)?$", None),
    (r"^I-PYMT TO\s+CCARD\s+(.+?)(?:\s+[A-Z]?\d{6,}.*)?$", None),
    (r"^REMITTANCE CR(?:\s+([A-Z][A-Z .&()/-]{3,}))?$", None),
    (r"^(DEBIT ADVICE(?: LETTER SUPPORT FEES?)?|BIZCHANNEL MTHLY FEE|COMMISSION - CO|STAMP DUTY - CO|ACCOUNT STATUS CONFIRMATION CHARGE CHARGES|SERVICE CHARGE CANCELLATION BCQ|CLOSING BALANCE / BAKI PENUTUP)$", None),
    (r"^ATM TRANSFER FROM\s+(?:CA|SA)$", "ATM TRANSFER"),
    (r"^IBG INWARD RETURN .+$", "IBG RETURN"),
)
CIMB_DUITNOW = (r"^DUITNOW TO ACCOUNT\s+\S+\s+\S+\s+([A-Z][A-Z0-9&()./\- ]{3,})$", r"^DUITNOW TO ACCOUNT\s+\S+\s+([A-Z][A-Z0-9&()./\- ]{3,})$", r"^DUITNOW TO ACCOUNT\s+(?:ONLINE\s+TRANSFER\s+){1,2}([A-Z][A-Z0-9&()./\- ]{3,})$")
CIMB_FROM = r"^TR FROM\s+(?:CA|SA)\s+.+?\s+([A-Z][A-Z0-9&()./\- ]{3,})$"
CIMB_PERSON = r"\b(?:BIN|BINTI|BT|B|ANAK)\b"
CIMB_PURPOSE = (
    r"\s+(?:HOUSE\s+RENTAL|GENERAL\s+LABOUR|PETTY\s+CASH|EC\s+EXCEL|CLAIM|MILEAGE|LOAN|ROADTAX|INSURANCE|RENTAL|TENDER|FAREWELL|TRANSFER\s+BACK(?:\s+TO\b.*)?|MONTHLY\s+INSTALMENT|HP\s+MONTHLY|DIRECTOR(?:\s+FEE)?"
    r"|PERUNTUKAN(?:\s+BAJET)?|BAJET)\b.*$"
)
CIMB_PLACE = r"^(?:HOSPITAL\s+\S+|KLINIK\s+\S+|CLINIC\s+\S+|PUSAT\s+\S+|SEKOLAH\s+\S+|SCHOOL\s+\S+)\s+"
CIMB_NO_PERSON = r"^(?:PERUNTUKAN|BAJET|HOSPITAL|KLINIK|CLINIC|PUSAT|SEKOLAH|SCHOOL)(?:\s+.*)?$"
CIMB_FORMS = ("SDN", "BHD", "BERHAD", "PLT", "LLP", "PL", "ENTERPRISE", "TRADING")
CIMB_TAIL = r"\b(?:REF(?:ERENCE)?|TRACE|ID|NO|TXN|TRANSACTION|ACC(?:OUNT)?|A/C|PAYMENT|INVOICE|INV)\b.*$"


def cimb_name(c: Column) -> Column:
    """Capitals, the legal form at the end spelled out, a person without the purpose; UNKNOWN for what names nobody."""
    s = spaced(F.regexp_replace(F.upper(F.trim(c)), r"[^A-Z0-9/&().\s-]", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"\bSDN\.?\s*BH?$", "SDN BHD"), r"\bSDN\.?\s*BHD\.?$", "SDN BHD")
    short = lambda x: F.trim(off(x, CIMB_PURPOSE))
    s = bound(s, lambda x: F.when(x.rlike(CIMB_PERSON), bound(short(x), lambda y: F.when(y.rlike(CIMB_PERSON), y).otherwise(x))).otherwise(x))
    return bound(s, lambda x: F.when((x == "") | S.no_counterparty(x), UNKNOWN).otherwise(x))


def cimb_person(body: Column) -> Column:
    """The party of a transfer to a person, null where its text does not look like one."""

    def inside(cleaned: Column) -> Column:
        return bound(F.trim(off(cleaned, CIMB_PURPOSE)), lambda bare: bound(or_all(F.trim(off(bare, CIMB_PLACE)), bare), lambda x: chosen(cleaned, bare, x)))

    def chosen(cleaned: Column, bare: Column, x: Column) -> Column:
        words = F.split(x, " ")
        fits = (bare != cleaned) & (F.size(words) >= 2) & ((x != bare) | ((F.size(words) <= 3) & ~F.arrays_overlap(words, F.array(*map(F.lit, CIMB_FORMS)))))
        last = bound(cimb_name(joined(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3))), lambda y: F.when(~y.rlike(CIMB_NO_PERSON), y))
        return F.when(x.rlike(CIMB_PERSON), cimb_name(x)).when(fits, last)

    return bound(cimb_name(body), inside)


def cimb(text: Column) -> Column:
    """CIMB Bank: lines are parted by bars or line feeds; the channel in the first tells which line or words name the party."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.transform(F.split(raw, r"\s*\|\s*|\n+"), F.trim), lambda p: p != "")
    names = lambda p: ~F.upper(p).rlike(CIMB_NO_NAME) & F.upper(p).rlike("[A-Z]")
    last = lambda p: F.element_at(bound(F.filter(p, names), lambda x: F.when(F.size(x) > 0, x)), -1)
    some = lambda c: bound(c, lambda x: F.when(x.isNotNull() & (x != ""), cimb_name(x)))
    enough = lambda c, not_these=(): bound(some(c), lambda x: F.when((F.length(x) >= 4) & ~x.isin("", *not_these), x))

    def rule(s: Column) -> Column:
        return some(F.coalesce(*(F.when(s.rlike(f"(?i){p}"), label) if label else F.nullif(group(s, p), F.lit("")) for p, label in CIMB_RULES)))

    def named(p: Column) -> Column:
        first, flat = F.upper(F.get(p, F.lit(0))), F.trim(F.regexp_replace(raw, r"\s*\|\s*|\n+", " "))
        behind = last(F.slice(p, 2, F.greatest(F.size(p), F.lit(0))))
        sent = F.when(first.rlike(r"^DUITNOW TO ACCOUNT(?:\s+|$)"), some(F.coalesce(behind, *(group(first, x) for x in CIMB_DUITNOW))))
        capitals = F.when(raw.rlike("[a-z]"), F.nullif(F.regexp_extract(raw, r"\b([A-Z][A-Z0-9&()./\-]*(?:\s+[A-Z][A-Z0-9&()./\-]*)*)\s*$", 1), F.lit("")))
        got = F.when(first.rlike(r"^TR FROM\s+(?:CA|SA)(?:\s+|$)"), F.coalesce(some(behind), enough(capitals, ("CA", "SA")), some(group(first, CIMB_FROM))))
        person = bound(group(flat, r"^TR TO\s+(?:C/A|SAVINGS)\s+(.+)$"), lambda x: F.when(x.isNotNull(), cimb_person(x)))
        wordy = lambda w: ~w.rlike(r"\d") & (F.length(w) >= 2)
        paid = enough(joined(F.filter(F.split(spaced(group(raw, r"^AUTOPAY\s+(?:CR|DR)\s+(.+)$")), " "), wordy)))
        turned = F.reverse(F.split(spaced(group(raw, r"^REMITTANCE\s+CR\s+(.+)$")), " "))
        ending = bound(turned, lambda w: bound(first_index(w, lambda x: x.rlike(r"\d")), lambda i: F.when(i.isNull(), w).otherwise(F.slice(w, 1, F.coalesce(i, F.lit(0))))))
        remitted = enough(joined(F.filter(F.reverse(ending), lambda w: F.length(w) >= 2)))
        listed = F.get(F.filter(F.transform(F.concat(F.array(F.upper(flat)), F.transform(p, F.upper)), rule), lambda x: x.isNotNull()), F.lit(0))
        alone = bound(last(p), lambda x: F.when(x.isNotNull(), cimb_name(off(F.upper(x), CIMB_TAIL))))
        fee = F.when(F.upper(raw).rlike(r"\bOTHER\s+TRANSFER\s+FEE\b"), "TRANSFER FEE")
        return F.coalesce(fee, sent, got, person, paid, remitted, listed, alone, F.lit(UNKNOWN))

    return bound(lines, named)


#: By the names that ``statements.BANKS`` gives them; ``banks.register_all`` adds them to the others.
RULES = {"Bank Muamalat": muamalat, "CIMB Bank": cimb, "Hong Leong": hong_leong, "RHB Bank": rhb}

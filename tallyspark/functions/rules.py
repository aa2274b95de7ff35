"""Fixed values of the statement rules: patterns, thresholds and names. Patterns are matched without regard to case."""

# fmt: off
#: Row detectors.
RETURNED_CHEQUE = r"(?:RETURN(?:ED)?\s+CHQ|CHQ\s+RETURN|DISHONOUR)"
EPF = r"(?:KUMPULAN WANG SIMPAN(?:AN PEKERJA)?|EPF DPE|\bEPF\b|\bKWSP(?=\s|[/\-]|$))"
SOCSO = (
    r"(?:\b(?:SOCSO|PERKESO|PERTUBUHAN\s+KESELAM(?:AT(?:AN)?|A)(?:\s+SOSIAL)?|EIS)\b"
    r"|\bFPX\s*B2B\s+PERTUBUH(?=\s|$|/|-)"
    r"|\bPERTUBUH(?:AN)?\s+CP(?=[_\s]|$))"
)
LHDN = r"LEMBAGA HASIL(?:\s+DALAM NEGERI)?|\bLHDN\b"
HRDF = r"(?:PEMBANGUNAN SUMBER M(?:ANUSIA)?|\bPSMB\b|\bHRDF\b)"
SALARY = (
    r"(?<![A-Za-z])(?:SALAR(?:Y|IES)"
    r"|GAJI\s+(?:BULANAN|BLN|JAN|FEB|MAR|MAC|APR|MAY|MEI|JUN|JUL|AUG|OGOS|SEP|SEPT|OCT|OKT|NOV|DEC|DIS)"
    r"|(?:BAYARAN|PEMBAYARAN)\s+GAJI"
    r"|STAFF\s+(?:SALARY|INCENTIVE|OVERTIME|BONUS|ADVANCE)"
    r"|EXTRA\s+SALARY|GUARD\s+SALARY|PMT\s+SLRY|SLRY|PAYROLL|NET\s+PAY|AUTOPAY\s+DR)(?![A-Za-z])"
)
SALARY_JOINED = (
    r"(?<![A-Za-z])(?:GAJI(?:BULANAN|JANUARI|JAN|FEBRUARI|FEB|MAC|MAR|APRIL|APR|MEI|MAY|JUN|JULAI|JUL|OGOS|AUG"
    r"|SEPTEMBER|SEPT|SEP|OKTOBER|OCTOBER|OKT|OCT|NOVEMBER|NOV|DECEMBER|DISEMBER|DEC|DIS)\d{0,4}|STAFFID\d+)(?![A-Za-z])"
)
COMMISSION = r"\bCOMMS?\b|\bCOMMIS(?:S)?ION(?:S|ED|ING)?\b|\bKOMIS(?:E|YE)N\b|\bHABUAN\b"
OWN_ACCOUNT = r"\bOWN\s+ACC(?:OUNT)?\s+TXN\b|\bINTER\s+ACC(?:OUNT)?\s+TXN\b|\bOWN\s+ACCOUNT\s+TRANSFER\b"
FEE_BLOB = r"\b(?:CIBSMSFEE|CIBDRCHARGES|DUITNOWFEE|IBGFEE|SMSFEE)\b"
REVERSAL = r"REVERSAL|REVERSED|REV\s+CR|CREDIT\s+REVERSAL"
INWARD_RETURN = r"IBG\s+INWARD\s+RETURN|GIRO\s+INWARD\s+RETURN"
CASH_DEPOSIT = r"(?:CDM\s+)?CASH\s+DEPOSIT"
CASH_WITHDRAWAL = r"CASH\s+CHQ\s+DR"
CHEQUE_DEPOSIT = r"HSE\s+CHQ\s+DEPOSIT|2D\s+LOCAL\s+CHQ|CHQ\s+DEPOSIT|CHEQUE\s+DEPOSIT"
CHEQUE_ISSUE = r"HOUSE\s+CHQ\s+DR|CLRG\s+CHQ\s+DR|INWARD\s+CLEARING\s+CHQ\s+DEBIT"
CHEQUE_LIKE = r"\bCHEQUE\b|\bCHQ\b"
BANK_FEES = (
    r"AUTOPAY CHARGES|OTHER TRANSFER FEE|CH(?:Q|EQUE)\s+PROCESS(?:ING)?\s+FEE|3RD PARTY CHEQUE|ACCOUNT STATUS CONFIRM"
    r"|SERVICE TAX \d+%|STAMP DUTY|CABLE CHARGE|NOSTRO CHARGE|MAS SERVICE CHARGE|AGENT CHARGES|CMS - DR CORP CHG"
    r"|HANDLING\s+CHRG|CHEQ(?:UE)?\s+STAMP\s+FEE|RFLX\s+INSTANT\s+TRF\s+SC|RFLX\s*/\s*CM\d+|REFLEX-\s*/\s*CM\d+"
    r"|CHQ\s+SVC|SERVICE\s+CASH\s+CHQ|SERVICE\s+CHARGES-OTHERS|BANKERS\s+REFER\s+CHARGES"
)
LOAN_IN = (
    r"\bLOAN DISB|\bFINANCING DISB|\bTRADE FINANCE CR\b|\bTRADE FIN\b|\bSCF TRADE\b|\bFACTORING\b|\bINVOICE FIN\b"
    r"|\bINVOICE DISCOUNT\b|\bBILL PURCHAS|\bBILL DISCOUNT\b|\bBANKERS ACCEPTANCE\b|\bFACILITY DRAWDOWN\b|\bLOANS?/FIN\b"
    r"|\bFUNDING\s+SOCIET|\bCAPBAY\b|\bFUNDAZTIC\b|\bMICROLEAP\b"
)
LOAN_OUT = (
    r"\bTERM LOAN\b|\bLOAN REPAY|\bFINANCING REPAY|\bMONTHLY INSTALMENT\b|\bMONTHLY REPAYMENT\b|\bIB2G\s+DR\s+CA\s+CR\s+LN\b"
    r"|\bTRANSFER TO LOAN\b|\bDD CASA PYMT\b|\bFINPAL ISSUER REPAYM|\bLOANS?/FIN\b|\bLOAN PYMT\b|\bREPAYMENT LOAN\b"
    r"|\bHIRE\s*PURCHASE\b|\bHP\s+LOAN\b|\bFUNDING\s+SOCIET|\bCAPBAY\b|\bFUNDAZTIC\b|\bMICROLEAP\b"
)
LOAN_SHAPED = (
    r"\bLOANS?\b|\bLOANS?/FIN\b|\bFINANCING\b|\bPEMBIAYAAN\b|\bANGSURAN\b|\bINSTAL?MENT\b|\bHIRE\s*PURCHASE\b|\bHP\s+LOAN\b"
    r"|\bREPAYMENT\b|\bDISBURS"
)
LOAN_NOISE = (
    r"PEMBIAYAAN\s+RUMAH|TERM\s+DEPOSIT|FIXED\s+DEPOSIT|FINANCE\s+ACT|KADAR\s+(?:ASAS|PEMBIAYAAN)|ISLAMIK?\s+\("
    r"|FINANCIAL\s+(?:SERVICES|MEDIATION|ACTIVITIES|INSTITUTION)|FINANCING-?I?\s+PRODUCTS"
)
FINANCIER = r"\b[A-Z][A-Z0-9&./-]*\s+(?:CREDIT|CAPITAL|LEASING|FINANCE|FINANCING)\b"
FINANCIER_NOT = (
    r"\b(?:INSURANCE|TAKAFUL|GUARANTEE|ATM|GIRO|CASH|WDRWL|WITHDRAW(?:AL)?|FEES?|INTERBANK|VELOCITY|RINGKASAN|SAL(?:ARY)?"
    r"|PAYROLL|DEPOSIT|REVERSAL|REFUND|CARD|SHARE|EQUITY)\b|SERVICE\s+CHARGE"
)
FX_NOT = r"\bRENTAS\b|\bJANM\b|\bDUITNOW\b|\bFPX\b|\bJOMPAY\b|\b(?:GBP|USD|EUR|SGD|MYR|HKD|AUD|JPY|CNY)[A-Z]\d|\bIBG\b|\bIBFT\b"
FX_WORDS = (
    r"\bFOREX\b|\bFX\s*CONV|\bFOREIGN\s+EXCHANGE\b|\bSWIFT\b|\bCURRENCY\s+CONVER"
    r"|\bBOUGHT\s+(?:USD|EUR|GBP|SGD|HKD|AUD|JPY|CNY)|\bSOLD\s+(?:USD|EUR|GBP|SGD|HKD|AUD|JPY|CNY)"
)
FX_AMOUNT = r"\b(?:USD|EUR|GBP|SGD|HKD|AUD|JPY|CNY)\s+[\d,]"
BALANCE_ROW = (
    r"^\s*(?:OPENING|CLOSING|PREVIOUS|STATEMENT)\s+BALANCE\b|^\s*BAL(?:ANCE)?\s*[BC]/F\b|^\s*B/F\b|^\s*C/F\b"
    r"|^\s*(?:BROUGHT|CARRIED)\s+FORWARD\b"
)
OUTWARD_TRANSFER = r"\b(?:IBG|DUITNOW|GIRO)\b"
RETURN_WORDS = r"\b(?:INWARD|INCOMING|RETURN|RETURNED|REFUND)\b"

#: Category of each counterparty bucket, and the side a category is booked on.
BUCKETS = {
    "BULK SALARY": "C05", "BANK FEES": "C24", "KWSP": "C06", "SOCSO": "C07", "LHDN": "C08", "HRDF": "C09",
    "LOAN REPAYMENT": "C11", "LOAN DISBURSEMENT": "C10", "FD/INTEREST": "C12", "CASH DEPOSIT": "C17",
    "CASH WITHDRAWAL": "C18", "CHEQUE DEPOSIT": "C19", "CHEQUE ISSUE": "C20", "INWARD RETURN": "C16",
}
SIDES = {
    "C01": "CR", "C02": "DR", "C03": "CR", "C04": "DR", "C05": "DR", "C06": "DR", "C07": "DR", "C08": "DR", "C09": "DR",
    "C10": "CR", "C11": "DR", "C12": "CR", "C13": "CR", "C14": "DR", "C15": "CR", "C16": "CR", "C17": "CR", "C18": "DR",
    "C19": "CR", "C20": "DR", "C24": "ANY", "C25": "ANY", "C26": "CR", "C27": "DR",
}
#: The report's flags in order.
FLAGS = (
    "Returned Cheques (Inward)", "Returned Cheques (Outward)", "Round Figure Credits (AML)", "High Value Credits (>3x EOD)",
    "Cash Deposits (AML)", "EPF Compliance", "SOCSO Compliance", "LHDN Tax Payments", "Large Credits (>=RM100K)",
    "Own Party Transactions", "Related Party Transactions", "Loan Activity", "Data Quality", "FX Transactions",
    "Low Closing Balance", "HRDF Payments",
)
#: Thresholds.
ROUND_STEP = 10_000
LARGE_CREDIT = 100_000
HIGH_VALUE_TIMES = 3
LOW_CLOSING = 1_000
OD_UTILISATION = 0.90
EPF_OWN, EPF_BOTH, SOCSO_BAND = (11.0, 15.0), (20.0, 26.0), (1.0, 5.0)
STRUCTURAL_RUN = 4
SMALL_PAYROLL = 30_000
BLIND_AMOUNT, BLIND_SHARE = 500_000, 0.10
LISTED_UNCLASSIFIED = 10_000
TOLERANCE = 1.00
PAIR_DAYS, PAIR_CENTS = 5, 1
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
# fmt: on

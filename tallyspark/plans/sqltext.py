"""Pieces of the check's SQL that several queries share."""

from __future__ import annotations

from ..functions import rules as R


def re2(pattern: str) -> str:
    """The pattern for an engine without look-around; equal for a boolean test."""
    for a, b in ((r"(?=\s|[/\-]|$)", r"(?:\s|[/\-]|$)"), (r"(?=\s|$|/|-)", r"(?:\s|$|/|-)"), (r"(?=[_\s]|$)", r"(?:[_\s]|$)"), (r"(?<![A-Za-z])", r"(?:^|[^A-Za-z])"), (r"(?![A-Za-z])", r"(?:[^A-Za-z]|$)"), (r"(?<![A-Z])", r"(?:^|[^A-Za-z])"), (r"(?![A-Z])", r"(?:[^A-Za-z]|$)")):
        pattern = pattern.replace(a, b)
    return pattern.replace("(?i)", "").replace("'", "''")


def has(pattern: str, c: str = "description") -> str:
    return f"coalesce(regexp_matches({c}, '{re2(pattern)}', 'i'), false)"


SALARY = f"(({has(R.SALARY)} OR {has(R.SALARY_JOINED)}) AND NOT {has(R.COMMISSION)} AND NOT {has(R.OWN_ACCOUNT)} AND NOT {has(R.FEE_BLOB)})"
FX = f"(NOT {has(R.FX_NOT)} AND ({has(R.FX_WORDS)} OR {has(R.FX_AMOUNT)}))"
DETECT = {
    "D04_returned_cheque_inward": (has(R.RETURNED_CHEQUE), "DR"), "D04_returned_cheque_outward": (has(R.RETURNED_CHEQUE), "CR"),
    "D05_epf": (has(R.EPF), "DR"), "D06_socso": (has(R.SOCSO), "DR"), "D07_lhdn": (has(R.LHDN), "DR"), "D08_hrdf": (has(R.HRDF), "DR"),
    "D09_salary": (SALARY, "DR"), "D10_reversal": (has(R.REVERSAL), "CR"), "D11_inward_return": (has(R.INWARD_RETURN), "CR"),
    "D12_cash_deposit": (has(R.CASH_DEPOSIT), "CR"), "D13_cash_withdrawal": (has(R.CASH_WITHDRAWAL), "DR"),
    "D14_cheque_deposit": (has(R.CHEQUE_DEPOSIT), "CR"), "D15_cheque_issue": (has(R.CHEQUE_ISSUE), "DR"), "D16_bank_fees": (has(R.BANK_FEES), "DR"),
    "D17_loan_disbursement": (has(R.LOAN_IN), "CR"), "D17_loan_repayment": (has(R.LOAN_OUT), "DR"),
    "D18_fx_credit": (FX, "CR"), "D18_fx_debit": (FX, "DR"), "D20_cheque_like": (has(R.CHEQUE_LIKE), "DR"),
}
SIDE9 = "CASE WHEN credit > 0 AND debit <= 0 THEN 'CR' WHEN debit > 0 AND credit <= 0 THEN 'DR' END"
FLAGGED = f"fl AS (SELECT *, {SIDE9} AS side9 FROM st)"
EOD = "eod AS (SELECT account_no, month, dt, max_by(balance, row_order) AS eod FROM st WHERE balance IS NOT NULL GROUP BY ALL)"
PARTY_TEXT = r"upper(trim(regexp_replace(coalesce(description, ''), '\s+', ' ', 'g')))"
for _p in (r"TRANSFER TO A/C", r"TRANSFER FR A/C", r"INTER-BANK PAYMENT INTO A/C", r"CMS\s*-\s*CR\s*PYMT", r"DUITNOW\s*QR-", r"\*", r"=\s*BAKI\s*LEGAR.*"):
    PARTY_TEXT = f"regexp_replace({PARTY_TEXT}, '{_p}', ' ', 'g')"
PARTY_TEXT = rf"trim(regexp_replace(regexp_replace({PARTY_TEXT}, '\d{{6,}}', ' ', 'g'), '\s+', ' ', 'g'))"


def party(c: str = "description") -> str:
    s = PARTY_TEXT.replace("description", c)
    return f"CASE WHEN {s} = '' THEN 'UNKNOWN' WHEN regexp_full_match({s}, '[0-9 ]+') THEN 'BANK_CLEARING_' || {s} ELSE substr({s}, 1, 80) END"


LEDGER = f"pt AS (SELECT *, {party()} AS party FROM st)"
CORPORATE = r"(?:^|[^A-Za-z])(?:SDN\.?\s*BHD\.?|BERHAD|BHD\.?|ENTERPRISES?|TRADING|CORPORATION|GROUP|HOLDINGS|INDUSTRIES)(?:[^A-Za-z]|$)"


def classified(companies=(), related=()) -> str:
    """The ladder as one CASE over ``pt``, for parties without markers and buckets."""
    memo = f"({has(R.LOAN_IN)} OR {has(R.LOAN_OUT)})"
    own = " OR ".join(f"contains(upper(description), '{r}') OR contains(upper(party), '{r}')" for r in companies) or "false"
    rel = " OR ".join(f"contains(upper(description), '{r}') OR contains(upper(party), '{r}')" for r in related) or "false"
    bucket = " ".join(f"WHEN upper(party) = '{b}' AND ('{R.SIDES[c]}' = 'ANY' OR side9 = '{R.SIDES[c]}') AND side9 IS NOT NULL THEN '{c}'" for b, c in R.BUCKETS.items())
    corp = f"(regexp_matches(party, '{CORPORATE}', 'i'))"
    return f"""cl AS (SELECT *, CASE WHEN {has(R.BALANCE_ROW)} THEN 'C25'
 WHEN side9 IS NOT NULL AND ({own}) AND NOT {memo} THEN CASE side9 WHEN 'CR' THEN 'C01' ELSE 'C02' END
 WHEN side9 = 'DR' AND {SALARY} THEN 'C05' WHEN side9 = 'CR' AND {has(R.LOAN_IN)} THEN 'C10'
 WHEN side9 = 'DR' AND {has(R.LOAN_OUT)} AND NOT {has(R.FEE_BLOB)} AND NOT {has(R.BANK_FEES)} THEN 'C11'
 WHEN side9 IS NOT NULL AND ({rel}) THEN CASE side9 WHEN 'CR' THEN 'C03' ELSE 'C04' END {bucket}
 WHEN side9 = 'DR' AND {has(R.EPF)} THEN 'C06' WHEN side9 = 'DR' AND {has(R.SOCSO)} THEN 'C07' WHEN side9 = 'DR' AND {has(R.LHDN)} THEN 'C08' WHEN side9 = 'DR' AND {has(R.HRDF)} THEN 'C09'
 WHEN side9 = 'DR' AND {has(R.FINANCIER, "party")} AND NOT {has(R.FINANCIER_NOT, "party")} THEN 'C11'
 WHEN side9 = 'CR' AND {has(R.REVERSAL)} THEN 'C13' WHEN {has(R.RETURNED_CHEQUE)} AND side9 IS NOT NULL THEN CASE side9 WHEN 'DR' THEN 'C14' ELSE 'C15' END
 WHEN side9 = 'CR' AND {has(R.INWARD_RETURN)} THEN 'C16' WHEN side9 = 'CR' AND {has(R.CASH_DEPOSIT)} THEN 'C17' WHEN side9 = 'DR' AND {has(R.CASH_WITHDRAWAL)} THEN 'C18'
 WHEN side9 = 'CR' AND {has(R.CHEQUE_DEPOSIT)} THEN 'C19' WHEN side9 = 'DR' AND {has(R.CHEQUE_ISSUE)} THEN 'C20' WHEN side9 = 'DR' AND {has(R.BANK_FEES)} THEN 'C24'
 WHEN {corp} AND side9 IS NOT NULL THEN CASE side9 WHEN 'CR' THEN 'C26' ELSE 'C27' END END AS "primary" FROM (SELECT *, {SIDE9} AS side9 FROM pt) q)"""


MONTHLY = """mo0 AS (SELECT account_no, month, count(*) AS n, count(*) FILTER (credit > 0) AS credits, count(*) FILTER (debit > 0) AS debits,
  CAST(sum(credit) AS DOUBLE) AS gross_credits, CAST(sum(debit) AS DOUBLE) AS gross_debits, CAST(max_by(balance, (dt, row_order)) FILTER (balance IS NOT NULL) AS DOUBLE) AS closing,
  CAST(min(balance) AS DOUBLE) AS lowest, CAST(max(balance) AS DOUBLE) AS highest FROM st GROUP BY ALL),
fr AS (SELECT account_no, month, CAST(balance - credit + debit AS DOUBLE) AS first_opening FROM st QUALIFY row_number() OVER (PARTITION BY account_no, month ORDER BY dt, row_order) = 1),
mo AS (SELECT mo0.*, CASE WHEN row_number() OVER w = 1 THEN first_opening ELSE last_value(closing IGNORE NULLS) OVER (PARTITION BY account_no ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS opening,
  highest - lowest AS swing FROM mo0 JOIN fr USING (account_no, month) WINDOW w AS (PARTITION BY account_no ORDER BY month))"""
STATUTORY = f"""sm AS (SELECT month, {", ".join(f"CAST(coalesce(sum(debit) FILTER ({DETECT[d][0]} AND side9 = 'DR'), 0) AS DOUBLE) AS {n}" for n, d in {"salary": "D09_salary", "epf": "D05_epf", "socso": "D06_socso", "tax": "D07_lhdn", "hrdf": "D08_hrdf"}.items())} FROM fl GROUP BY month)"""

"""Queries of monthly, account, statutory, ledger and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flags as G
from ..operators import ledger as L
from ..operators import monthly as M
from . import sqltext as T
from .detectors import COMPANIES, RELATED, classified
from .fixtures import sql, statement

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, text: str | None = None) -> None:
    QUERIES[name] = fn
    if text:
        SQL[name] = text


_cl = f"{T.LEDGER}, {T.classified(COMPANIES, RELATED)}"
_sm = f"{T.FLAGGED}, {T.STATUTORY}"
CR, DR = "CAST(sum(credit) AS DOUBLE)", "CAST(sum(debit) AS DOUBLE)"

add("A01_W04_monthly_eod", lambda s, d: M.monthly_eod(statement(s, d)), sql("SELECT account_no, month, CAST(min(eod) AS DOUBLE) AS eod_lowest, CAST(max(eod) AS DOUBLE) AS eod_highest, CAST(sum(eod) AS DOUBLE) / count(*) AS eod_average, count(*) AS eod_days FROM eod GROUP BY ALL", more=T.EOD))
add("A02_W06_monthly", lambda s, d: M.monthly(statement(s, d)), sql("SELECT * FROM mo", more=T.MONTHLY))
add("A03_J06_buckets", lambda s, d: M.buckets(classified(s, d)), sql('SELECT account_no, month, "primary", count(*) AS n, CAST(sum(CASE WHEN credit > 0 THEN credit ELSE debit END) AS DOUBLE) AS amount FROM cl WHERE "primary" IS NOT NULL AND "primary" <> \'C25\' GROUP BY ALL', more=_cl))
NET = """nt AS (SELECT account_no, month, CAST(sum(credit) AS DOUBLE) AS gross_credits, CAST(sum(debit) AS DOUBLE) AS gross_debits,
 CAST(sum(credit) AS DOUBLE) - CAST(coalesce(sum(credit) FILTER ("primary" IN ('C01','C03','C10','C12','C13','C16')), 0) AS DOUBLE) AS net_credits, CAST(sum(debit) AS DOUBLE) - CAST(coalesce(sum(debit) FILTER ("primary" = 'C02'), 0) AS DOUBLE) AS net_debits
 FROM cl WHERE "primary" IS NULL OR "primary" <> 'C25' GROUP BY ALL)"""
add("A05_net_totals", lambda s, d: M.net_totals(classified(s, d)), sql("SELECT * FROM nt", more=f"{_cl}, {NET}"))
REC = "rc AS (SELECT account_no, month, opening, closing, delta, CASE WHEN abs(delta) > 1 THEN 'FAIL' WHEN delta IS NOT NULL THEN 'PASS' END AS status FROM (SELECT *, round(closing - (opening + gross_credits - gross_debits), 2) + 0.0 AS delta FROM mo))"
add("A06_reconciled", lambda s, d: M.reconciled(statement(s, d)), sql("SELECT * FROM rc", more=f"{T.MONTHLY}, {REC}"))
add("A07_overdraft_convention", lambda s, d: M.overdraft_convention(statement(s, d)), sql("""SELECT account_no, negative, signed_votes, legacy_votes, CASE WHEN negative OR signed_votes >= legacy_votes THEN 'signed' ELSE 'legacy' END AS convention FROM (
 SELECT account_no, coalesce(bool_or(balance < 0), false) AS negative, count(*) FILTER ((credit > 0) <> (debit > 0) AND abs(balance - was - (credit - debit)) <= 0.02) AS signed_votes, count(*) FILTER ((credit > 0) <> (debit > 0) AND abs(balance - was + (credit - debit)) <= 0.02) AS legacy_votes
 FROM (SELECT *, lag(balance) OVER (PARTITION BY account_no ORDER BY dt, row_order) AS was FROM st WHERE balance IS NOT NULL) GROUP BY 1)"""))
add("A08_statutory_months", lambda s, d: M.statutory_months(statement(s, d)), sql("SELECT * FROM sm", more=_sm))
FUNDS = "fu AS (SELECT month, salary, 'EPF' AS fund, epf AS paid FROM sm UNION ALL SELECT month, salary, 'SOCSO', socso FROM sm)"
add("W07_J04_contribution_ratios", lambda s, d: M.contribution_ratios(M.statutory_months(statement(s, d))), sql("""SELECT fund, month, salary, paid, round(ratio, 2) AS ratio_pct, CASE WHEN raw <> 'ABOVE' THEN raw WHEN count(*) OVER (PARTITION BY fund, raw, run) >= 4 THEN 'STRUCTURAL' ELSE 'CATCH_UP' END AS status FROM (
 SELECT *, row_number() OVER (PARTITION BY fund ORDER BY month) - row_number() OVER (PARTITION BY fund, raw ORDER BY month) AS run FROM (
 SELECT *, CASE WHEN fund = 'EPF' AND (ratio BETWEEN 11 AND 15 OR ratio BETWEEN 20 AND 26) THEN 'OK' WHEN fund = 'SOCSO' AND ratio BETWEEN 1 AND 5 THEN 'OK' WHEN ratio < CASE fund WHEN 'EPF' THEN 11 ELSE 1 END THEN 'WARNING' ELSE 'ABOVE' END AS raw
 FROM (SELECT *, paid / salary * 100 AS ratio FROM fu WHERE salary > 0 AND paid > 0)))""", more=f"{_sm}, {FUNDS}"))
COVER = """co AS (SELECT fund, count(*) FILTER (salary > 0) AS salary_months, count(*) FILTER (paid > 0) AS paid_months, count(*) FILTER (salary > 0 AND paid > 0) AS covered, coalesce(string_agg(month, ',' ORDER BY month) FILTER (salary > 0 AND NOT paid > 0), '') AS missing FROM fu GROUP BY fund),
cov AS (SELECT *, CASE WHEN salary_months > 0 THEN round(CAST(covered AS DOUBLE) / salary_months * 100, 2) ELSE 100.0 END AS coverage_pct FROM co)"""
add("X02_coverage", lambda s, d: M.coverage(M.statutory_months(statement(s, d))), sql("SELECT fund, salary_months, paid_months, covered, missing, CAST(coverage_pct AS DOUBLE) AS coverage_pct FROM cov", more=f"{_sm}, {FUNDS}, {COVER}"))
add("A09_compliance", lambda s, d: M.compliance(statement(s, d)), sql(f"""SELECT e.salary_months, CAST(e.coverage_pct AS DOUBLE) AS epf_pct, CAST(o.coverage_pct AS DOUBLE) AS socso_pct, e.missing AS epf_missing, o.missing AS socso_missing, (SELECT count(*) FROM sm WHERE tax > 0) AS tax_months, (SELECT count(*) FROM sm WHERE hrdf > 0) AS hrdf_months,
 (SELECT coalesce(sum(salary), 0) > 0 AND coalesce(sum(salary), 0) <= 30000 FROM sm) AS small, (SELECT coalesce(sum(debit) FILTER ({T.DETECT['D20_cheque_like'][0]}), 0) >= 500000 AND sum(debit) FILTER ({T.DETECT['D20_cheque_like'][0]}) / sum(debit) >= 0.1 FROM st WHERE debit > 0) AS blind,
 CASE WHEN e.coverage_pct >= 100 AND o.coverage_pct >= 100 THEN 'COMPLIANT' WHEN e.salary_months > 0 AND (e.coverage_pct = 0 OR o.coverage_pct = 0) THEN 'CRITICAL' ELSE 'GAPS_DETECTED' END AS overall_status,
 CASE WHEN e.coverage_pct >= 100 AND o.coverage_pct >= 100 THEN 'COMPLIANT' WHEN e.salary_months > 0 AND (e.coverage_pct = 0 OR o.coverage_pct = 0) THEN 'CRITICAL' ELSE 'GAPS_DETECTED' END AS exported_status
 FROM cov e, cov o WHERE e.fund = 'EPF' AND o.fund = 'SOCSO'""", more=f"{_sm}, {FUNDS}, {COVER}"))
AM = f"""am AS (SELECT mo.*, e.eod_lowest, e.eod_highest, e.eod_average, e.eod_days, nt.net_credits, nt.net_debits, f.fx_credits, f.fx_debits, f.round_count, f.round_credits, coalesce(h.high_count, 0) AS high_count, coalesce(h.high_credits, 0.0) AS high_credits, rc.delta, rc.status
 FROM mo LEFT JOIN (SELECT account_no, month, CAST(min(eod) AS DOUBLE) AS eod_lowest, CAST(max(eod) AS DOUBLE) AS eod_highest, CAST(sum(eod) AS DOUBLE) / count(*) AS eod_average, count(*) AS eod_days FROM eod GROUP BY ALL) e USING (account_no, month)
 LEFT JOIN nt USING (account_no, month) LEFT JOIN (SELECT account_no, month, CAST(coalesce(sum(credit) FILTER ({T.FX}), 0) AS DOUBLE) AS fx_credits, CAST(coalesce(sum(debit) FILTER ({T.FX}), 0) AS DOUBLE) AS fx_debits,
  count(*) FILTER (credit >= 10000 AND CAST(round(credit * 100) AS BIGINT) % 1000000 = 0) AS round_count, CAST(coalesce(sum(credit) FILTER (credit >= 10000 AND CAST(round(credit * 100) AS BIGINT) % 1000000 = 0), 0) AS DOUBLE) AS round_credits FROM st GROUP BY ALL) f USING (account_no, month)
 LEFT JOIN (SELECT account_no, month, count(*) AS high_count, CAST(sum(credit) AS DOUBLE) AS high_credits FROM st JOIN (SELECT account_no, month, CAST(sum(eod) AS DOUBLE) / count(*) AS a FROM eod GROUP BY ALL) q USING (account_no, month) WHERE a > 0 AND CAST(credit AS DOUBLE) > 3 * a GROUP BY ALL) h USING (account_no, month)
 LEFT JOIN rc USING (account_no, month))"""
ALL = f"{_cl}, {NET}, {T.EOD}, {T.MONTHLY}, {REC.replace('rc AS (SELECT account_no, month, opening, closing,', 'rc AS (SELECT account_no, month,')}, {AM}"
add("A04_account_months", lambda s, d: M.account_months(classified(s, d)).drop("side9"), sql("SELECT * FROM am", more=ALL))
add("A10_consolidated", lambda s, d: M.consolidated(classified(s, d)), sql("""SELECT *, round(net_credits * 12 / months, 2) AS annual_net_credits, round(net_debits * 12 / months, 2) AS annual_net_debits FROM (SELECT round(sum(gross_credits), 2) AS gross_credits, round(sum(gross_debits), 2) AS gross_debits, round(sum(net_credits), 2) AS net_credits, round(sum(net_debits), 2) AS net_debits,
 round(sum(fx_credits), 2) AS fx_credits, round(sum(fx_debits), 2) AS fx_debits, round(sum(round_credits), 2) AS round_credits, round(sum(high_credits), 2) AS high_credits, CAST(sum(n) AS BIGINT) AS n, CAST(sum(round_count) AS BIGINT) AS round_count, CAST(sum(high_count) AS BIGINT) AS high_count, count(DISTINCT month) AS months, min(eod_lowest) AS eod_lowest, max(eod_highest) AS eod_highest, round(sum(eod_average) / count(DISTINCT month), 2) AS eod_average FROM am)""", more=ALL))
add("A10_A11_rollup", lambda s, d: M.rollup(statement(s, d)), sql(f"SELECT account_no, month, count(*) AS n, {CR} AS credits, {DR} AS debits, CAST(grouping(account_no) * 2 + grouping(month) AS BIGINT) AS level FROM st GROUP BY ROLLUP (account_no, month)"))
add("A11_accounts", lambda s, d: M.accounts(statement(s, d)), sql(f"SELECT * FROM (SELECT account_no, min_by(opening, month) AS opening, arg_max(closing, month) FILTER (closing IS NOT NULL) AS closing, count(*) AS months FROM mo GROUP BY 1) JOIN (SELECT account_no, CAST(min(dt) AS VARCHAR) AS first_day, CAST(max(dt) AS VARCHAR) AS last_day, {CR} AS credits, {DR} AS debits, count(*) AS n FROM st GROUP BY 1) USING (account_no)", more=T.MONTHLY))
add("A12_parsing_metadata", lambda s, d: M.parsing_metadata(statement(s, d)), sql("SELECT *, round(CAST(passed AS DOUBLE) / (passed + failed), 4) AS pass_rate FROM (SELECT count(*) AS account_months, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status IS NULL) AS unknown FROM rc)", more=f"{T.MONTHLY}, {REC}"))
GAPS = """s3 AS (SELECT * FROM st WHERE account_no <> 3 OR month NOT IN ('1996-02', '1999-11')), sp AS (SELECT account_no, min(date_trunc('month', dt)) AS a, max(date_trunc('month', dt)) AS b FROM s3 GROUP BY 1), ev AS (SELECT account_no, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM sp),
gp AS (SELECT account_no, count(*) AS gaps, string_agg(strftime(m, '%Y-%m'), ',' ORDER BY m) AS missing FROM ev WHERE (account_no, strftime(m, '%Y-%m')) NOT IN (SELECT (account_no, month) FROM s3) GROUP BY 1)"""
add("A13_completeness", lambda s, d: M.completeness(statement(s, d).where("account_no <> 3 OR month NOT IN ('1996-02', '1999-11')")), sql("SELECT account_no, coalesce(gaps, 0) AS gaps, coalesce(missing, '') AS missing, CASE WHEN gaps > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS completeness FROM sp LEFT JOIN gp USING (account_no)", more=GAPS))
add("A14_A16_ui_months", lambda s, d: M.ui_months(statement(s, d)), sql("""SELECT account_no, month, opening, net, CASE WHEN closing IS NULL OR abs(closing - want) > 0.01 THEN coalesce(want, closing) ELSE closing END AS ending, coalesce(lowest < 0, false) AS overdrawn FROM (
 SELECT *, round(opening + net, 2) AS want FROM (SELECT *, round(gross_credits - gross_debits, 2) AS net FROM mo))""", more=T.MONTHLY))
add("A15_W05_balance_chain", lambda s, d: M.balance_chain(statement(s, d)), sql("""SELECT account_no, month, CAST(start + run - net AS DOUBLE) AS opening, CAST(net AS DOUBLE) AS net, CAST(start + run AS DOUBLE) AS closing FROM (SELECT account_no, month, net, coalesce(first_value(back) OVER w, 0) AS start, sum(net) OVER w AS run FROM (
 SELECT account_no, month, sum(credit) - sum(debit) AS net FROM st GROUP BY ALL) JOIN (SELECT account_no, month, balance - credit + debit AS back FROM st QUALIFY row_number() OVER (PARTITION BY account_no, month ORDER BY dt, row_order) = 1) USING (account_no, month) WINDOW w AS (PARTITION BY account_no ORDER BY month ROWS UNBOUNDED PRECEDING))"""))


def control(s, d):
    tx = statement(s, d)
    own = tx.groupBy("account_no", "month").agg((F.sum("credit").cast("double") + 1).alias("credits"), (F.sum("debit").cast("double") + 2).alias("debits"))
    exact = own.where("account_no < 3")
    loose = own.where("account_no = 5 AND month < '1997-01'").withColumn("account_no", F.lit(None).cast("bigint"))
    return M.control_totals(tx, exact.unionByName(loose))


add("A17_J02_J03_control_totals", control, sql("SELECT o.account_no, o.month, CASE WHEN o.account_no < 3 THEN o.credits + 1 ELSE coalesce(l.credits + 1, o.credits) END AS credits, CASE WHEN o.account_no < 3 THEN o.debits + 2 ELSE coalesce(l.debits + 2, o.debits) END AS debits, CASE WHEN o.account_no < 3 THEN 'account' WHEN l.month IS NOT NULL THEN 'month' ELSE 'own' END AS origin FROM ow o LEFT JOIN ow l ON l.account_no = 5 AND l.month < '1997-01' AND l.month = o.month", more=f"ow AS (SELECT account_no, month, {CR} AS credits, {DR} AS debits FROM st GROUP BY ALL)"))
add("W01_delta_side", lambda s, d: M.delta_side(statement(s, d)), sql("SELECT row_order, account_no, CAST(CASE WHEN step IS NULL THEN credit ELSE greatest(step, 0) END AS DOUBLE) AS credit, CAST(CASE WHEN step IS NULL THEN debit ELSE greatest(-step, 0) END AS DOUBLE) AS debit FROM (SELECT *, balance - lag(balance) OVER (PARTITION BY account_no ORDER BY dt, row_order) AS step FROM st WHERE balance IS NOT NULL)"))
add("W02_L8_verify_running", lambda s, d: M.verify_running(statement(s, d).withColumn("balance", F.when(c("row_order") % 50 == 1, c("balance") + 1).otherwise(c("balance")))), sql("SELECT row_order, account_no, CAST(balance AS DOUBLE) AS balance, CAST(e AS DOUBLE) AS expected, abs(balance - e) > 0.01 AS mismatch FROM (SELECT *, lag(balance) OVER w + flow - lag(flow) OVER w AS e FROM rn WHERE balance IS NOT NULL WINDOW w AS (PARTITION BY account_no ORDER BY dt, row_order)) WHERE e IS NOT NULL", more="rn AS (SELECT row_order, account_no, dt, CASE WHEN row_order % 50 = 1 THEN balance + 1 ELSE balance END AS balance, sum(credit - debit) OVER (PARTITION BY account_no ORDER BY dt, row_order ROWS UNBOUNDED PRECEDING) AS flow FROM st)"))
add("W03_reanchored", lambda s, d: M.reanchored(statement(s, d)), sql("SELECT row_order, account_no, CAST(coalesce(first_value(balance) OVER w, 0) + sum(CASE WHEN balance IS NULL THEN credit - debit ELSE 0 END) OVER w AS DOUBLE) AS running FROM (SELECT *, count(balance) OVER (PARTITION BY account_no ORDER BY dt, row_order ROWS UNBOUNDED PRECEDING) AS island FROM st) WINDOW w AS (PARTITION BY account_no, island ORDER BY dt, row_order ROWS UNBOUNDED PRECEDING)"))

LED = "lg AS (SELECT party, count(*) AS n, count(*) FILTER (credit > 0) AS credit_n, count(*) FILTER (debit > 0) AS debit_n, CAST(sum(credit) AS DOUBLE) AS credits, CAST(sum(debit) AS DOUBLE) AS debits, CAST(sum(credit) - sum(debit) AS DOUBLE) AS net FROM pt GROUP BY party)"
_lg = f"{T.LEDGER}, {LED}"
add("A18_S02_W11_top_parties", lambda s, d: L.top_parties(statement(s, d)).select("side", "party", "amount", "n", c("rank").cast("bigint").alias("rank")), sql("SELECT * FROM (SELECT side, party, amount, n, row_number() OVER (PARTITION BY side ORDER BY amount DESC, party) AS rank FROM (SELECT side, party, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n FROM pt GROUP BY ALL)) WHERE rank <= 10", more=T.LEDGER))
add("A19_ledger", lambda s, d: L.ledger(statement(s, d)), sql("SELECT * FROM lg", more=_lg))
add("A20_ledger_months", lambda s, d: L.ledger_months(statement(s, d)), sql("SELECT party, side, month, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM pt GROUP BY ALL", more=T.LEDGER))
add("A21_parties", lambda s, d: L.parties(statement(s, d)), sql(f"SELECT party, count(*) AS n, {CR} AS credits, {DR} AS debits, CAST(sum(greatest(credit, debit)) AS DOUBLE) AS volume, CAST(max(dt) AS VARCHAR) AS last_day FROM pt WHERE description <> 'OPENING BALANCE' GROUP BY 1", more=T.LEDGER))
VAR = "vr AS (SELECT CASE WHEN side = 'CR' THEN replace(party, ' SDN BHD', ' SDN. BHD.') ELSE party END AS party, count(*) AS n, CAST(sum(credit) AS DOUBLE) AS credits, CAST(sum(debit) AS DOUBLE) AS debits FROM pt GROUP BY 1)"


def variants(s, d):
    p = L.with_party(statement(s, d)).withColumn("party", F.when(c("side") == "CR", F.replace("party", F.lit(" SDN BHD"), F.lit(" SDN. BHD."))).otherwise(c("party")))
    return p.groupBy("party").agg(F.count("*").alias("n"), F.sum("credit").cast("double").alias("credits"), F.sum("debit").cast("double").alias("debits"))


add("A22_A26_M1_M2_merge_by_name", lambda s, d: L.merge_by_name(variants(s, d)), sql("SELECT regexp_replace(upper(party), '[^A-Z0-9]', '', 'g') AS key, max_by(party, (n, length(party), credits + debits, party)) AS party, CAST(sum(n) AS BIGINT) AS n, round(sum(credits), 2) AS credits, round(sum(debits), 2) AS debits, string_agg(DISTINCT party, '|' ORDER BY party) AS raw_names FROM vr GROUP BY 1", more=f"{T.LEDGER}, {VAR}"))
UNK = "(upper(party) IN ('', 'UNKNOWN', 'UNNAMED', 'N/A', 'NONE', '-') OR starts_with(party, 'BANK_CLEARING_') OR starts_with(party, 'UNKNOWN '))"
from .scalars import STOP  # noqa: E402

DROP = f"(NOT regexp_matches(party, '[A-Z]') OR length(party) <= 2 OR len(list_filter(string_split(party, ' '), lambda t: t NOT IN {STOP})) = 0)"
add("A25_party_totals", lambda s, d: L.party_totals(statement(s, d)), sql(f"SELECT count(*) AS parties, count(*) FILTER ({UNK}) AS unknown, count(*) FILTER ({DROP}) AS droppable, round(sum(credits), 2) AS credits, round(sum(debits), 2) AS debits FROM lg", more=_lg))
add("S03_top_by_frequency", lambda s, d: L.top_by_frequency(statement(s, d)), sql("SELECT party, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n FROM pt GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20", more=T.LEDGER))
add("S04_top_known", lambda s, d: L.top_known(statement(s, d)), sql(f"SELECT * FROM lg WHERE NOT {UNK} AND NOT {DROP} AND NOT regexp_matches(party, '\\bBILL\\b|\\bCHARGE', 'i') ORDER BY abs(net) DESC, party LIMIT 10", more=_lg))


def j01(s, d):
    tx = statement(s, d)
    names = L.with_party(tx).where("side = 'DR'").select("account_no", "dt", "description", "amount", "side", "row_order", F.concat("party", F.lit("#"), c("row_order").cast("string")).alias("party"))
    return L.attach_party(tx, names).select("row_order", "party")


add("J01_attach_party", j01, sql("SELECT a.row_order, n.party FROM st a LEFT JOIN (SELECT account_no, dt, description, amount, side, arg_max(party || '#' || CAST(row_order AS VARCHAR), row_order) AS party FROM pt WHERE side = 'DR' GROUP BY ALL) n USING (account_no, dt, description, amount, side)", more=T.LEDGER))
add("J08_named_only", lambda s, d: L.named_only(L.ledger(statement(s, d)), L.ledger(statement(s, d)).where("n % 2 = 0").select("party")), sql(f"SELECT * FROM lg WHERE NOT {UNK} AND n % 2 <> 0", more=_lg))


def j10(s, d):
    listed = s.createDataFrame([("supplier 1",), ("Supplier 12",), ("SDN BHD",), ("SALARY",)], "name string")
    return L.substring_parties(statement(s, d), listed).select("row_order", "name")


add("J10_A23_substring_parties", j10, sql("SELECT row_order, name FROM st, (VALUES ('supplier 1'), ('Supplier 12'), ('SDN BHD'), ('SALARY')) v(name) WHERE contains(upper(description), upper(name)) QUALIFY row_number() OVER (PARTITION BY row_order ORDER BY length(name) DESC, name) = 1"))
RP = f"""rp AS (SELECT party, CAST(sum(debit) AS DOUBLE) AS debits, CAST(sum(credit) AS DOUBLE) AS credits, count(*) FILTER (debit > 0) AS dr, count(*) FILTER (credit > 0) AS cr, count(DISTINCT month) FILTER (debit > 0) AS months,
 count(*) FILTER (regexp_matches(description, '\\b(ADVANCE|PERSONAL|DIRECTOR|ALLOWANCE|CLAIM|WIFE|HUSBAND|FAMILY)\\b', 'i') AND debit > 0) AS personal, count(*) FILTER (debit >= 1000 AND CAST(debit * 100 AS BIGINT) % 10000 = 0) AS rounds, count(DISTINCT month) FILTER (debit >= 1000 AND CAST(debit * 100 AS BIGINT) % 10000 = 0) AS round_months, (SELECT CAST(sum(debit) AS DOUBLE) FROM st) AS gross FROM pt GROUP BY party),
r1 AS (SELECT *, personal >= 2 AS s1, debits >= 0.05 * gross AS s2, months >= 3 AS s3, coalesce(least(dr, cr) >= 2 AND least(debits, credits) / nullif(greatest(debits, credits), 0) >= 0.05, false) AS s4, rounds >= 5 AND round_months >= 4 AS s5, rounds >= 2 AND NOT (rounds >= 5 AND round_months >= 4) AS s6 FROM rp),
r2 AS (SELECT *, concat_ws(',', CASE WHEN s1 THEN 'personal_keyword_sweep' END, CASE WHEN s2 THEN 'concentration_dr' END, CASE WHEN s3 THEN 'monthly_recurrence' END, CASE WHEN s4 THEN 'bidirectional_flow' END, CASE WHEN s5 THEN 'round_amount_sustained' END, CASE WHEN s6 THEN 'round_amount_advance' END) AS signals, CAST(s1::INT * 2 + s2::INT * 2 + s3::INT + s4::INT * 2 + s5::INT * 2 + s6::INT AS BIGINT) AS score FROM r1)"""
add("R03_R04_related_signals", lambda s, d: L.related_signals(statement(s, d)), sql("SELECT party, debits, credits, signals, score, CASE WHEN score >= 3 AND (s1 OR s4) THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r2", more=f"{T.LEDGER}, {RP}"))
add("R07_advisory", lambda s, d: L.related_signals(statement(s, d)).where("debits >= 3000 AND confidence <> 'HIGH'").orderBy(F.desc("score"), F.desc("debits"), "party").limit(40), sql("SELECT party, debits, credits, signals, score, CASE WHEN score >= 3 AND (s1 OR s4) THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r2 WHERE debits >= 3000 AND NOT (score >= 3 AND (s1 OR s4)) ORDER BY score DESC, debits DESC, party LIMIT 40", more=f"{T.LEDGER}, {RP}"))
add("R02_summary", lambda s, d: G.summary(classified(s, d)))
add("R01_flags", lambda s, d: G.flags(G.summary(classified(s, d))))
add("R08_observations", lambda s, d: G.observations(G.summary(classified(s, d))))
add("R10_account_meta", lambda s, d: G.account_meta(statement(s, d).select("account_no", F.when(c("row_order") % 50 == 0, "OD").otherwise("CR").alias("account_type"), c("amount").cast("double").alias("od_limit"))), sql("SELECT account_no, CASE WHEN bool_or(row_order % 50 = 0) THEN 'OD' ELSE 'CR' END AS account_type, max(CAST(amount AS DOUBLE)) AS od_limit FROM st GROUP BY 1"))
add("A27_formula_checks", lambda s, d: G.formula_checks(statement(s, d)))

"""Layouts over words and cascades of layouts: cases by hand, edge cases, and tail repair against a plain walk."""

from __future__ import annotations

import random
import re

import pytest

from tallyspark.sources import cascades as X
from tallyspark.sources import markers as K
from tallyspark.sources import words as W

WORDS = "file string, page int, x0 double, y0 double, x1 double, text string, width double, line int, tid string, m string"


def words(spark, *cells, file="f", page=1, width=None):
    """Words of ``(y, x, text)`` cells, split at spaces, 12 points apart."""
    rows = [(file, page, x + 12.0 * i, float(y), x + 12.0 * i + 10, t, width, 7, "clash", "clash") for y, x, text in cells for i, t in enumerate(text.split(" "))]
    return spark.createDataFrame(rows, WORDS)


def got(df, *extra):
    return [(str(r.dt) if r.dt else None, r.description, r.debit, r.credit, r.balance, *(r[e] for e in extra)) for r in df.orderBy("file", "seq").collect()]


def test_visual_lines_follow_the_mean_or_the_first_word(spark):
    w = words(spark, (10, 50, "b"), (12, 20, "a"), (14.5, 5, "c"), (17, 1, "d"), (40, 1, "e"))
    text = lambda df: [" ".join(x["text"] for x in r.words) for r in df.orderBy("line").collect()]
    assert text(W.visual_lines(w, 3.0)) == ["a b", "d c", "e"]  # 14.5 is over 3 below the mean 11
    assert text(W.visual_lines(w, 4.0)) == ["c a b", "d", "e"]  # 17 is over 4 below the mean 12.17
    assert text(W.visual_lines(w, 4.6, anchored=True)) == ["c a b", "d", "e"]
    bad = spark.createDataFrame([("f", 1, None, 1.0, 1.0, "x"), ("f", 1, 1.0, None, 1.0, "x"), ("f", 1, 1.0, 1.0, None, "ok"), ("f", 1, 2.0, 1.0, None, " "), ("f", 1, 2.0, 1.0, None, None)], "file string, page int, x0 double, y0 double, x1 double, text string")
    assert text(W.visual_lines(bad, 3.0)) == ["ok"]


@pytest.mark.parametrize("layout", [W.affin, W.muamalat, W.maybank, W.rakyat, W.hong_leong, X.uob, K.agro])
def test_empty_and_null_words(spark, layout):
    empty = spark.createDataFrame([], WORDS)
    nulls = spark.createDataFrame([(None,) * 10, ("f", None, None, None, None, None, None, None, None, None), ("f", 1, 1.0, 1.0, 2.0, "nothing", None, 1, "", "")], WORDS)
    assert layout(empty).collect() == [] and layout(nulls).collect() == []


def test_affin(spark):
    w = words(spark, (10, 20, "TARIKH"), (10, 300, "DEBIT"), (10, 400, "KREDIT"), (10, 420, "CREDIT"), (10, 500, "BAKI"), (30, 20, "01-02-24"), (30, 100, "OPENING"), (30, 500, "1.00"), (50, 20, "3/2/2024"), (50, 100, "PAY"), (51, 302, "RM5.OO,"), (60, 100, "MORE"), (61, 298, "(2.00)"), (62, 180, "7.00"), (70, 100, "DATE x"), (80, 100, "lost 9.00"), (100, 20, "31/02/2024"), (120, 20, "4/2/24"), (120, 100, "IN"), (121, 421, "4.00"), (122, 505, "8.00-"))
    assert got(W.affin(w)) == [("2024-02-03", "PAY MORE", 7.0, 0.0, 5.0), ("2024-02-04", "IN", 0.0, 4.0, -8.0)]
    bare = words(spark, (10, 20, "1/1/2024"), (10, 100, "A 5.00 6.00"))
    assert got(W.affin(bare)) == [("2024-01-01", "A", 0.0, 0.0, 6.0)]


def test_muamalat(spark):
    cells = [(10, 30, "01/02/24"), (10, 80, "PAY A"), (11, 190, "R1"), (10, 300, "1,234.50"), (10, 510, ".00"), (14, 620, "inv"), (18, 620, "ref PAGE 3"), (30, 30, "02/02/2024"), (30, 80, "TOTAL"), (50, 80, "3/2/24"), (50, 95, "x -"), (50, 400, "1234.50"), (60, 80, "THIS STATEMENT ends"), (65, 80, "lost"), (80, 30, "04/02/24"), (80, 80, "DEPOSIT"), (100, 30, "99/02/24"), (100, 80, "never")]
    assert got(W.muamalat(words(spark, *cells))) == [("2024-02-01", "PAY A R1 inv", 1234.5, 0.0, 0.0), ("2024-02-03", "x", 0.0, 123.0, 0.0)]
    half = words(spark, (10, 15, "01/02/24"), (10, 40, "A"), (10, 200, "5.00"), width=380.0)
    assert got(W.muamalat(half)) == [("2024-02-01", "A", 0.0, 5.0, 0.0)]


def test_maybank(spark):
    cells = [
        (5, 20, "STATEMENT DATE 31/12/24"), (10, 20, "ENTRY DATE"), (30, 20, "01/02"), (30, 90, "FIRST"), (31, 400, "10.00+"), (31, 500, "110.00"), (38, 90, "detail 5"), (50, 90, "SAME DAY"), (51, 400, "20.00-"), (51, 500, "90.00"),
        (70, 20, "02/02"), (80, 90, "LATER"), (81, 400, "700.00+"), (81, 500, "2,090.00"), (100, 20, "03-02-2024"), (100, 90, "CENTS"), (101, 400, "1.00-"), (101, 500, ".50"), (120, 20, "4 FEB 2024"), (120, 90, "STEP"), (121, 400, "5.00"), (121, 500, "2,000.00"),
        (140, 20, "BAKI LEGAR"), (150, 90, "lost"), (170, 20, "05/02"), (170, 90, "UNSIGNED"), (171, 400, "3.00"), (190, 20, "31/02"), (190, 90, "NO DAY"), (191, 400, "3.00"), (191, 500, "4.00"),
    ]
    rows = got(W.maybank(words(spark, *cells)))
    assert rows[:2] == [("2024-02-01", "FIRST detail 5", 0.0, 10.0, 110.0), ("2024-02-01", "SAME DAY", 20.0, 0.0, 90.0)]
    assert [r[0] for r in rows] == ["2024-02-01", "2024-02-01", "2024-02-02", "2024-02-03", "2024-02-04"]
    assert rows[2][3] == 700.0 and rows[3][4] == 2089.5 and rows[3][2] == 0.5 and rows[4][2] == 89.5
    twice = words(spark, *cells[2:6], *[(y + 100, x, t) for y, x, t in cells[2:6]])
    assert len(got(W.maybank(twice, 2023))) == 1


def test_rakyat_calibrates_its_columns(spark):
    cells = [(10, 20, "Tarikh"), (30, 20, "01/02/2024"), (30, 100, "1234"), (30, 150, "PAY A"), (30, 300, "5.00"), (30, 500, "95.00"), (40, 150, "more"), (60, 150, "IN"), (60, 404, "20.00"), (60, 503, "115.00"), (69, 20, "02/02/2024"), (90, 20, "03/02/2024"), (90, 150, "STEP"), (90, 501, "100.00"), (110, 20, "Baki Permulaan"), (120, 20, "100.00"), (120, 200, "5.00"), (120, 300, "20.00"), (120, 400, "100.00")]
    assert got(W.rakyat(words(spark, *cells)), "code", "opening") == [("2024-02-01", "PAY A more", 5.0, 0.0, 95.0, "1234", 100.0), ("2024-02-02", "IN", 0.0, 20.0, 115.0, "", 100.0), ("2024-02-03", "STEP", 15.0, 0.0, 100.0, "", 100.0)]


def test_hong_leong_guards_its_balance(spark):
    head = [(5, 20, "Balance from previous statement 50.00"), (10, 300, "Deposit"), (10, 400, "Withdrawal"), (10, 500, "Balance")]
    rows = [(30, 20, "01-02-2024"), (30, 90, "OUT"), (31, 400, "80.00"), (50, 20, "02-02-2024"), (50, 90, "IN"), (51, 300, "5.00"), (70, 20, "03-02-2024"), (70, 90, "OD"), (71, 400, "1.00"), (71, 510, "(9.00)"), (90, 20, "04-02-2024"), (90, 90, "OUT"), (91, 400, "3.00"), (100, 20, "Total Withdrawals"), (110, 90, "lost 7.00")]
    assert [(r[4], r[2]) for r in got(W.hong_leong(words(spark, *head, *rows)))] == [(50.0, 80.0), (55.0, 0.0), (-9.0, 1.0), (-12.0, 3.0)]
    assert [r[4] for r in got(W.hong_leong(words(spark, (2, 20, "Overdrawn"), *head, *rows)))] == [-30.0, -25.0, -9.0, -12.0]
    assert got(W.hong_leong(words(spark, *rows))) == []


LINES = "file string, page int, line int, text string, rank string, m int"


def lines(spark, *texts, file="f"):
    return spark.createDataFrame([(file, 1, k, t, "clash", 1) for k, t in enumerate(texts)], LINES)


def cells(spark, *rows, file="f"):
    return spark.createDataFrame([(file, 1, k, list(r)) for k, r in enumerate(rows)], "file string, page int, row int, cells array<string>")


def test_bank_islam_takes_the_first_layout_with_rows(spark):
    two = lines(spark, "1/2/24 early 5.00", "Bal B/F 100.00", "1/2/24 PAY 10.00 90.00", "32/2/24 NEVER 1.00", "2/2/24 IN (95.00)", None, file="two")
    four = lines(spark, "BAL B/IF 1.00", "1/2/24 X 3.00", file="four")
    table = lines(spark, "BAL B/F 100.00", "1/2/24 PAY 10.00 90.00", file="table")
    c12 = ["1", "05/02/2024", None, "T", "INWARD 7.00", None, None, None, None, "50.00", "nan", "P"]
    grid = cells(spark, c12, ["2", "bad"], file="table")
    rows = got(X.bank_islam(two.unionByName(four).unionByName(table), grid), "layout")
    assert rows == [("2024-02-01", "X", 0.0, 2.0, 3.0, "format4"), ("2024-02-05", "1 T INWARD 7.00 P", 0.0, 7.0, 50.0, "format1"), ("2024-02-01", "PAY", 10.0, 0.0, 90.0, "format2"), ("2024-02-02", "IN", 185.0, 0.0, -95.0, "format2")]
    assert got(X.bank_islam(two.limit(0), grid.limit(0))) == []


def test_bank_islam_reads_scans_where_totals_agree(spark):
    text = lines(spark, "BAL B/F 100.00", "1/2/24 A 90.00", file="scan-1").unionByName(lines(spark, "BAL B/F 100.00", "1/2/24 A 90.00", file="scan-2")).unionByName(lines(spark, "BAL B/F 100.00", "1/2/24 A 90.00" + " long" * 40, file="text"))
    told = ["Bal B/F 100.00", "Total Debit 2 30.00 Total Credit 1.00", "1/2/24 A 70.00", "1/2/24 A 7,000.00", "2/2/24 B 71.00"]
    agree = ["Bal B/F 100.00", "Total Debit 1 10.00 Total Credit 0.00", "1/2/24 A 1.00"]
    read = lines(spark, *told, file="scan-1").unionByName(lines(spark, *agree, file="scan-2")).unionByName(lines(spark, *told, file="text"))
    rows = X.bank_islam(text, None, read).orderBy("file", "seq").collect()
    assert [(r.file, r.layout, r.debit, r.credit, r.balance) for r in rows] == [("scan-1", "read", 30.0, 0.0, 70.0), ("scan-1", "read", 0.0, 1.0, 71.0), ("scan-2", "format2", 10.0, 0.0, 90.0), ("text", "format2", 10.0, 0.0, 90.0)]


def test_rhb_layouts(spark):
    period = "Statement Period : 1 Jan 24 - 31 Jan 24"
    account = lines(spark, "ACCOUNT STATEMENT", period, "1 Jan B/F 100.00", "2 Jan PAY 10.00 90.00-", "more", "PAGE NO. 2", "lost", "3 Jan IN 5.00", "4 Jan C/F 5.00", file="a")
    islamic = lines(spark, "RHB ISLAMIC", period, "1 Jan START 100.00", "02 Jan X 95.00", "03 Jan B/F 200.00", "4 Jan Y 201.00", file="i")
    broken = lines(spark, "RHB", period, "1 Jan START 100.00", "31 Feb X 95.00", file="b")
    reflex = lines(spark, "REFLEX", period, "05-01-2024 001 A/B 12345678 - 5.00 95.00-", "06-01-2024 RPP INWARD INST TRF Z 1.00 - 94.00+", file="r")
    every = account.unionByName(islamic).unionByName(broken).unionByName(reflex)
    rows = got(X.rhb(every), "layout")
    assert rows == [
        ("2024-01-02", "PAY more", 190.0, 0.0, -90.0, "account"), ("2024-01-03", "IN", 0.0, 95.0, 5.0, "account"),
        ("2024-01-02", "X", 5.0, 0.0, 95.0, "islamic"), ("2024-01-04", "Y", 0.0, 1.0, 201.0, "islamic"),
        ("2024-01-05", "A / B", 0.0, 5.0, -95.0, "table"), ("2024-01-06", "RPP Z", 1.0, 0.0, 94.0, "table"),
    ]
    w = words(spark, (10, 30, "05-01-2024"), (11, 90, "transfer"), (11, 145, "ALI"), (12, 200, "ali"), (10, 440, "5.00"), (10, 520, ".75-"), (20, 30, "06-01-2024"), (20, 90, "no balance"), (30, 90, "www.rhbgroup.com"), (31, 520, "9.00"), file="r")
    assert got(X.rhb(reflex, w), "layout") == [("2024-01-05", "TRANSFER ALI", 0.0, 5.0, -0.75, "words")]
    assert got(X.rhb(every.limit(0), w.limit(0))) == []


def test_cimb(spark):
    text = lines(spark, "Tarikh Penyata : 05/02/2024", "03/01/2024 LAST 0 5.00 85.00", "02/01/2024 TWO", "parts 10.00 80.00", "more 1.00", "02/01/2024 ONE 90.00", "OPENING BALANCE 100.00", "CLOSING BALANCE / BAKI PENUTUP 85.00")
    want = [("2024-01-01", X.CIMB_MARKERS[0], 0.0, 0.0, 100.0), ("2024-01-02", "ONE", 10.0, 0.0, 90.0), ("2024-01-02", "TWO parts", 10.0, 0.0, 80.0), ("2024-01-03", "LAST", 0.0, 5.0, 85.0), ("2024-01-03", X.CIMB_MARKERS[1], 0.0, 0.0, 85.0)]
    assert got(X.cimb(text)) == want
    grid = [["Date", "", "", "", "", ""], ["03/01", "LAST", "", None, "5.00", "85.00"], ["02/01/2024", "TWO", "", "10.00", "", "80.00"], ["02/01/2024", "TWO AGAIN", "", "10.00", "", "80.00"], ["2024-01-02", "ONE", "", "10", "0", "90"], [None, "Opening balance", None, None, None, "100.00"], ["02/01/2024", "no amount", "", "", "", "1.00"], ["02/01/2024", "no balance", "", "1.00", "", None]]
    plain = [(d, t.replace(" parts", ""), *r) for d, t, *r in want]
    assert got(X.cimb(text, cells(spark, *grid))) == plain
    forward = [grid[0], grid[4], grid[2], grid[1], grid[5]]
    assert got(X.cimb(text, cells(spark, *forward), found=True)) == plain and got(X.cimb(text, cells(spark, *grid), found=True)) == plain
    assert got(X.cimb(text.limit(0), cells(spark, *grid).limit(0))) == []


START = re.compile(X.UOB_START)


def repaired_by_hand(texts):
    d = [" ".join(t.split()) for t in texts]
    join = lambda *p: " ".join(" ".join(p).split())
    for i in range(len(d) - 1):
        if not d[i] or not d[i + 1] or not START.match(d[i]) or START.match(d[i + 1]):
            continue
        found = list(START.finditer(d[i]))
        if not d[i][found[0].end() :].strip():
            d[i + 1] = join(d[i], d[i + 1])
        elif len(found) > 1:
            at = found[-1].start()
            d[i], d[i + 1] = d[i][:at].strip(), join(d[i][at:], d[i + 1])
    up(d, True)
    for i in range(len(d) - 1):
        found = list(START.finditer(d[i]))
        if len(found) > 1:
            kept, tail = d[i][: found[-1].start()].strip(), d[i][found[-1].start() :].strip()
            if kept and not (re.match(r"(?i)(CHEQUE|CHQ)\b", tail) and "||" not in kept):
                after = d[i + 1]
                d[i] = kept
                d[i + 1] = after if after.upper().startswith(tail.upper()) else join(tail, after)
    up(d, False)
    return d


def up(d, stays):
    for i in range(1, len(d)):
        m = START.search(d[i])
        if not m or not m.start():
            continue
        front, rest = d[i][: m.start()].strip(), d[i][m.start() :].strip()
        if "||" not in front or not rest:
            continue
        s = re.match(r"(?i)^(.+?\|\|)\s+((?:DR|CR)\s+\S+)\s*$", front) if stays else None
        own = ""
        if s:
            front, own = s.group(1), s.group(2)
        d[i - 1], d[i] = " ".join(f"{d[i - 1]} {front}".split()), " ".join(f"{own} {rest}".split())


def test_tails_go_back_to_their_rows(spark):
    rng = random.Random(4)
    bits = ["DuitNow/Instant Trf", "Fund Trf", "CHQ", "cheque deposit", "JomPAY", "OD Int Charge", "OD interest", "ALPHA", "BETA WORKS", "MOTOR||", "C01||", "X|", "DR 55", "CR A1", "XDR", "", "12"]
    rows = []
    for f in range(60):
        for k in range(rng.randint(1, 9)):
            rows.append((str(f), k, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 5))).strip() or "x", 5))
    df = spark.createDataFrame(rows, "file string, seq int, description string, gives int")
    made = {(r.file, r.seq): r.description for r in X.repaired_tails(df.drop("gives")).collect()}
    for f in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == f]
        assert [made[f, r[1]] for r in own] == repaired_by_hand([r[2] for r in own]), [r[2] for r in own]


def test_banks_read_files_of_words_and_lines(spark, tmp_path):
    from tallyspark.sources import statements as Z

    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.tsv").write_text("1\t15\t10\t25\t01/02/24\t380\n1\t40\t10\t45\tA\t380\n1\t200\t10\t220\t5.00\t380\nbad line\n1\tx\t1\t1\tno place\n")
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "b.txt").write_text("BAL B/F 100.00\n1/2/24 PAY 90.00\n")
    assert got(Z.read(spark, str(tmp_path / "w"), "Bank Muamalat")) == [("2024-02-01", "A", 0.0, 5.0, 0.0)]
    assert got(Z.read(spark, str(tmp_path / "l"), "Bank Islam"), "layout") == [("2024-02-01", "PAY", 10.0, 0.0, 90.0, "format2")]


def test_agro(spark):
    one = [(5, 20, "Aktiviti Akaun Anda"), (8, 200, "before any row"), (20, 20, "01/02/24"), (20, 90, "BEGINNING BALANCE"), (21, 400, "100.00"), (40, 20, "2/02/24"), (40, 60, "123456"), (40, 130, "FPX PAYMENT 0"), (41, 300, "10.00-"), (41, 400, "90.00"), (50, 90, "ALI 5.00"), (60, 90, "Semua catatan"), (70, 90, "lost"), (80, 20, "31/02/24"), (80, 400, "7.00"), (90, 20, "03/02/24"), (90, 90, "no amount")]
    two = [(5, 200, "early"), (10, 20, "DATE REFERENCE NO. DETAILS"), (20, 100, "left"), (22, 30, "x"), (30, 200, "BIN ABU"), (40, 20, "4/02/24"), (40, 90, "CLOSING BALANCE"), (40, 400, ".50-"), (50, 200, "lost too"), (60, 20, "TOTAL DEBIT 10.00"), (70, 20, "TOTAL CREDIT 0.00")]
    both = words(spark, *one).unionByName(words(spark, *two, page=2))
    rows = got(K.agro(both), "marker", "category", "check")
    assert rows == [("2024-02-01", "BEGINNING BALANCE", 0.0, 0.0, 100.0, True, "Balance Marker", "#"), ("2024-02-02", "123456 FPX PAYMENT | ALI | BIN ABU", 10.0, 0.0, 90.0, False, "Online Payment", "#"), ("2024-02-04", "CLOSING BALANCE", 90.5, 0.0, -0.5, True, "Balance Marker", "#")]
    fits = words(spark, *one).unionByName(words(spark, *[(y, x, t.replace("10.00", "100.50")) for y, x, t in two], page=2))
    assert {r[-1] for r in got(K.agro(fits), "check")} == {""}


def test_ambank(spark):
    texts = ["Statement Date / Tarikh Penyata : 31/01/2024", "Baki Pembukaan", "100.00", "01-Jan SERVICE FEE 5.00", "95.00 DR", "2 Jan MISC", "CREDIT 7.00 102.00", "Total / Jumlah 1.00 2.00", "lost", "03Jan PLAIN 9.00 93.00", "31-Feb NEVER 1.00 1.00", "lost", "04-Jan X 90.00", "Privacy Notice", "05-Jan lost 1.00"]
    rows = got(K.ambank(lines(spark, *texts)), "marker")
    assert rows == [("2024-01-01", "SERVICE FEE", 5.0, 0.0, 95.0, False), ("2024-01-02", "MISC CREDIT", 0.0, 7.0, 102.0, False), ("2024-01-03", "PLAIN", 9.0, 0.0, 93.0, False), ("2024-01-04", "X", 3.0, 0.0, 90.0, False)]
    brought = lines(spark, "05 Jan TRF 4.00 46.00", "Balance Brought Fwd 50.00", "06 Jan 1.00")
    assert got(K.ambank(brought, 2024), "marker") == [("2024-01-01", K.AMBANK_MARKER, 0.0, 0.0, 50.0, True), ("2024-01-05", "TRF", 4.0, 0.0, 46.0, False), ("2024-01-06", K.AMBANK_NOTHING, 49.0, 0.0, 1.0, False)]
    assert got(K.ambank(brought)) == [] or all(r[0] is None for r in got(K.ambank(brought)))
    assert K.ambank(lines(spark, None, "", "x")).collect() == [] and K.ambank(lines(spark, "x").limit(0)).collect() == []

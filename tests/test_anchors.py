"""Shared beginnings, runs and spellings of names, names sought in texts, holidays: against plain Python over all of them."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.operators import anchors as A
from tallyspark.operators import ledger as L
from tallyspark.operators import names as N

NAMES = "name string, alias int, run string, key int"


def table(spark, values):
    return spark.createDataFrame([(v, 1, "clash", 2) for v in values], NAMES)


def made_up(n, seed):
    rng = random.Random(seed)
    parts = ["ALPHA", "BRAVO", "CHARLIE", "DELTA"], ["WORKS", "FOODS", "BIN"], ["NORTH", "SOUTH", "12", ""], ["", "SDN BHD", "SDN B", "BERHAD", "TRADING PLT", "MBB"]
    return [" ".join(w for w in (rng.choice(p) for p in parts) if w) for _ in range(n)]


def order(v):
    return len(v.split()), len(v), v


def front_by_hand(values):
    now = {v: v for v in values}
    for size in (3, 2):
        groups: dict = {}
        for v in set(now.values()):
            w = v.split()
            if v not in A.NOBODY and len(w) >= size and not any(x.strip(" .,-") in N.PERSON_MARKERS for x in w):
                groups.setdefault(" ".join(w[:size]), []).append(v)
        new = {}
        for front, g in groups.items():
            if len(g) > 1:
                forms = [v for v in g if set(v.split()) & set(A.LEGAL_FORMS)]
                new.update(dict.fromkeys(g, min(forms, key=order) if forms else front))
        now = {v: new.get(a, a) for v, a in now.items()}
    return now


def test_front_aliases(spark):
    values = made_up(150, 1) + ["", "UNKNOWN", None, "ALPHA"]
    got = {r.name: r.alias for r in A.front_aliases(table(spark, values)).collect()}
    assert got == front_by_hand({v for v in values if v is not None}) and any(k != v for k, v in got.items())
    assert A.front_aliases(table(spark, [])).collect() == []


def test_shared_runs(spark):
    values = sorted(set(made_up(120, 2))) + ["LONE NAME HERE", "X", None, "ALPHA WORKS"]
    names = {v for v in values if v is not None}
    words = {v: [w for w in v.split() if w not in N.NAMELESS and not w.isdigit()] for v in names}
    runs = {v: {" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)} for v, w in words.items()}
    want = {}
    for v in names:
        shared = [r for r in runs[v] if any(r in runs[o] for o in names - {v})]
        if shared:
            run = min(shared, key=lambda r: (-len(r.split()), -len(r.replace(" ", "")), r))
            entities = {N.legal_entity(o) for o in names if run in runs[o]} - {""}
            held = [e for e in entities if f" {run} " in f" {e} "]
            want[v] = (run, min(held, key=order) if held else run)
    got = {r.name: (r.run, r.alias) for r in A.shared_runs(table(spark, values)).collect()}
    assert got == want and "LONE NAME HERE" not in got and len(got) > 20
    for v in list(names)[:40]:  # the longest run of any pair is the longest that the name shares
        longest = max((N.shared_run(" ".join(words[v]), " ".join(words[o])) for o in names - {v}), default=0)
        assert (len(got[v][0].split()) if v in got else 0) == (longest if longest > 1 else 0)


def test_legal_entities(spark):
    values = ["A SDN BHD X", "A B SDN", "A BERHAD", "A B PLT", "A LLP C", "SDN BHD", "A BHD", "NONE", "A SDNX"]
    got = {r.name: r.e or "" for r in table(spark, values).select("name", A.legal(F.col("name")).alias("e")).collect()}
    assert {k: v for k, v in got.items() if k != "SDN BHD"} == {v: N.legal_entity(v) for v in values if v != "SDN BHD"}


def test_markerless_names_of_one_person_meet(spark):
    rng = random.Random(3)
    lead, given, second = ["", "CIK", "TRIP ALLOWANCE", "INTAN", "99"], ["MOHD", "SITI", "WAN"], ["KHAWAZATUL", "KHAWAZ", "KHAWAZAT", "NUR", "NURAFIFAH", "DANIAL"]
    third, tail = ["", "FAEZ", "FA", "HANIM", "HAN", "BIN ALI", "FAEZ AZHAR"], ["", "MBB", "123", "CLAIM", "SDN BHD"]
    values = sorted({" ".join(w for w in (rng.choice(p) for p in (lead, given, second, third, tail)) if w) for _ in range(400)})
    runs = {r.name: r.r for r in table(spark, values).select("name", A.markerless_run(F.col("name")).alias("r")).collect()}
    assert runs["MOHD KHAWAZATUL FAEZ MBB"] == ["MOHD", "KHAWAZATUL", "FAEZ"] if "MOHD KHAWAZATUL FAEZ MBB" in runs else True
    for v, r in runs.items():
        assert (r is None) == (v.startswith("INTAN") or "BIN" in v.split() or "SDN" in v.split() or not any(len(w) >= 6 and w not in A.GIVEN_NAMES and w not in A.MEMO for w in v.replace("TRIP ALLOWANCE ", "").split() if w != "CLAIM")), (v, r)
    some = [r for r in runs.values() if r]
    whole = dict(zip(map(tuple, some), map(" ".join, A.clustered(some)), strict=True))  # over all at once, without keys
    named = [whole[tuple(r)] for r in some]
    want = {v: whole[tuple(r)] for v, r in runs.items() if r and named.count(whole[tuple(r)]) > 1}
    got = {r.name: r.alias for r in A.markerless_aliases(table(spark, [*values, None])).collect()}
    assert got == want and len(want) > 50


def test_names_in_texts(spark):
    rng = random.Random(5)
    names = ["AB", "a", "ABCD", "bcde f", "", None, "XYZ SDN BHD", "SDN BHD", "D BH", "é日本", "ZZZZZ"] + ["".join(rng.choice("ABC ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [(k, "".join(rng.choice("abcdeABCDE SNH") for _ in range(rng.randint(0, 40)))) for k in range(200)] + [(900, None), (901, "to xyz sdn bhd 12"), (902, "É日本 x"), (902, "abcd")]
    rows = spark.createDataFrame([(k, t, "clash", "clash") for k, t in texts], "row_order long, description string, name string, piece string")
    got = sorted((r.row_order, r.name) for r in A.names_in(rows, table(spark, names), "row_order", F.col("description")).collect())
    assert got == sorted((k, n) for k, t in texts if t is not None for n in {v.upper() for v in names if v} if n in t.upper())
    assert A.names_in(rows, table(spark, ["", None]), "row_order", F.col("description")).collect() == []
    assert A.names_in(rows.limit(0), table(spark, names), "row_order", F.col("description")).collect() == []


def test_calendar_counts_business_days(spark):
    days = [dt.date(2024, 4, 26) + dt.timedelta(k) for k in range(40)]
    free = [dt.date(2024, 5, 1), dt.date(2024, 5, 4), None, dt.date(2024, 5, 1), dt.date(2030, 1, 1)]
    rows = L.calendar(F.min("d"), F.max("d"), spark.createDataFrame([(d,) for d in days], "d date"), spark.createDataFrame([(d,) for d in free], "day date")).collect()
    number = {r.day: r.number for r in rows}
    works = lambda d: d.weekday() < 5 and d not in free
    assert all(number[b] - number[a] == sum(works(x) for x in days if a < x <= b) for a in days for b in days if a <= b)
    assert L.calendar(F.min("d"), F.max("d"), spark.createDataFrame([], "d date"), spark.createDataFrame([], "day date")).collect() == []


def test_groups_are_named_by_rank(spark):
    assert N.by_rank({"ALPHA FOODS SDN B": 9, "ALPHA FOODS NORTH SDN BHD": 1}) == "ALPHA FOODS SDN BHD"
    assert N.by_rank({"ALI BT ABU": 9, "ALI BIN ABU": 1, "ALI BIN AB": 2}) == "ALI BIN ABU"
    assert N.by_rank({"ALPHA WORKS CASH": 5, "ALPHA WORKS MBB": 2}) == "ALPHA WORKS" and N.by_rank({"SHOP": 1, "SHOPS": 2}) == "SHOPS"
    values = ["ALPHA HARDWARE SDN B", "ALPHA HARDWARE SDN B", "ALPHA HARDWARE SDN BHD", "ALPHA HARDWAR SDN BHD", "BRAVO"]
    got = {r.name: r.alias for r in N.merge_rounds(table(spark, values), choose=N.by_rank).collect()}
    assert got == dict.fromkeys(values[:4], "ALPHA HARDWAR SDN BHD") | {"BRAVO": "BRAVO"}


def test_a_key_of_many_names_is_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    values = sorted({f"PAYMENT TO {rng.choice('ABCDE')}{rng.choice('LMN')} {'X' * rng.randint(1, 6)} {rng.choice(['WORKS', 'WORK', 'FOODS', 'FOOD'])}" for _ in range(90)})
    whole = sorted(map(tuple, N.merged_pairs(table(spark, values), N.RULES).collect()))
    assert whole == sorted((a, b) for k, a in enumerate(values) for b in values[k + 1 :] if any(r(a, b) for r in N.RULES)) and len(whole) > 20
    monkeypatch.setattr(N, "BLOCK", 7)
    assert sorted(map(tuple, N.merged_pairs(table(spark, values), N.RULES).collect())) == whole

"""Rows that share an id but not a text lose nothing that is their own."""

from __future__ import annotations

from tallyspark.llm.lines import dedup_lines
from tallyspark.llm.simhash import keep_one

WORDS = "the quick brown fox jumps over a lazy dog while seven more sleepy cats watch from behind the old garden wall near town"


def test_lines_of_another_text_under_one_id_stay(spark):
    rows = [(1, "head line of all\nthis line comes again in five"), (5, "this line comes again in five\nown words here"), (5, "two different ones\nunique line only here now"), (5, "two different ones\nunique line only here now"), (6, "unique line only here now\nlast")]
    got = sorted((r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "head line of all\nthis line comes again in five"), (5, "own words here"), (5, "two different ones\nunique line only here now"), (5, "two different ones\nunique line only here now"), (6, "last")]


def test_similar_lines_are_read_from_the_right_text(spark):
    a, b = "one two three four five six seven eight", "one two three four five six seven nine"
    rows = [(1, f"other words\n{a}"), (1, "first\nwholly different words stand at that number here"), (2, f"{b}\nrest")]
    got = sorted((r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "first\nwholly different words stand at that number here"), (1, f"other words\n{a}"), (2, "rest")]


def test_numbers_tell_lines_apart(spark):
    rows = [(1, "Price 10"), (2, "Price 99"), (3, "price, 10!"), (4, "in 2019 we met"), (5, "in 2020 we met")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Price 10", 2: "Price 99", 3: "", 4: "in 2019 we met", 5: "in 2020 we met"}


def test_a_text_of_its_own_outlives_a_near_copy_with_its_id(spark):
    rows = [(1, WORDS), (2, WORDS + " today"), (2, "nothing like the other text at all but a few words of its own kind"), (3, WORDS), (3, None), (4, ""), (None, WORDS), (2, "nothing like the other text at all but a few words of its own kind")]
    got = sorted((str(r.doc_id), str(r.text)) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    own = "nothing like the other text at all but a few words of its own kind"
    assert got == sorted([("1", WORDS), ("2", own), ("2", own), ("3", "None"), ("None", WORDS)])

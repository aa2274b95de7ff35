"""What comparing lines costs: edit distances are sought only where counts of words allow them, and no further than needed."""

import random

from tallyspark.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines_of_other_counts_of_words_are_not_aligned(monkeypatch):
    def refuse(*_):
        raise AssertionError("aligned")

    monkeypatch.setattr(L, "edit_distance", refuse)
    assert not L.similar(list("aaaaaaaabc" * 3), list("abbbbcccca" * 3), 0.8)
    assert L.similar(list("abcdefghij"), list("abcdexghij"), 0.8)


def test_a_distance_is_left_off_once_its_diagonal_passes_the_most():
    class Word(str):
        seen = 0

        def __hash__(self):
            Word.seen += 1
            return super().__hash__()

        __eq__ = str.__eq__

    x, y, z = ([Word(f"{c}{k}") for k in range(200)] for c in "xyz")
    a, b = x + y, y + z
    assert L.edit_distance(a, b, 10) == 11
    assert Word.seen < 900  # each of ``a`` twice to be placed, few of ``b``


def test_distances_and_similar_lines_are_those_of_the_full_table():
    rnd = random.Random(7)
    for _ in range(400):
        a = [rnd.randrange(rnd.choice([2, 6, 40])) for _ in range(rnd.randrange(60))]
        b = list(a) if rnd.random() < 0.7 else [rnd.randrange(6) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(14)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(40))
            if rnd.random() < 0.6:
                b.pop(rnd.randrange(len(b)))
        d = distance(a, b)
        assert L.edit_distance(a, b) == d
        for most in (0, max(d - 1, 0), d, d + 1, 30):
            assert min(L.edit_distance(a, b, most), most + 1) == min(d, most + 1)
        assert L.similar(a, b, 0.8) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_lines_are_counted_by_their_breaks(spark):
    made = [(1, ""), (2, "a"), (3, "é\nß\n"), (4, "\n\n\n"), (5, None), (6, "a\r\nb")]
    rows = L.dedup_lines(spark.createDataFrame(made, "doc_id long, text string"), counts=True).collect()
    assert {r.doc_id: r.n_lines for r in rows} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 0, 6: 2}

import itertools
import random
import time
import zlib

import numpy as np
import pytest
import xxhash

from tallyspark.llm import mixing, packing, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, task int, fp string"
ODD = [
    (1, "one two three four five six", "en", "b", 0, "x", 1, "f"),
    (2, "one two three four five six", "en", "b", 0, None, None, None),
    (2, "one two three four five six", "en", "b", 0, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, None, None, None),
    (5, " \n\t ", "en", "", 0, None, None, None),
    (None, "no id at all", "en", "c", 0, None, None, None),
    (6, "word " * 30000, "en", "c", 0, None, None, None),
    (7, "tail <|endoftext|> tail", "en", "\U0001f600", 0, None, None, None),
    (8, "ONE two three four five six", "en", "￿", 0, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(docs):
    return [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rows", ["3", "10000"])
def test_simhash_matches_brute_force(spark, docs, rows):
    fps = {i: brute_fingerprint(t) for i, t in texts(docs)}
    want = brute_components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    got = simhash.simhash_components(docs).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_trie_walk_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 1, 2, 3, 4)]
    a = np.unique(np.concatenate([base, np.array(flips, dtype=np.uint64), np.arange(50, dtype=np.uint64)]))
    want = {(i, j) for i, j in itertools.combinations(range(len(a)), 2) if (int(a[i]) ^ int(a[j])).bit_count() <= 2}
    got = [p for i, j in simhash.trie_links(a, a, 2, True, most=64) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    for turn, top in simhash.rotations(2):
        r = np.sort(a << np.uint64(turn) | a >> np.uint64(64 - turn)) if turn else a
        got = {p for i, j in simhash.trie_links(r, r, 2, True, top=top) for p in zip(i.tolist(), j.tolist())}
        assert got == {(i, j) for i, j in itertools.combinations(range(len(r)), 2) if (int(r[i]) ^ int(r[j])).bit_count() <= 2 and int(r[i]) >> (64 - top) == int(r[j]) >> (64 - top)}
    b = a[::3]
    got = {p for i, j in simhash.trie_links(b, a, 2, False) for p in zip(i.tolist(), j.tolist())}
    assert got == {(i, j) for i in range(len(b)) for j in range(len(a)) if (int(b[i]) ^ int(a[j])).bit_count() <= 2}


def test_simhash_odd_rows(spark, odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[3] == by[4] == by[5] == [("0" * 16, 3)]
    assert by[1][0][1] == by[2][0][1] == by[2][1][1] == by[8][0][1] == 1
    assert by[None][0][1] is None
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.keep_one(odd, shingle_words=3)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 7]
    assert kept.columns == odd.columns


def test_token_counts_match_library(docs, odd):
    lib = tokens.library()
    for table in (docs, odd):
        got = tokens.token_counts(table).collect()
        have = [(r[0], r[1] or "") for r in table.select("doc_id", "text").collect()]
        want = sorted((i or -1, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in have)
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_prefix_counts_are_exact():
    lib, dp = tokens.library(), tokens.PrefixTable()
    rng = random.Random(5)
    cases = ["a  b", "x \ny  \n\n z", " <|endoftext|>a<|endoftext|> ", "it's 12abc don't 'll  ", "日本 \U0001f642 \xe9 \x1c\x85", "", "՘ ꟎ x"]
    cases += ["".join(rng.choice("ab  \n'st1.\xe9あ") for _ in range(40)) for _ in range(40)]
    for t in cases:
        want = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert dp.prefixes(t) == want, t
        assert tokens.token_ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert dp.truncate("the quick brown fox", 2) == "the quick"


def test_prefix_rows_of_long_pieces_and_stored_counts(spark):
    lib, dp = tokens.library(), tokens.PrefixTable()
    rng = random.Random(9)
    for t in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "é" * 3000, "字引" * 2000, " " * 20_000, "'re're 'res 'r", "!!<|endoftext|>!", "a \n <|endoftext|>  b<|endo"):
        began = time.perf_counter()
        counts = dp.prefixes(t)
        assert time.perf_counter() - began < 5 and len(counts) == len(t) + 1
        for i in {0, 1, len(t), *(rng.randrange(len(t)) for _ in range(20))}:
            assert counts[i] == len(lib.encode(t[:i], add_special_tokens=False).ids)
        dp.encode_piece = None  # the stored counts answer any budget
        for budget in (0, 1, counts[-1] // 2, counts[-1]):
            cut = dp.truncate(t, budget, counts)
            assert len(lib.encode(cut, add_special_tokens=False).ids) <= budget and all(n > budget for n in counts[len(cut) + 1 :])
        dp = tokens.PrefixTable()
    rows = [(1, "the quick brown fox"), (2, ""), (3, None), (4, "日本 it's")]
    counted = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), prefixes=True)
    texts_too = counted.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    got = {r.doc_id: r.text for r in tokens.truncated(texts_too, 2).collect()}
    assert got == {i: t and dp.truncate(t, 2) for i, t in rows}


def packed(rows, source):
    lib = tokens.library()
    ids = {}
    for i, t in source:
        ids.setdefault(i, []).append(lib.encode(t, add_special_tokens=False).ids + [2])
    room, seen = {}, {}
    for r in rows:
        assert 1 <= r.length <= 1024
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for i, copies in ids.items():
        want = []
        for x in copies:
            head = len(x) % 1024 or min(len(x), 1024)
            cuts = [0, *range(head, len(x), 1024), len(x)]
            want += [(k, s, e - s, zlib.crc32(np.array(x[s:e], dtype="<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(seen[i]) == sorted(want)
    total = sum(len(x) for c in ids.values() for x in c)
    return len(room), -(-total // 1024)


def test_packing_is_whole_and_tight(spark, docs, odd):
    used, least = packed(packing.pack(docs).collect(), texts(docs))
    assert used <= 1.02 * least + 1
    packed(packing.pack(odd).collect(), [(r[0], r[1] or "") for r in ODD])
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bins_use_up_the_histogram_and_are_fullest():
    rng = random.Random(1)
    for _ in range(30):
        counts = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        plan = packing.plan_bins(counts, 40)
        used = {}
        for pattern, times in plan:
            assert times > 0 and sum(k * c for k, c in pattern.items()) <= 40
            for k, c in pattern.items():
                used[k] = used.get(k, 0) + c * times
        assert used == counts
        best = max(sum(x) for n in range(4) for x in itertools.combinations([k for k, n in counts.items() for _ in range(min(n, 3))], n) if sum(x) <= 25)
        assert sum(packing.fullest(counts, sorted(counts, reverse=True), 25)) >= best


def brute_targets(per, weights=(3, 1, 2)):
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in per)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(per.values())
    while True:
        free = [s for s in order if s not in full]
        rate = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if rate * w[s] > 2 * per[s]]
        if not over:
            return target | {s: rate * w[s] for s in free}
        for s in over:
            full.add(s)
            target[s] = 2.0 * per[s]
            left -= 2 * per[s]


@pytest.mark.parametrize("block_words", [64, 1024])
def test_mix_meets_targets(docs, odd, block_words):
    for table in (docs, odd):
        have = table.select("doc_id", "text", "source").collect()
        size = [len((r.text or "").encode().split()) for r in have]
        per = {}
        for r, n in zip(have, size):
            per[r.source] = per.get(r.source, 0) + n
        want = brute_targets(per)
        got = mixing.mix_counts(table, block_words=block_words).collect()
        assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r.doc_id or -1, n) for r, n in zip(have, size))
        assert sorted({(r.source_size, round(r.target, 4)) for r in got}) == sorted({(per[s], round(want[s], 4)) for s in per})
        taken = {}
        for r in got:
            assert 0 <= r.taken <= 2 * r["size"]
            taken[r.source_size, round(r.target, 4)] = taken.get((r.source_size, round(r.target, 4)), 0) + r.taken
        groups = {}
        for s in per:
            k = (per[s], round(want[s], 4))
            groups[k] = groups.get(k, 0) + int(want[s] + 1e-9)
        for k in groups:
            assert abs(taken[k] - groups[k]) <= len(per)
        again = mixing.mix_counts(table, block_words=block_words).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_hold_the_words_taken(spark, docs, odd):
    for table in (docs, odd):
        out = mixing.mix_documents(table)
        assert out.columns == table.columns
        n = sum(len((r.text or "").encode().split()) for r in out.collect())
        want = sum(r.taken for r in mixing.mix_counts(table).collect())
        assert n >= want - 1 and (table is odd or n == want)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_trie_walk_with_equal_members():
    a = np.sort(np.array([7] * 1500 + [8] * 3 + [15], dtype=np.uint64))
    got = [p for i, j in simhash.trie_links(a, a, 1, True, most=1000) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) == 1500 * 1499 // 2 + 3 + 1500

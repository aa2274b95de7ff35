import itertools
import random
import time

import numpy as np

from tallyspark.llm import hnsw, lines, simhash, toxicity

from .test_tokens_packing_mixing_simhash import brute_components

DOCS = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_keep_one_matches_brute_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    base = [" ".join(f"w{k}x{j}" for j in range(60 + 40 * k)) for k in range(8)]
    extra = [(10_000 + 10 * k + n, " ".join(w if j % (len(b.split()) // n + 1) or not j else f"new{j}" for j, w in enumerate(b.split()))) for k, b in enumerate(base) for n in (1, 2, 3, 5, 8)]
    rows = [(i, t) for i, t in docs.collect()] + extra
    sets = {i: shingles(t) for i, t in rows}
    at, links = {}, []
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    near = {p for ids in at.values() for p in itertools.combinations(sorted(ids), 2)}
    links = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert any((simhash.fingerprint(dict(rows)[a], 5) ^ simhash.fingerprint(dict(rows)[b], 5)).bit_count() > 2 for a, b in links)
    blank = sorted(i for i, s in sets.items() if not s)
    links += [(blank[0], i) for i in blank[1:]]
    want = set(brute_components(list(sets), links).values())
    got = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == sorted(want)


def test_lines_at_the_similarity_are_grouped(spark):
    """Recall against brute force on edit similarity alone, in lines of every length."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    kinds, last = {}, {}
    rows = [(i, t) for i, t in docs.collect() if t]
    for n in (5, 6, 8, 10, 12, 15, 19, 25, 40, 80, 150):
        for k in range(8):
            words = [f"q{n}a{k}b{j}" for j in range(n)]
            far = [w if j % 5 != k % 5 or j // 5 >= n // 5 else f"z{w}" for j, w in enumerate(words)]
            rows += [(20_000 + 100 * n + 2 * k, " ".join(words)), (20_001 + 100 * n + 2 * k, " ".join(far))]
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            w = tuple(lines.normal_words(line))
            if len(w) >= lines.MIN_WORDS:
                kinds[w] = min(kinds.get(w, (i, k)), (i, k))
                last[i, k] = w
    ordered = sorted(kinds, key=len)
    bags = [set(w) for w in ordered]
    linked = []
    for x, w in enumerate(ordered):
        for y in range(x):
            if len(ordered[y]) >= 0.8 * len(w) - 1e-6 and len(bags[x] - bags[y]) <= 0.2 * len(w) + 1e-6 and lines.similar(list(w), list(ordered[y]), 0.8):
                linked.append((x, y))
    group = brute_components(range(len(ordered)), linked)
    first = {}
    for x, w in enumerate(ordered):
        first[group[x]] = min(first.get(group[x], kinds[w]), kinds[w])
    index = {w: x for x, w in enumerate(ordered)}
    want = {p for p, w in last.items() if first[group[index[w]]] != p}
    _, gone = lines.repeated_lines(spark.createDataFrame(rows, DOCS))
    got = {tuple(r) for r in gone.collect()}
    print("lines gone", len(got), "of", len(want))
    assert got <= want and len(got) >= 0.98 * len(want)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_is_the_edit_distance():
    draw = random.Random(3)
    for _ in range(3000):
        a, b = ([draw.choice("abc") for _ in range(draw.randrange(14))] for _ in "ab")
        assert lines.edit_distance(a, b) == plain_distance(a, b)
        assert lines.similar(a, b, 0.8) == (5 * plain_distance(a, b) <= max(len(a), len(b)))


def edited(words, edits, draw, fresh):
    """``words`` with so many of them replaced, taken out or put in before, at random places."""
    out = list(words)
    for at in sorted(draw.sample(range(len(words)), edits), reverse=True):
        kind = draw.randrange(3) if edits == 1 or len(words) >= 10 else 0
        out[at : at + 1] = [[fresh()], [], [fresh(), out[at]]][kind]
    return out


def test_recall_of_similar_lines(spark):
    """Planted pairs at one edit and at a fifth of the words, among lines of the same words: at least 0.97 are found."""
    draw = random.Random(11)
    vocabulary = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) + "x" * (k % 7) for k in range(3000)]
    fresh = lambda: draw.choice(vocabulary)
    rows, pairs = [], {}
    for n in (5, 10, 20, 80):
        for edits in sorted({1, n // 5}):
            for k in range(150):
                words = [fresh() for _ in range(n)]
                other = edited(words, edits, draw, fresh)
                if lines.similar(words, other, 0.8):
                    pairs.setdefault((n, edits), []).append(len(rows) + 1)
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    _, gone = lines.repeated_lines(spark.createDataFrame(rows, DOCS).repartition(8))
    got = {r.doc_id for r in gone.collect()}
    for (n, edits), ids in pairs.items():
        found = sum(i in got for i in ids) / len(ids)
        print(f"{n} words, {edits} edits: {found:.3f} of {len(ids)}")
        assert len(ids) >= 100 and found >= 0.97
    planted = {i for ids in pairs.values() for i in ids}
    assert not got - planted


def test_many_lines_with_one_simhash_and_few_shared_words(spark):
    """Rows of a number table: 20,000 lines that share six of eight words and so a bucket; short lines count too."""
    draw = random.Random(5)
    names = [f"name{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(4000)]
    rows = [(k, f"{k % 90 + 10} {k % 80 + 10} 17 4 99 {k % 70 + 10} {names[draw.randrange(4000)]} {names[draw.randrange(4000)]}") for k in range(20_000)]
    kinds = sorted({tuple(lines.normal_words(t)) for _, t in rows})
    left, right = {}, {}
    for k, w in enumerate(kinds):
        left.setdefault(w[:7], []).append(k)
        right.setdefault(w[:6] + w[7:], []).append(k)
    links = [(g[0], k) for d in (left, right) for g in d.values() for k in g[1:]]
    group = brute_components(range(len(kinds)), links)
    few = [(30_000 + k, t) for k, t in enumerate(["All rights reserved", "chapter one", "All rights: reserved!", "", "*", "chapter one\nchapter 1"])]
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows + few, DOCS)).collect()}
    assert sum(out[k] != "" for k, _ in rows) == len(set(group.values()))
    assert [out[30_000 + k] for k in range(6)] == ["All rights reserved", "chapter one", "", "", "*", "chapter 1"]


def test_line_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nx", 1, 2, "q", 3), (2, "a b c d e", 4, 5, "r", 6), (None, "a b c d e", 7, 8, None, 9)], "doc_id long, text string, gone_id int, GONE_LINES int, kept_text string, text_parts int")
    got = lines.dedup_lines(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {tuple(r) for r in got.collect()} == {(1, "a b c d e\nx", 1, 2, "q", 3, 2, 0), (2, "", 4, 5, "r", 6, 1, 1), (None, "a b c d e", 7, 8, None, 9, 1, 0)}


def test_restore_decodes_digits_and_signs_at_the_edges(spark):
    docs = spark.createDataFrame([(1, " ".join(["idiot moron pathetic worthless stupid disgusting loser trash obscene the and of that"] * 50))], DOCS)
    d = toxicity.Decoder(toxicity.language_model(toxicity.trigram_counts(docs)))
    for written, word in (("1d10t", "idiot"), ("5tupid", "stupid"), ("0bscene", "obscene"), ("$tupid", "stupid"), ("$tup1d!", "stupid"), ("id.i.ot", "idiot"), ("!diot", "idiot"), ("m0r0n.", "moron"), ("(1d10t)", "idiot"), ("tr4sh!!", "trash"), ("l000ser", "loser"), ("l0000ser", "loser")):
        assert word in d.restore(f"you are a {written} and that"), written
    for written in ("i d i o t", "s  t  u  p  i  d", "1 d 1 0 t", "S.T.U.P.1.D", "m - o - r - o - n"):
        for word in ("idiot", "stupid", "moron"):
            assert (word in d.restore(f"you are {written} !")) == (word[0] in written.lower()[0].replace("1", "i")), written
    for written in ("http://1d10t.com/x", "www.1d10t.org", "me@1d10t.com", "x=1d10t"):
        assert "idiot" not in d.restore(written), written
    for written in ("2024-01-02", "+49-30-1234", "3rd", "5kg", "1,000.5"):
        assert set(d.restore(written)) <= {"rd", "kg"}, written


def best_reading(d, word):
    """The best path's score over all readings, tried one by one."""
    best = {}

    def go(i, a, b, last, score, read):
        if i == len(word):
            score += d.model[a][b][0]
            if not best or score > best["score"]:
                best.update(score=score, text=read)
            return
        c = word[i]
        for x, p in d.readings(c):
            k = d.state(x)
            go(i + 1, b, k, x, score + p + d.model[a][b][k], read + x)
        drop = d.dropped(c, word[i - 1] if i else "", last)
        if drop is not None:
            go(i + 1, a, b, last, score + drop, read)

    go(0, 0, 0, "", 0.0, "")
    return best["score"], best["text"]


def test_viterbi_finds_the_best_of_all_readings(spark):
    docs = spark.createDataFrame([(1, "idiot moron stupid loser trash the and of that a an is it so")] * 20, DOCS)
    d = toxicity.Decoder(toxicity.language_model(toxicity.trigram_counts(docs)))
    draw = random.Random(2)
    words = ["".join(draw.choice("abdeiostr013$@!. -*rr") for _ in range(draw.randrange(1, 8))) for _ in range(400)]
    for word in [*words, "i d i o t", "st00pid", "tr@ssh", "m.o r-on"]:
        score, text = best_reading(d, word)
        got = d.decode(word)
        assert got == text or abs(reading_score(d, word, got) - score) < 1e-9, word


def reading_score(d, word, want):
    """The best score of the readings that give ``want``."""
    best = [float("-inf")]

    def go(i, at, a, b, last, score):
        if i == len(word):
            if at == len(want):
                best[0] = max(best[0], score + d.model[a][b][0])
            return
        c = word[i]
        for x, p in d.readings(c):
            if want[at : at + 1] == x:
                k = d.state(x)
                go(i + 1, at + 1, b, k, x, score + p + d.model[a][b][k])
        drop = d.dropped(c, word[i - 1] if i else "", last)
        if drop is not None:
            go(i + 1, at, a, b, last, score + drop)

    go(0, 0, 0, 0, "", 0.0)
    return best[0]


def test_very_long_words_are_restored_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "the idiot and the moron of that")] * 5, DOCS)
    d = toxicity.Decoder(toxicity.language_model(toxicity.trigram_counts(docs)))
    for text, most in (("a'" * 500_000, 20), ("a1b2" * 20_000, 60), ("a " * 100_000, 60), ("x" * 1_000_000, 60)):
        began = time.perf_counter()
        assert d.restore(text)
        assert time.perf_counter() - began < most


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graphs_find_the_links_of_large_shards(spark):
    """Three shards of over 2,000 vectors, planted links at cosines from 0.90 to 0.99, one hot group; the graph is asked, not all vectors."""
    rng = np.random.default_rng(8)
    base = unit(rng.normal(size=(6000, 48)))
    away = rng.normal(size=(600, 48))
    away = unit(away - (away * base[:600]).sum(1, keepdims=True) * base[:600])
    cos = np.linspace(0.9005, 0.99, 600)[:, None]
    hot = unit(base[5999] + 0.02 * rng.normal(size=(150, 48)))
    vectors = np.concatenate([base, cos * base[:600] + np.sqrt(1 - cos * cos) * away, hot])
    graph = hnsw.Graph(vectors[:2500]).build()
    width, whole, recall = hnsw.widened(graph, vectors[:2500], vectors[2500:], 0.9, False)
    assert not whole and recall >= 0.99 and 4 * width < 2500
    sims = unit(vectors) @ unit(vectors).T >= 0.9
    np.fill_diagonal(sims, False)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    got = {r.vec_id: r for r in hnsw.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least_shards=3).collect()}
    found = sum(r.n_links for r in got.values())
    print(f"{found} of {sims.sum()} links, beam {width}, audit {recall:.3f}")
    assert 0.99 * sims.sum() <= found <= sims.sum()
    comp = brute_components(range(len(rows)), [tuple(p) for p in np.argwhere(sims) if p[0] < p[1]])
    assert sum(got[k].component_id == comp[k] for k in comp) >= 0.99 * len(comp)


def test_outgrown_buckets_are_split_without_losing_a_pair(spark, monkeypatch):
    """One bucket with most rows, far above a task's share, between small ones: all likely pairs, or a forest of them."""
    from tallyspark.llm import bands

    monkeypatch.setattr(bands, "HOT_SHARE", bands.TASK_ROWS // 16)
    monkeypatch.setattr(bands, "HOLD", 100)
    rng = np.random.default_rng(3)
    sizes = rng.integers(8, 40, 300)
    base = rng.integers(0, 1 << 62, 40)
    sketch = base[rng.integers(0, 40, 300)] ^ (1 << rng.integers(0, 60, 300)) ^ (1 << rng.integers(0, 60, 300))
    buckets = [[7 << 20] + ([int(rng.integers(1, 30)) << 22] if k % 3 == 0 else []) for k in range(300)]
    rows = [((b << bands.SIZE_BITS) | int(sizes[k]), k, int(sketch[k]), k % 5) for k in range(300) for b in buckets[k]]
    table = spark.createDataFrame(rows * 2 + rows[:50], "key long, rep long, w0 long, g long").repartition(7)

    def near(short, long, a, b):
        bits = np.bitwise_count(a[0] ^ b[0]).astype(np.int64)
        return np.where(bits <= 4, bits, -1)

    def alike(i, j):
        return set(buckets[i]) & set(buckets[j]) and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) - 1e-6 and int(sketch[i] ^ sketch[j]).bit_count() <= 4

    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if alike(i, j)}
    assert len(want) > 300
    for budget in (None, lambda size: 4):
        how = {"near": near, "least": 0.8, "sketches": 1, "budget": budget}
        forest = {tuple(r) for r in bands.bucket_links(table, len(rows), **how).collect()}
        assert forest <= want and brute_components(range(300), forest) == brute_components(range(300), want)
        monkeypatch.setattr(bands, "LARGE", 4)
        all_pairs = {tuple(r) for r in bands.bucket_links(table, len(rows), grouped=True, **how).collect()}
        assert all_pairs == {(i, j) for i, j in want if i % 5 != j % 5}


def test_line_dedup_is_the_same_with_split_buckets(spark, monkeypatch):
    from tallyspark.llm import bands

    rng = random.Random(9)
    texts = [" ".join(["alpha", "beta", "gamma", *(rng.choice("red blue green grey pink".split()) + str(0 * rng.randrange(4)) for _ in range(rng.randrange(2, 30)))]) for _ in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], DOCS)
    whole = sorted(map(tuple, lines.dedup_lines(docs, counts=True).collect()))
    monkeypatch.setattr(bands, "HOT_SHARE", bands.TASK_ROWS // 32)
    monkeypatch.setattr(bands, "HOLD", 500)
    assert sorted(map(tuple, lines.dedup_lines(docs, counts=True).collect())) == whole
    assert sum(n for *_, n in whole) > 20


def test_long_words_are_decoded_as_a_whole(spark):
    docs = spark.createDataFrame([(1, " ".join(["idiot moron pathetic worthless stupid disgusting loser trash the and of that"] * 50))], DOCS)
    d = toxicity.Decoder(toxicity.language_model(toxicity.trigram_counts(docs)))
    for front in (40, 249, 250, 252, 253, 254, 255, 256, 300):
        word = "".join("abcdefgh"[k % 8] for k in range(front)) + "1d10t5" + "".join("mnop"[k % 4] for k in range(40))
        assert d.decode(word) == best_reading(d, word)[1], front
    assert d.decode("x" + "1" * 5000) and "stupid" in d.restore("." * 3000 + "st.up1d")

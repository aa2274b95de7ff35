"""Operators 11 to 13 against the library, and against brute force in plain Python."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import balls, bytebpe, fim


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.vocabulary_path()), special_tokens={})


def same(library, text: str) -> bool:
    own = bytebpe.byte_bpe(bytebpe.vocabulary_path())
    raw = own.encode(text)
    return np.frombuffer(raw, "<u4").tolist() == library.encode_ordinary(text) and own.decode(raw) == text.encode()


def test_ids_are_the_librarys(library):
    own = bytebpe.byte_bpe(bytebpe.vocabulary_path())
    rng = random.Random(1)
    pools = ["abcdefghij '", "aeiouAEIOU'sdlre ", "0123456789 ,.", " \t\n\r\x0b\x85\xa0 ", "äöüßéñçøłž", "日本語中文字漢かな", "🙂🚀👩‍👧", "࢏౜՘\U0003fc3d\U00016ff4ab 12", "\x00\x01\x7f<|endoftext|>"]
    for _ in range(4000):
        some = rng.sample(pools, rng.randint(1, 3))
        text = "".join(rng.choice(rng.choice(some)) for _ in range(rng.randint(0, 60)))
        assert same(library, text), ascii(text)
    for text in ("", "a" * 50_000, "ab" * 20_000, "é" * 9_999, " " * 5_000, "\n" * 777 + "x", "€uro '" * 50):
        assert same(library, text)
    assert own.decode(b"\1\0\0") is None and own.decode(b"\xff\xff\xff\xff") is None and own.decode(b"") == b""


def test_every_token_decodes_to_its_bytes(library):
    own = bytebpe.byte_bpe(bytebpe.vocabulary_path())
    assert [own.tokens[r] for r in range(library.n_vocab)] == [library.decode_single_token_bytes(r) for r in range(library.n_vocab)]


def test_a_token_that_no_merges_build(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 258}  # rank 257 has no token, xyz no part of two letters
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = bytebpe.ByteBpe(str(tmp_path / "r"))
    assert own.ids("xyz") == [258] and own.ids("wxyz") == [*b"wxyz"] and own.ids("abab") == [256, 256]
    assert own.decode(np.array([257], "<u4").tobytes()) is None and own.decode(np.array([258, 256], "<u4").tobytes()) == b"xyzab"


def test_byte_bpe_rows(spark, sf, library, monkeypatch):
    from tallyspark.llm.queries import QUERIES

    rows = [(1, "Hello world", 7, "t"), (2, None, 7, "t"), (2, "", 7, "t"), (None, "é퟿ 12", 7, "t"), (1, "Hello world", 8, "t"), (3, "word " * 60_000, 1, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = bytebpe.decoded(bytebpe.encoded(docs)).collect()
    want = sorted((str(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert bytebpe.decoded(bytebpe.encoded(docs.limit(0))).collect() == []
    assert [r.decoded for r in bytebpe.decoded(spark.createDataFrame([(None,), (b"\1",)], "ids binary")).collect()] == [None, None]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op11_byte_bpe"](spark, sf).collect():
        ids = np.array(library.encode_ordinary(texts.pop(r.doc_id)), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()) and r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids.tolist())).hexdigest()
    assert not texts


def test_elias_fano_lists():
    rng = random.Random(2)
    cases = [[1], [9], list(range(1, 300)), [1_000_000], [3, 4, 100_000]] + [sorted(rng.sample(range(1, top), min(n, top - 1))) for top in (50, 5_000, 300_000) for n in (1, 7, 40, 2_000)]
    for ends in cases:
        raw = fim.elias_fano(np.array(ends))
        list_ = fim.Boundaries(raw)
        assert [list_[k] for k in range(len(ends) + 1)] == [0, *ends]
        n, u = len(ends), ends[-1]
        assert 8 * (len(raw) - 9) <= n * (2 + max(np.log2(u / n), 0)) + n + 16
    assert fim.Boundaries(fim.elias_fano(fim.unit_ends("")))[0] == 0


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return str(doc_id), len(units), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return str(doc_id), len(units), form, len(p), len(m), out


@pytest.mark.parametrize("copies", [3, fim.COPIES])
def test_fill_in_middle_rows(spark, copies):
    texts = ["", None, "a", "one two\nthree", "é 日本語 🙂 x9", "has <P> a mark", "ends <", "<S", "P> begins <<", "w" * 5_000, "ab, " * 30_000]
    rows = [(i, texts[i % len(texts)], "x", i) for i in range(220)] + [(7, "one two\nthree", "x", 0)] * 5 + [(None, "a b c", "y", 1)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n int").repartition(5)
    got = fim.fill_in_middle(docs, copies=copies)
    back = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    made = [(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back]
    want = [cut_by_hand(i, t) for i, t, *_ in rows]
    key = lambda r: (r[0], r[5])
    assert sorted(made, key=key) == sorted(want, key=key)
    assert {r[2] for r in made} == {"plain", "psm", "spm"}
    whole = sorted((str(i), t or "") for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.back) for r in back) == whole
    index = fim.distinct_texts(docs, copies=copies).collect()
    assert max(len(r.ids) for r in index) <= max(4 * copies, 12) and {r.text for r in index} == {t or "" for t in texts} | {"a b c"}
    if copies == fim.COPIES:
        assert len(index) == len({r.text for r in index})  # each text's list is made once
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def clusters_by_hand(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(np.float64(1024) * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seeded = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in seeded[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[int(Fraction(sum(x), len(g)).__floor__()) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted((str(i), c, d, sum(e for _, e, b in found if b == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found)


def vectors(n, seed, spread=0.02, middles=5):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(middles, 64))
    return [(i, [float(np.float32(x)) for x in at[i % middles] + spread * rng.normal(size=64)]) for i in range(n)]


@pytest.mark.parametrize("size", [7, 100, balls.TREE])
def test_ball_clusters(spark, size):
    some = vectors(300, 3)
    one = some[0][1]
    odd = [(900, None), (901, []), (902, one[:63]), (903, [*one, 1.0]), (904, [None, *one[1:]]), (905, [float("nan"), *one[1:]]), (906, [float("inf"), *one[1:]])]
    rows = some + odd + [(5, one)] * 90 + [(None, some[1][1])] * 3 + [(77, [0.0] * 64), (78, [-0.0] * 64)]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int").repartition(3)
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in balls.ball_clusters(table, size=size).collect())
    assert got == clusters_by_hand(rows)


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], vectors(3, 4), [(i, [0.5] * 64) for i in range(200)], [(i, [0.25 if i % 2 else -0.25, *[0.0] * 63]) for i in range(150)]):
        got = balls.ball_clusters(spark.createDataFrame(rows, schema))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((str(r.vec_id), *r[1:]) for r in got.collect()) == clusters_by_hand(rows)
    with pytest.raises(Exception, match="would not fit a long"):
        balls.ball_clusters(spark.createDataFrame([(1, [1e30, *[0.0] * 63])], schema)).collect()


def test_balls_are_assigned_whole():
    points = np.array([[np.floor(1024 * x) for x in v] for _, v in vectors(4096, 5)]).astype(np.int64)
    order, sums, counts, centres, radii, starts, left, right = balls.ball_tree(points)
    points = points[order]
    assert sorted(order.tolist()) == list(range(4096)) and counts[0] == 4096 and (sums[0] == points.sum(axis=0)).all()
    for k in range(len(counts)):
        own = points[starts[k] : starts[k] + counts[k]]
        assert (own.sum(axis=0) == sums[k]).all() and (np.sqrt(((own - centres[k]) ** 2).sum(axis=1)) <= radii[k]).all()
    tree = {"points": points, "sums": sums, "counts": counts, "centres": centres, "radii": radii, "starts": starts, "left": left, "right": right}
    middles = points[[int(np.flatnonzero(order == i)[0]) for i in range(5)]]
    alone, whole = 0, 0
    for c, nodes, rows in balls.filtered(tree, middles):
        nearest = ((points[:, None] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
        own = np.concatenate([rows, *(starts[k] + np.arange(counts[k]) for k in nodes)])
        assert sorted(own.tolist()) == np.flatnonzero(nearest == c).tolist()
        alone, whole = alone + len(rows), whole + counts[nodes].sum()
    assert whole > 20 * max(alone, 1)


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_ball_clusters"])
def test_against_sql(spark, sf, name):
    import duckdb

    from tallyspark.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))

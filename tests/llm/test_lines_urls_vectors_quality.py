import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest

from tallyspark.llm import hnsw, lines, measures, qda, quality, queries, toxicity, urls

from .test_tokens_packing_mixing_simhash import ODD, SCHEMA, brute_components


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert lines.edit_distance(a, b) == levenshtein(a, b)


def brute_lines(rows):
    """Kept lines by the edit similarity of all pairs of distinct normal lines, without any filter before it."""
    seen, at = {}, {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(lines.normal_words(line))
            if i is not None and len(w) >= lines.MIN_WORDS:
                seen[w] = min(seen.get(w, (i, k)), (i, k))
                at[i, k] = w
    kinds = list(seen)
    near = [(i, j) for i in range(len(kinds)) for j in range(i) if lines.similar(list(kinds[i]), list(kinds[j]), 0.8)]
    group = brute_components(range(len(kinds)), near)
    first = {}
    for k, w in enumerate(kinds):
        first[group[k]] = min(first.get(group[k], seen[w]), seen[w])
    index = {w: k for k, w in enumerate(kinds)}
    gone = {p for p, w in at.items() if first[group[index[w]]] != p}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows if t is not None and i is not None}


def test_line_dedup_matches_brute_force(spark, docs, odd):
    base = [f"alpha beta gamma delta epsilon number {k} " + " ".join(f"w{j}" for j in range(120)) for k in range(3)]
    near = [b.replace("w60 ", "changed ", 1) for b in base]
    extra = [(1000 + k, t + "\nshort line\nUnique words stand in this line %d times" % k, "en", "s", 0, None, None, None) for k, t in enumerate([*base, *near, base[0].upper()])]
    both = odd.unionByName(spark.createDataFrame(extra, SCHEMA))
    words = [f"v{j}" for j in range(200)]
    torn = [(2000 + k, " ".join(w), "en", "s", 0, None, None, None) for k, w in enumerate([words, words[::-1], words[:60] + words[61:] + words[60:61], words[::-1][:-1] + ["v199"]])]
    both = both.unionByName(spark.createDataFrame(torn, SCHEMA))
    for table in (docs, both):
        rows = [(r[0], r[1]) for r in table.select("doc_id", "text").collect()]
        out = lines.dedup_lines(table)
        assert out.columns == table.columns and out.count() == len(rows)
        got = {r.doc_id: r.text for r in out.collect() if r.text is not None and r.doc_id is not None}
        want = brute_lines(rows)
        assert {i: got[i] for i in want} == want
    counts = {r.doc_id: r for r in lines.dedup_lines(both, counts=True).collect()}
    assert counts[1].n_removed == 0 and counts[8].n_removed == 1 and counts[8].text == "" and counts[3].text is None
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fit = [r for r in rules if not r.pattern and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = min(fit, key=lambda r: (-len(r.name), r.verdict, r.name))
        return host, path, best.name, best.verdict
    bad = [r for r in rules if r.pattern and re.search(r.pattern, f"{host}\n{path}")]
    return host, path, None, min(bad, key=lambda r: (-len(r.name), r.verdict, r.name)).verdict if bad else "allow"


def test_urls(spark, sf):
    cases = [None, "", "no scheme", "http://EXAMPLE.com/en/71?x#y", "https://m.example.com/en/8", "x://example.net#/de/", "x://example.net/de/8/../", "ftp://a.b.org/es/", "a://b://c/d", "http://notcom/en/", "http://com/en/", "http://Éx.COM/en/?q=://", "http://s.io/casino/x", "http://s.io/Casino", "http://casino.com/en/7", "http://s.io/a\nb/xxx", "http://s.io?xxx", "http://a\nb.com/en/x", "http://a\n.example.com/en/7", "http://\n/de/", "http://x.net/\n/de/", "http://s.io/PoKer", "http://s.io/pokers"]
    table = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(cases)] + [(1, "http://com/en/", None, None), (None, None, None, None)], "page_id long, url string, host string, rule string")
    got = {}
    for r in urls.judge(table).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    for k, u in enumerate(cases):
        assert plain_judge(u, urls.HOST_RULES + urls.PATTERN_RULES) in got[k], u
    assert len(got[1]) == 2 and got[None] == [("", "", None, "allow")]
    more = urls.HOST_RULES + (urls.Rule("block", pattern=r"/\d{6,}"), urls.Rule("allow", "", "/x"), urls.Rule("block", "io", ""))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(table.where("page_id <> 1"), more).collect()}
    assert all(got[k] == plain_judge(u, more) for k, u in enumerate(cases) if k != 1)
    assert urls.judge(table.limit(0)).count() == 0
    plan = queries.QUERIES["op2_url_filters"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_hundred_thousand_rules(spark, sf):
    """A long list comes as a table; the verdicts are those of a look-up of every parent domain."""
    rules = tuple(urls.Rule("block", f"site{k}.com") for k in range(100_000)) + urls.HOST_RULES
    pages = spark.createDataFrame([(k, f"http://www.site{k * 37}.com/a/{k}") for k in range(5000)] + [(9000, "http://m.example.com/en/9")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()}
    want = {k: ("block", f"site{k * 37}.com") if k * 37 < 100_000 else ("allow", None) for k in range(5000)} | {9000: ("block", "com/en/")}
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.select(", ".join(cols)).fetchall()))


def brute_links(vecs):
    good = {}
    for i, v in vecs:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    linked = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    n = {i: 0 for i, _ in vecs}
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    comp = brute_components([i for i, _ in vecs], linked)
    return {i: (n[i], comp[i], comp[i] == i) for i, _ in vecs}


def test_embeddings_match_brute_force(spark, sf):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    near = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.05, 0.1, 0.2, 0.3)] + [base[:5]] * 3)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(near)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] + [1.0] * 7), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (907, [float("inf")] + [1.0] * 7)]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, node int, copies int, n long")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.embedding_components(table, shard_rows=16).collect()}
    assert got == brute_links(exact)
    assert hnsw.embedding_components(table.limit(0)).count() == 0
    nameless = table.where("vec_id < 2").selectExpr("if(vec_id = 0, null, vec_id) vec_id", "embedding").unionByName(table.where("vec_id = 0").select("vec_id", "embedding"))
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.embedding_components(nameless).collect()} == {(None, 1, 0, False), (0, 1, 0, True), (1, 0, 1, True)}


def test_embedding_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    want = brute_links([(r[0], list(r[1])) for r in table.collect()])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.embedding_components(table).collect()}
    true, found = sum(v[0] for v in want.values()), sum(v[0] for v in got.values())
    assert found <= true and found >= 0.95 * true
    assert all(got[i][0] <= want[i][0] for i in want)


def test_repeat_words():
    rng = random.Random(9)
    for _ in range(200):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 25))]
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert measures.repeat_words(w) == len({i + d for i, x in enumerate(win) if win.count(x) > 1 for d in range(3)})


def test_quality_ledger(spark, docs, odd):
    rows = quality.ledger(docs).cache()
    for policy, m in quality.POLICIES.items():
        fails = [r.failures & m for r in rows.collect()]
        for r in quality.ablation(rows, policy).collect():
            b = quality.BITS[r.rule]
            assert (r.fails, r.only, r.kept_without) == (sum(bool(f & b) for f in fails), fails.count(b), sum(not f & ~b for f in fails))
    good = quality.keep_good(docs)
    want = {r.doc_id for r in rows.where(~quality.rejected("v1")).collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want
    assert good.join(docs.select("doc_id", docs["text"].alias("was")), "doc_id").where("text <> was").count() == 0
    found = {r.doc_id: r for r in quality.ledger(odd).collect()}
    assert found[3].n_words == 0 and found[3].failures & quality.mask("few_words")
    assert found[6].n_words == 30000 and found[6].n_repeat_words == 30000
    assert quality.keep_good(odd).columns == odd.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.ledger(empty).count() == quality.keep_good(empty).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.keep_good(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 600")).select("doc_id")
    clean = labels.where("quality = 1").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 600"), "doc_id")
    assert clean.join(kept, "doc_id").count() >= 0.98 * clean.count()


def held_out(spark, sf, score, label):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels)
    assert rows.count() == docs.count() and rows.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.5)").count() == 0
    return [(r.score, r[label]) for r in rows.where("held_out").join(labels, "doc_id").collect()]


def test_quality_classifier(spark, odd):
    pairs = held_out(spark, "/root/testdata/sf0.01", qda.score_quality, "quality")
    assert np.mean([(s >= 0.5) == y for s, y in pairs]) >= 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for f in (qda.score_quality, toxicity.score_toxicity):
            rows = f(odd, labels).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
            assert f(odd.limit(0), labels).count() == 0


def test_toxicity(spark):
    pairs = held_out(spark, "/root/testdata/sf0.01", toxicity.score_toxicity, "toxic")
    assert np.mean([(s >= 0.5) == y for s, y in pairs]) >= 0.93


def test_toxic_texts_are_found_and_others_left_alone(spark):
    pairs = held_out(spark, "/root/testdata/sf0.1", toxicity.score_toxicity, "toxic")
    toxic, others = [s >= 0.5 for s, y in pairs if y], [s >= 0.5 for s, y in pairs if not y]
    assert np.mean(toxic) >= 0.85 and np.mean(others) <= 0.01


def test_decoder_restores_words(spark):
    docs = spark.createDataFrame([(1, " ".join(["idiot moron pathetic worthless stupid disgusting loser trash the and of that"] * 50))], "doc_id long, text string")
    d = toxicity.Decoder(toxicity.language_model(toxicity.trigram_counts(docs)))
    assert [d.decode(w) for w in ("1d10t", "m0r0n", "p@th3t1c", "st-u-p.i.d", "looooser", "tr4sh")] == ["idiot", "moron", "pathetic", "stupid", "loser", "trash"]
    assert "idiot" in d.restore("an i d i o t here") and "stupid" in d.restore("so s.t.u.p.i.d!")

import corpus_pipeline as P
import pytest

from tallyspark.llm import measures

from .test_lines_urls_vectors_quality import brute_lines
from .test_tokens_packing_mixing_simhash import ODD, SCHEMA, brute_components, brute_targets, packed


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def kept(text):
    v = dict(zip(measures.FIELDS, measures.measure(text)))
    fails = [v["n_words"] < 50, 100 * v["n_repeat_words"] > 50 * v["n_words"], 10 * v["n_symbols"] > 3 * v["n_words"], 2 * v["n_dup_lines"] > v["n_lines"], v["word_chars"] > 20 * v["n_words"], v["word_chars"] < 2 * v["n_words"], 2 * v["n_upper"] > v["word_chars"], 2 * v["n_bangs"] > v["n_words"]]
    return not any(fails)


def test_stages_match_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    seen = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or seen[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text, r.source) for r in d.select("doc_id", "text", "source").collect()] for d in seen[:5]]
    assert sorted(rows[1]) == sorted(r for r in rows[0] if kept(r[1]))
    want = brute_lines([(i, t) for i, t, _ in rows[1]])
    assert {i: t for i, t, _ in rows[2]} == want and len(rows[2]) == len(rows[1])
    sets = {i: shingles(t) for i, t, _ in rows[2]}
    ids = sorted(sets)
    groups = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert sorted(i for i, _, _ in rows[3]) == sorted(set(groups.values()))
    size = lambda t: len((t or "").encode().split())
    per, taken = {}, {}
    for _, t, s in rows[3]:
        per[s] = per.get(s, 0) + size(t)
    for _, t, s in rows[4]:
        taken[s] = taken.get(s, 0) + size(t)
    for s, target in brute_targets(per).items():
        assert abs(taken.get(s, 0) - target) <= 1
    assert seen[4].where("n_chars <> char_length(text)").count() == 0
    used, least = packed(seen[5].collect(), [(i, t) for i, t, _ in rows[4]])
    assert used <= 1.02 * least + 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, P.run(spark, sf).select(*cols).collect())) == sorted(map(tuple, seen[5].select(*cols).collect()))


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in P.STAGES:
        assert stage(spark, docs, "").count() >= 0, name

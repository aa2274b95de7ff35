from collections import Counter

from tallyspark.llm import mixing

from .test_tokens_packing_mixing_simhash import brute_targets


def test_documents_of_repeated_ids_null_keys_and_clashing_columns(spark):
    """Every source's words come near its target, whole texts stay as they are, columns of any name come back."""
    rows = []
    for k in range(600):
        text = "\t".join(f"w{k}x{j}" for j in range(1 + k * 7 % 23)) if k % 11 else ("" if k % 2 else None)
        rows.append((k % 500 if k % 13 else None, text, [None, "a", "b", "c"][k % 4], "r", k, 1.5, "x", "e"))
    rows += rows[:40]
    names = "doc_id long, text string, source string, round string, ends int, t double, `row` string, skey string"
    docs = spark.createDataFrame(rows, names)
    got = mixing.mix_documents(docs, block_words=8)
    assert got.columns == docs.columns
    size = lambda t: len((t or "").split())
    per, taken = Counter(), Counter()
    for r in rows:
        per[r[2]] += size(r[1])
    whole = Counter((r[0], r[1], r[2]) for r in rows)
    cut = 0
    for r in got.collect():
        taken[r.source] += size(r.text)
        assert (r["round"], r.t, r.row, r.skey) == ("r", 1.5, "x", "e") and r.text
        cut += (r.doc_id, r.text, r.source) not in whole
    for s, target in brute_targets(per).items():
        assert taken[s] == int(target)
    assert cut <= 2 * len(per)
    again = mixing.mix_documents(docs.repartition(5), block_words=8)
    assert Counter(map(str, got.collect())) == Counter(map(str, again.collect()))
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def test_documents_agree_with_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.taken for r in mixing.mix_counts(docs).collect() if r.taken}
    got = Counter()
    for r in mixing.mix_documents(docs).select("doc_id", "text").collect():
        got[r.doc_id] += len(r.text.split())
    assert got == want

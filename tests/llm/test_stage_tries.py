"""The pipeline's near-copy stage: the tries link by themselves what differs in two bits or fewer."""

import random

from tallyspark.llm import simhash as S


def test_the_stage_links_by_its_tries(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "banded_groups", lambda *a, **k: spark.createDataFrame([], "node long, component long"))
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(9000)}" for _ in range(3000)) for _ in range(3)]
    near = next(t for k in range(200) for w in [texts[0].split()] for t in [" ".join([*w[:k], "other", *w[k + 1 :]])] if 0 < (S.fingerprint(t, 5) ^ S.fingerprint(texts[0], 5)).bit_count() <= 2)
    docs = spark.createDataFrame(list(enumerate([*texts, near, ""])), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [0, 1, 2, 4]

"""Embedding near-duplicates: every vector asks one graph once, and what shares a router meets."""

import numpy as np

from tallyspark.llm import hnsw


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_vector_asks_once_however_many_blocks_there_are(spark, monkeypatch):
    """Links at exactly the threshold or just above and below it, a dense group over many blocks, scaled copies."""
    rng = np.random.default_rng(12)
    base = unit(rng.normal(size=(3000, 64)))
    away = rng.normal(size=(300, 64))
    away = unit(away - (away * base[:300]).sum(1, keepdims=True) * base[:300])
    cos = np.where(np.arange(300) % 2, 0.9 + 1e-9, 0.9 - 1e-9)[:, None]
    hot = unit(base[2999] + 0.02 * rng.normal(size=(400, 64)))
    vectors = np.concatenate([base, cos * base[:300] + np.sqrt(1 - cos * cos) * away, hot, 3 * base[300:320]])
    written, write = [], hnsw.cut
    monkeypatch.setattr(hnsw, "cut", lambda df: written.append(write(df)) or written[-1])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in hnsw.embedding_components(table, shard_rows=100).collect()}
    asked = [df for df in written if "cells" in df.columns]
    assert [df.count() for df in asked] == [len(vectors)]
    sims = unit(vectors) @ unit(vectors).T >= 0.9
    np.fill_diagonal(sims, False)
    found = np.array([got[k].n_links for k in range(len(vectors))])
    assert (found <= sims.sum(1)).all() and found.sum() >= 0.999 * sims.sum()
    assert (found == sims.sum(1))[3000:3300].mean() >= 0.99 and (found == sims.sum(1))[3300:].all()
    assert len({got[k].component_id for k in range(3300, 3700)}) == 1


def test_a_dense_group_keeps_one_router():
    rng = np.random.default_rng(5)
    v = unit(np.concatenate([rng.normal(size=(300, 32)), rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(500, 32))])).astype(np.float32)
    kept = hnsw.thinned(v, 0.9)
    assert len(kept) == 301 and (np.tril(kept @ kept.T, -1) < 0.9).all()
    assert hnsw.needed(np.array([[5, 3, 1], [1, 2, -1]]), np.array([[1, 3, 8], [4, 5, -1]])).tolist() == [2, 1 << 30]

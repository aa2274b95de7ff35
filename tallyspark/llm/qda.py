"""Operator 7: text quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .measures import FIELDS, measure

#: Share of a class's covariance that is drawn to the pooled one, and of that to its mean variance.
TO_POOLED, TO_ROUND = 0.1, 0.02
STATISTICS = ("log_words", "word_length", "symbols", "repeats", "duplicate_lines", "upper", "digits", "bangs", "distinct")


def statistics(m: tuple[int, ...]) -> tuple[float, ...]:
    """Transformed statistics of a text's measurements; rates are drawn out by square roots. An empty text is all zero."""
    v = dict(zip(FIELDS, m, strict=True))
    n = v["n_words"]
    if not n:
        return (0.0,) * len(STATISTICS)
    chars = max(v["word_chars"], 1)
    return (
        math.log1p(n), math.log(chars / n), math.sqrt(v["n_symbols"] / n), math.sqrt(v["n_repeat_words"] / n), math.sqrt(v["n_dup_lines"] / max(v["n_lines"], 1)),
        math.sqrt(v["n_upper"] / chars), math.sqrt(v["n_digits"] / chars), math.sqrt(v["n_bangs"] / n), math.log(v["n_distinct"]) / math.log1p(n),
    )


class Discriminant:
    """Two Gaussians with shrunk covariances; their Cholesky factors and log-determinants are kept."""

    def __init__(self, counts, sums, squares):
        import numpy as np

        n = np.maximum(counts, 1).astype(float)
        self.means = sums / n[:, None]
        own = squares / n[:, None, None] - self.means[:, :, None] * self.means[:, None, :]
        pooled = (own * n[:, None, None]).sum(0) / n.sum()
        size = pooled.shape[0]
        shrunk = (1 - TO_POOLED) * own + TO_POOLED * pooled
        round_ = np.trace(shrunk, axis1=1, axis2=2) / size
        shrunk = (1 - TO_ROUND) * shrunk + TO_ROUND * round_[:, None, None] * np.eye(size) + 1e-9 * np.eye(size)
        self.factors = np.linalg.cholesky(shrunk)
        self.inverse = np.linalg.inv(self.factors)
        self.log_dets = 2 * np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(1)
        self.log_priors = np.log((counts + 1) / (counts.sum() + 2))

    def scores(self, x):
        """Probability of class 1: the logistic of the log-density difference plus log priors."""
        import numpy as np

        log = [p - 0.5 * (d + (((x - m) @ f.T) ** 2).sum(1)) for m, f, d, p in zip(self.means, self.inverse, self.log_dets, self.log_priors, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    Statistics of every text are taken once and written. Counts, sums and products of the labelled rows outside
    the held-out fold are added up in the tasks, so the fit uses all of them and a few numbers reach the driver.

    Null and empty texts have zero statistics. Null labels are not learned from; if an id has several labels the
    smallest counts. Rows with a null id are scored and not held out. A class without labels is taken to lie as
    the other one, so scores are the share of its labels; without any label scores are 0.5. Only text is an input.
    """
    import numpy as np
    import pyarrow as pa

    names = [f"s{k}" for k in range(len(STATISTICS))]
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(folds)) == held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(statistics(measure(t)) for t in b.column(1).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in cols)], names=["id", *names])

    stats = cut(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names)))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    rows = stats.join(known.where(~fold("__id")), F.col("id") == F.col("__id"))
    size = len(names)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.groupBy("y").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in names), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    counts, first, second = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
    for r in sums:
        if r["y"] in (0, 1):
            counts[r["y"]], first[r["y"]] = r["n"], [r[n] for n in names]
            for i, j in pairs:
                second[r["y"], i, j] = second[r["y"], j, i] = r[f"p{i}_{j}"]
    for k in (0, 1):
        if not counts[k] and counts[1 - k]:
            first[k], second[k] = first[1 - k] / counts[1 - k], second[1 - k] / counts[1 - k]
    model = Discriminant(counts, first, second)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(k + 1).to_numpy() for k in range(size)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["id", "score"])

    out = stats.mapInArrow(score, "id long, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Operator 6: toxicity of texts whose obfuscated words a noisy-channel decoder restores first."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Labelled rows that the lexicon and the calibration are fit on, those with the smallest hash of their id.
TRAIN_ROWS = 16_000
#: A feature enters the lexicon if so many toxic training texts hold it and it is so much likelier in them.
LEAST_TOXIC, LEAST_ODDS = 4, 3.0
#: The sum of a text's evidence counts in full while it is small and never for more than this.
SATURATION = 60.0

#: Channel: what a written character may stand for besides itself, with the log-probability of writing it so.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiouh"}
NOISE = ".-_*'~^"
LOG_LEET, LOG_DROP, LOG_REPEAT, LOG_BREAK = math.log(0.2), math.log(0.15), math.log(0.3), math.log(0.8)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Classes of the character model: 0 word edge, 1 to 26 letters, 27 any other letter.
CLASSES = 28
LUT = bytes((c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 if c >= 0xC0 else 0) for c in range(256))

#: Within a word cut free of punctuation: letters, and padding, digits or signs beside them.
LETTER, SIGN = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|+(*#.\-_~^]")
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~^"
#: Three or more single characters that stand apart.
GAPS = " .-_"
SPACED = re.compile(r"(?<![^\W_])(?:[a-zA-Z0-9@$!|*][ .\-_]{1,3}){2,}[a-zA-Z0-9@$|*](?![^\W_])")
GAP = re.compile(r"[ .\-_]+")
#: Punctuation at the edges of a word that stands for no letter, and signs there that may.
PUNCTUATION, SIGNS = ".,;:?\"')[]{}<>%&-_~^", "$!|*#("
#: Left as written: addresses, assignments, and numbers with or without a unit.
ADDRESS = re.compile(r"://|=|^www\.|\.(?:com|net|org|edu|gov|mil|info|biz|io)(?:[/:?#]|$)")
NUMBER = re.compile(r"[+(#$]*\d[\d.,:/()\-]*(?:st|nd|rd|th|kg|km|cm|mm|ms|[kmgt]b|am|pm|hz|[smghkx])?")
PLAIN = re.compile(r"[^\W\d_]+")


def trigram_counts(docs: DataFrame, text_col: str = "text") -> "numpy.ndarray":  # noqa: F821
    """Letter trigram counts of all texts; each task adds its own, at most ``CLASSES ** 3`` numbers come together."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c = np.frombuffer(f" {t} ".encode("latin-1", "replace").translate(LUT), dtype=np.uint8)
                    for k in range(0, len(c), 1 << 20):
                        x = c[k : k + (1 << 20) + 2].astype(np.int32)
                        n += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["k", "n"])

    out = np.zeros(CLASSES**3, np.int64)
    for k, n in docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def language_model(counts):
    """``log P(c | a, b)``, trigrams backing off to bigrams and single characters."""
    import numpy as np

    tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    one = (tri.sum((0, 1)) + 1) / (tri.sum() + CLASSES)
    two = tri.sum(0)
    p2 = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    return np.log((tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20))


class Decoder:
    """Viterbi decoding of a written word, or of characters that stand apart, into letters.

    The lattice holds each character's readings: itself, what it stands for in leetspeak, nothing for padding, nothing for
    a repetition, and for a gap nothing or the break between two words. The character model scores the path.
    """

    def __init__(self, model):
        self.model = model.tolist()
        self.short = lru_cache(50_000)(self._decode)

    def decode(self, word: str) -> str:
        return self.short(word) if len(word) <= 64 else self._decode(word)

    @staticmethod
    def readings(c: str) -> list[tuple[str, float]]:
        """Letters that a character may stand for, and a break for a gap."""
        if c.isalpha():
            return [(c, 0.0)]
        letters = [(x, LOG_LEET - math.log(len(LEET[c]))) for x in LEET.get(c, "")]
        return letters + [(" ", LOG_BREAK)] if c in GAPS else letters

    @staticmethod
    def dropped(c: str, before: str, last: str) -> float | None:
        """The cost of reading nothing: padding, what has no reading, or the repetition of a character or letter."""
        if c in NOISE or c in GAPS or not Decoder.readings(c):
            return LOG_DROP
        return LOG_REPEAT if last and c in (before, last) else None

    @staticmethod
    def state(x: str) -> int:
        return 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else 27

    def _decode(self, word: str) -> str:
        lm = self.model
        # last two classes -> best score, and the letters read as a chain from the last one back
        paths: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
        before = ""
        for c in word:
            new: dict[tuple[int, int], tuple] = {}
            readings = [(x, p, self.state(x)) for x, p in self.readings(c)]
            for (a, b), (score, text) in paths.items():
                row = lm[a][b]
                for x, p, k in readings:
                    t = score + p + row[k]
                    if (b, k) not in new or t > new[b, k][0]:
                        new[b, k] = (t, (text, x))
                drop = self.dropped(c, before, text[1] if text else "")
                if drop is not None and ((a, b) not in new or score + drop > new[a, b][0]):
                    new[a, b] = (score + drop, text)
            paths, before = new or paths, c
        text = max(paths.items(), key=lambda kv: kv[1][0] + lm[kv[0][0]][kv[0][1]][0])[1][1]
        read = []
        while text:
            text, x = text
            read.append(x)
        return "".join(reversed(read))

    def restore(self, text: str) -> list[str]:
        """Lower-case words of the restored text: plain words, decoded odd ones, and characters that stand apart, both with
        the breaks that the model reads into their gaps and drawn together."""
        extra = []
        for m in SPACED.finditer(text):
            run = m[0].lower()
            extra += self.decode(run).split()
            extra.append(self.decode(GAP.sub("", run)))
        repeats = REPEATED.search(text) is not None
        for w in text.lower().split():
            if w.isalpha():
                extra.append(w)
                if repeats and REPEATED.search(w):
                    extra.append(self.decode(w))
                continue
            core = w.strip(EDGES)
            wide = w.strip(PUNCTUATION)
            if core.isalpha():
                extra.append(core)
                if wide == core:
                    continue
            else:
                extra += PLAIN.findall(core)
            if ADDRESS.search(core) or NUMBER.fullmatch(core):
                continue
            # signs at either edge may be letters or punctuation
            for x in {core, wide, wide.lstrip(SIGNS).lstrip(EDGES), wide.rstrip(SIGNS).rstrip(EDGES)}:
                if LETTER.search(x) and SIGN.search(x):
                    extra += self.decode(x).split()
        return extra


REPEATED = re.compile(r"([^\W\d_])\1\1")


def features(words: Column) -> Column:
    """Of distinct words of three or more letters themselves and the beginnings of longer ones, which inflected forms share."""
    begins = lambda n: F.transform(F.filter(words, lambda w: F.char_length(w) > n + 1), lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))
    return F.array_distinct(F.concat(words, begins(4), begins(5)))


def evidence(words: Iterable[str], lexicon: dict[str, float]) -> tuple[float, float, float]:
    """The strongest features' weights in the restored words: their sum over distinct words, bent towards ``SATURATION`` so that
    long texts stay comparable, the largest, and how many (as a logarithm)."""
    best: list[float] = []
    get = lexicon.get
    for w in set(words):
        if len(w) > 2:
            x = max(get(w, 0.0), get(f"{w[:4]}-", 0.0) if len(w) > 5 else 0.0, get(f"{w[:5]}-", 0.0) if len(w) > 6 else 0.0)
            if x > 0:
                best.append(x)
    return SATURATION * -math.expm1(-math.fsum(best) / SATURATION), max(best, default=0.0), math.log1p(len(best))


def fit_logistic(x, y, ridge: float = 1e-2, rounds: int = 50):
    """Weights (intercept last) by regularised Newton steps."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = -2.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    1. A character model is counted over all texts.
    2. Of the labels outside the held-out fold at most ``train_rows``, by hash of the id, are joined to their texts; the texts'
       restored words are written once.
    3. Features of these words that enough toxic texts hold and others rarely do are the lexicon. It grows with the texts
       of these rows only, never with the corpus, and no feature that qualifies is left out.
    4. A logistic model of the lexicon's evidence is fit on the same rows, every score comes from it.

    Null and empty texts hold no evidence and get the score of none. Null labels are not learned from; if an id
    has several labels the largest counts. Rows with a null id are scored and not held out. Without any label of
    either kind the score is the share of toxic labels, 0.5 if there is none. Only text is an input of a score.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("t")
    decoder = Decoder(language_model(trigram_counts(docs, text_col)))
    model = decoder.model
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = known.where(fold("__id", folds) != held).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    sample = docs.select(F.col(id_col).cast("long").alias("id"), text).join(F.broadcast(known), F.col("id") == F.col("__id")).select("y", "t")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(np.array(model))
        for b in batches:
            words = [sorted({w for w in d.restore(t or "") if len(w) > 2}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["y", "words"])

    sample = cut(sample.mapInArrow(restored, "y int, words array<string>"))
    totals = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    lexicon: dict[str, float] = {}
    if bad and good:
        found = sample.select("y", F.explode(features(F.col("words"))).alias("f")).groupBy("f").agg(F.count_if(F.col("y") == 1).alias("b"), F.count_if(F.col("y") == 0).alias("g"))
        odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
        lexicon = {r.f: r.odds for r in found.where(F.col("b") >= LEAST_TOXIC).select("f", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).collect()}

    def known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = [evidence(words, lexicon) for words in b.column(1).to_pylist()]
            cols = list(zip(*e, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], names=["key", "a", "b", "c"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(np.array(model))
        for b in batches:
            e = [evidence(d.restore(t or ""), lexicon) for t in b.column(1).to_pylist()]
            cols = list(zip(*e, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in cols)], names=["key", "a", "b", "c"])

    if bad and good:
        rows = np.array([tuple(r) for r in sample.mapInArrow(known_words, "key long, a double, b double, c double").collect()])
        w = fit_logistic(rows[:, 1:] / (10.0, 5.0, 1.0), rows[:, 0])
    else:
        w = np.array([0.0, 0.0, 0.0, math.log((bad + 1) / (good + 1))])
    z = F.col("a") * F.lit(float(w[0]) / 10) + F.col("b") * F.lit(float(w[1]) / 5) + F.col("c") * F.lit(float(w[2])) + F.lit(float(w[3]))
    out = docs.select(F.col(id_col).cast("long"), text).mapInArrow(seen, "key long, a double, b double, c double")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return out.select(F.col("key").alias(id_col), F.coalesce(fold("key", folds) == held, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Operator 5: quality rules as a ledger of failure bits, judged by versioned policies."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .measures import FIELDS, measure

#: Rules in the order of their bits; each is true where a text fails. A rule keeps its bit for good: policies name
#: bits, so a changed rule gets a new one. Null comparisons (an empty text's rates) do not fail.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
    ("exclamations", "2 * n_bangs > n_words"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


#: A policy is the set of rules that reject. Policies are never edited; a new one gets a new version.
POLICIES = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask(*BITS),
}
POLICY = "v1"


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *FIELDS, failures)``: every rule's verdict on every row as one bit, with the measurements behind it.

    Each text is read once and whole. Null text measures zero everywhere. Repeated rows and null ids are
    returned as they stand; other columns are ignored.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(measure, b.column(1).to_pylist()), strict=True)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=[id_col, *FIELDS])

    found = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"{id_col} long, " + ", ".join(f"{f} long" for f in FIELDS))
    return found.withColumn("failures", failure_bits())


def failure_bits(prefix: str = "") -> Column:
    """The bits of the rules that a row of measurements fails; its columns' names may have a prefix."""
    named = {name: re.sub(r"\b(" + "|".join(FIELDS) + r")\b", rf"{prefix}\1", rule) for name, rule in RULES}
    return F.expr(" | ".join(f"CASE WHEN {rule} THEN {BITS[name]}L ELSE 0L END" for name, rule in named.items()))


def rejected(policy: str | int, failures: str = "failures") -> Column:
    """Whether a ledger row fails a rule of the policy (a version's name or a mask)."""
    return F.col(failures).bitwiseAND(F.lit(POLICIES[policy] if isinstance(policy, str) else policy)) != 0


def ablation(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails, and rows kept if it were left out.

    The ledger is first summed by bit pattern (at most 2 ** rules groups); every figure comes from the patterns.
    """
    m = POLICIES[policy]
    patterns = entries.groupBy(F.col("failures").bitwiseAND(F.lit(m)).alias("p")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BITS.items() if b & m)))
    rows = patterns.select("p", "n", rules.alias("r")).select("p", "n", "r.rule", "r.bit")
    sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy("rule").agg(sums(F.expr("p & bit <> 0")).alias("fails"), sums(F.expr("p = bit")).alias("only"), sums(F.expr("p & ~bit = 0")).alias("kept_without"))


def keep_good(docs: DataFrame, policy: str = POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that no rule of the policy rejects, with all their columns, whatever their names.

    Each row gets the ledger's bits of all rules, and the policy's mask decides. The bits travel with the texts, so rows
    need no id: repeated rows are judged one by one. Null and empty texts have few words and go under both policies.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(measure, b.column(0).to_pylist()), strict=True)) or [()] * len(FIELDS)
            arrays = [b.column(0), *b.column(1).flatten(), *(pa.array(c, pa.int64()) for c in cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rest = [c for c in docs.columns if c != text_col]
    names = ["__text", *(f"__r{k}" for k in range(len(rest))), *(f"__m_{f}" for f in FIELDS)]
    kinds = dict(docs.dtypes)
    schema = ", ".join(["__text string", *(f"__r{k} {kinds[c]}" for k, c in enumerate(rest)), *(f"__m_{f} long" for f in FIELDS)])
    found = docs.select(F.col(text_col).cast("string").alias("__text"), F.struct(*(F.col(f"`{c}`").alias(f"__r{k}") for k, c in enumerate(rest))).alias("r")).mapInArrow(run, schema)
    good = found.withColumn("__failures", failure_bits("__m_")).where(~rejected(policy, "__failures"))
    back = {c: F.col(f"__r{k}").alias(c) for k, c in enumerate(rest)} | {text_col: F.col("__text").alias(text_col)}
    return good.select(*(back[c] for c in docs.columns))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger(table(spark, sf_dir, "documents")).withColumn("base_failed", rejected("base")).withColumn("kept", ~rejected(POLICY))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
hit AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM w LEFT JOIN hit USING (doc_id)),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END + CASE WHEN 2 * n_bangs > n_words THEN 128 ELSE 0 END AS BIGINT) AS failures FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""

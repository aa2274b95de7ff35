"""Operator 12: fill-in-middle by an index of distinct texts whose unit boundaries are kept as Elias-Fano lists."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table

#: Marks of prefix, suffix and middle; shares in percent; what the seeds begin with.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, "1:"
#: Documents that one row of the index carries; a text with more copies has a row for each such number of them.
COPIES = 1 << 14


def unit_ends(text: str) -> "numpy.ndarray":  # noqa: F821
    """Where the units of a text end, in code points: a run of letters A-Z, a-z is a unit, any other character is one."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = (points | 32) - np.uint32(97) < 26
    inside = letter[:-1] & letter[1:]
    return np.flatnonzero(np.r_[~inside, True]) + 1 if len(points) else np.zeros(0, np.int64)


def elias_fano(ends) -> bytes:
    """An ascending list of positive numbers in about ``2 + log2(last / count)`` bits each.

    The low bits of all numbers follow one another; the high parts are a row of bits in which number ``i`` sets the bit at
    its high part plus ``i``.
    """
    import numpy as np

    n = len(ends)
    if not n:
        return struct.pack("<QB", 0, 0)
    low = max(int(ends[-1]) // n, 1).bit_length() - 1
    high = np.zeros(n + (int(ends[-1]) >> low) + 1, np.uint8)
    high[(ends >> low) + np.arange(n)] = 1
    bits = np.stack([ends >> k & 1 for k in range(low)], axis=1).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
    return struct.pack("<QB", n, low) + np.packbits(bits, bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


class Boundaries:
    """Answers from one Elias-Fano list, whose bits are counted once."""

    def __init__(self, raw: bytes):
        import numpy as np

        self.n, self.low = struct.unpack_from("<QB", raw)
        size = (self.n * self.low + 7) // 8
        self.bits = np.frombuffer(raw, np.uint8, size, 9)
        self.high = np.frombuffer(raw, np.uint8, -1, 9 + size) if self.n else self.bits
        self.ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def __getitem__(self, k: int) -> int:
        """Number ``k`` of the list, counted from one; zero for ``k`` zero, as no unit ends at the start."""
        import numpy as np

        if not k:
            return 0
        byte = int(np.searchsorted(self.ones, k))
        before = int(self.ones[byte - 1]) if byte else 0
        bit = int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[k - before - 1])
        rest = 0
        for j in range(self.low):
            at = (k - 1) * self.low + j
            rest |= (int(self.bits[at >> 3]) >> (at & 7) & 1) << j
        return (8 * byte + bit - (k - 1)) << self.low | rest


def _indexed():
    @F.arrow_udf("struct<n: long, ends: binary>")
    def indexed(texts: pa.Array) -> pa.Array:
        lists = [unit_ends(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([len(e) for e in lists], pa.int64()), pa.array([elias_fano(e) for e in lists], pa.binary())], names=["n", "ends"])

    return indexed


def _selected():
    @F.arrow_udf("struct<a: long, b: long>")
    def selected(ends: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        a, b, last, list_ = [], [], None, None
        for raw, i, j in zip(ends, first.to_pylist(), second.to_pylist(), strict=True):
            raw = raw.as_py()
            if raw != last:
                last, list_ = raw, Boundaries(raw)
            a.append(list_[i])
            b.append(list_[j])
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return selected


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = COPIES) -> DataFrame:
    """``(text, ids array<long>, n, ends)``: every distinct text with its documents, its units and where they end.

    Texts meet under their SHA-256 digest, and all contents under a digest are compared: two different ones under one digest
    end the job rather than mix. Copies are put together before the shuffle. A text with more than ``copies`` documents has
    a row for each ``copies`` of them, dealt by their place in the table, so that no row and no task holds an unbounded
    list, whatever the ids are; only the digests of such texts are looked up, broadcast below a checked size.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    keyed = slim.withColumn("digest", F.unhex(F.sha2("text", 256)))
    many = cut(keyed.groupBy("digest").count().where(F.col("count") > copies).select(F.col("digest").alias("hot"), F.ceil(F.col("count") / copies).alias("parts")))
    dealt = keyed.withColumn("place", F.monotonically_increasing_id()).join(small(many, 48), F.col("digest") == F.col("hot"), "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1))))
    met = dealt.groupBy("digest", "part").agg(F.collect_set("text").alias("texts"), F.collect_list(F.struct("id")).alias("ids"))
    one = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("string"))
    return met.select(one.alias("text"), F.col("ids.id").alias("ids")).withColumn("units", _indexed()("text")).select("text", "ids", "units.n", "units.ends")


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output of a form was made from; the marks stand in no text that was rearranged."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    after = lambda a: F.substring_index(output, a, -1)
    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, copies: int = COPIES) -> DataFrame:
    """``(id_col, n, form, prefix_chars, middle_chars, output)`` of every document.

    The cut is seeded by the id alone, so copies of a text are cut at different places of one boundary list. Null text counts
    as empty and stays plain; a null id is seeded by nothing after ``seed``; repeated rows give equal rows, once each; an
    empty table gives no rows; other columns are ignored. A text that holds a mark stays plain, so every output can be undone.
    """
    rows = distinct_texts(docs, id_col, text_col, copies).select("text", "n", "ends", F.explode("ids").alias("id"))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring("seeded", 8 * k + 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("seeded", digest).select("*", *(group(k).alias(f"h{k + 1}") for k in range(4)))
    i, j = F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1)
    rows = rows.withColumn("at", _selected()(F.col("ends"), F.least(i, j), F.greatest(i, j)))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.pmod("h3", F.lit(100)) >= PLAIN_FROM)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < SPM_BELOW, "spm").otherwise("psm"))
    a, b = F.col("at.a").cast("int"), F.col("at.b").cast("int")
    rows = rows.withColumn("prefix", F.substring("text", F.lit(1), a)).withColumn("middle", F.substring("text", a + 1, b - a)).withColumn("suffix", F.substring("text", b + 1, F.lit((1 << 31) - 1)))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    moved = F.col("form") != "plain"
    return rows.select(F.col("id").alias(id_col), "n", "form", F.when(moved, F.col("at.a")).alias("prefix_chars"), F.when(moved, F.col("at.b") - F.col("at.a")).alias("middle_chars"), output.alias("output"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cut, and digests of its output and of the text rebuilt from it; edge cases as ``fill_in_middle``."""
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_group = lambda k: f"CAST('0x' || substr(sha256('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}"
_joined = lambda a, b: f"array_to_string(units[{a} + 1:{b}], '')"
OP12_SQL = f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, {", ".join(map(_group, range(4)))} FROM documents),
 c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j,
 CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT *, {_joined("0", "i")} AS p, {_joined("i", "j")} AS m, {_joined("j", "n")} AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

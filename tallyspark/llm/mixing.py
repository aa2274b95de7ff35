"""Operator 10: sources mixed to target weights by a golden-ratio slot schedule over equal-token blocks."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small, table

WEIGHTS = (3, 1, 2)
#: Words of a block; the last block of a source ends at its target.
BLOCK_WORDS = 1024
#: Slots drawn per block needed. The largest gap of N golden-ratio points is below 2 / N, so every source's
#: interval of n / M gets at least n of 3 M slots, however small it is.
DRAWN = 3
CELLS = 4096
BUCKET_BITS = 12
CHUNK_BITS = 16


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, skey, size)``; skey orders sources by code point, null last."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.encode().split()) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=[id_col, "skey", "size"])

    key = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    return docs.select(F.col(id_col).cast("long").alias(id_col), key.alias("skey"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"{id_col} long, skey string, size long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """One row per source: its size, target and interval of the unit line, in proportion to the blocks it needs.

    The excess over a source's limit is shared again by weight until none is above; that ends where sources in
    order of limit over weight are full up to one point and the rest get one common rate.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nr") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    per = per.withColumn("nr", F.row_number().over(Window.orderBy("skey"))).withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    line = Window.orderBy(F.col("most") / F.col("w"), "skey")
    before, every = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("rate", rate).withColumn("rate", F.first(F.when(F.col("rate") * F.col("w") <= F.col("most"), F.col("rate")), ignorenulls=True).over(every))
    per = per.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("most", F.col("rate") * F.col("w"))))
    return per.withColumn("words", F.floor("target")).select("skey", "source_size", "target", "words")


def schedule(per: DataFrame, block_words: int) -> DataFrame:
    """``(skey, rank, slot)``: the slots of each source's blocks, in the order of the mix.

    Slot ``t`` is the point ``frac(t * golden ratio)``, looked up in the sources' intervals through a grid of
    cells; ranks count a source's slots chunk by chunk. Nothing is gathered by source.
    """
    spark = per.sparkSession
    need = per.withColumn("blocks", F.ceil(F.col("words") / F.lit(block_words))).where("blocks > 0")
    total = need.agg(F.sum("blocks")).first()[0] or 0
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    need = need.withColumn("hi", F.sum("blocks").over(upto)).withColumn("lo", F.col("hi") - F.col("blocks"))
    cells = need.select("skey", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS / F.lit(max(total, 1))), F.ceil(F.col("hi") * CELLS / F.lit(max(total, 1))) - 1)).alias("cell"))
    golden = Fraction(5 ** 0.5 - 1) / 2
    low, high = float(golden), float(golden * (1 << 20) % 1)
    point = F.pmod(F.floor(F.col("id") / F.lit(1 << 20)) * F.lit(high) + F.pmod(F.col("id"), F.lit(1 << 20)) * F.lit(low), F.lit(1.0))
    slots = spark.range(DRAWN * total).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell")
    slots = slots.where((F.col("u") * total >= F.col("lo")) & (F.col("u") * total < F.col("hi"))).select("skey", "blocks", F.col("id").alias("slot"), F.shiftright("id", CHUNK_BITS).alias("chunk"))
    slots = slots.withColumn("nth", F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")))
    counts = slots.groupBy("skey", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("skey", "chunk", (F.sum("n").over(Window.partitionBy("skey").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = slots.join(counts, ["skey", "chunk"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    return ranked.where("rank < blocks").select("skey", "rank", "slot")


def spans(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents in their sources' shuffled streams, and the mix: one row per document part and slot.

    Returns ``(placed, taken)``. placed: id, skey, size, at (first word's place in the stream), source_size,
    target, words. taken: skey, at, slot, first, last (words of the document, repeats counted on).
    """
    sizes = cut(sized(docs, id_col, text_col, source_col))
    per = cut(targets(sizes, weights, share, limit))
    mixed = sizes.withColumn("h", F.xxhash64(F.lit("mix"), id_col)).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    sums = mixed.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("skey", "bucket", (F.sum("n").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = mixed.withColumn("upto", F.sum("size").over(inside)).join(sums, ["skey", "bucket"]).withColumn("at", F.col("before") + F.col("upto") - F.col("size"))
    placed = cut(placed.join(small(per, 64), "skey").select(id_col, "skey", "size", "at", "source_size", "target", "words"))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max(int(-(-limit // 1)) - 1, 0))))
    parts = placed.where("size > 0").select("skey", "at", "size", "words", "source_size", rounds.alias("round"))
    parts = parts.withColumn("begin", F.col("at") + F.col("round") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words"))).where("begin < end")
    parts = parts.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
    first, last = F.greatest("begin", F.col("rank") * block_words), F.least("end", (F.col("rank") + 1) * block_words)
    parts = parts.select("skey", "at", "rank", "round", (first - F.col("begin")).alias("first"), (last - F.col("begin")).alias("last"))
    return placed, parts.join(schedule(per, block_words), ["skey", "rank"]).select("skey", "at", "slot", "round", "first", "last")


def mix_counts(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row.

    A row's size is its number of words, 0 for null; rows of size 0 are never taken. Sources share ``share`` of
    all words by weight, none above ``limit`` times its own. Repeated rows are documents of their own; equal
    rows stand side by side in the stream, so reruns give the same rows. An empty table gives an empty result.
    """
    placed, taken = spans(docs, weights, share, limit, block_words, id_col, text_col, source_col)
    words = taken.groupBy("skey", "at").agg(F.sum(F.col("last") - F.col("first")).alias("taken")).withColumn("some", F.lit(True))
    joined = placed.withColumn("some", F.col("size") > 0).join(words, ["skey", "at", "some"], "left")
    return joined.select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def stream_edges(sizes: DataFrame, per: DataFrame, limit: float, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Where the mix ends in each source's stream: ``(edges, buckets)``, both written.

    edges: skey, round, left, edge. In a round a source gives the first ``left`` words of its stream, as far as the
    schedule has slots for its blocks. Documents stand in the stream by bucket of their hash, so all buckets below
    ``edge`` are taken whole and none above; null: all are. buckets: skey, bucket, before (words before it), n.
    """
    slots = schedule(per, block_words).groupBy("skey").agg(((F.max("rank") + 1) * block_words).alias("room"))
    reach = per.join(slots, "skey").select("skey", "source_size", F.least("words", "room").alias("reach"))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max(int(-(-limit // 1)) - 1, 0))))
    reach = cut(reach.select("skey", rounds.alias("round"), "reach", "source_size").select("skey", "round", (F.col("reach") - F.col("round") * F.col("source_size")).alias("left")).where("left > 0"))
    sums = bucketed(sizes).groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    sums = cut(sums.select("skey", "bucket", "n", (F.sum("n").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("n")).alias("before")))
    edge = F.min(F.when(F.col("before") + F.col("n") > F.col("left"), F.col("bucket"))).alias("edge")
    return cut(sums.join(small(reach, 64), "skey").groupBy("skey", "round", "left").agg(edge)), sums


def bucketed(sizes: DataFrame) -> DataFrame:
    id_col = sizes.columns[0]
    return sizes.withColumn("h", F.xxhash64(F.lit("mix"), id_col)).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of ``docs``: each document once per round in which its source takes it.

    A document at the end of a source's target keeps the words taken, joined by spaces; all others keep their
    text as it stands. Documents that are not taken go, and so do those without a word. Repeated rows are documents of
    their own; null ids and sources take part like any other. All columns come back, whatever their names.

    Whether a document is taken whole follows from its bucket and a few numbers of its source, so texts are not joined
    with rows of documents. Only those of the bucket in which a source's target ends, one in 4,096, are placed one by one.
    """
    sizes = cut(sized(docs, id_col, text_col, source_col).toDF("id", "skey", "size"))
    per = cut(targets(sizes, weights, share, limit))
    edges, sums = stream_edges(sizes, per, limit, block_words)
    ends = cut(edges.groupBy("skey").agg(F.collect_list(F.struct("round", "left", "edge")).alias("ends")))
    key = F.when(F.col(f"`{source_col}`").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(f"`{source_col}`").cast("string")))
    text = F.col(f"`{text_col}`").cast("string")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), key.alias("skey"), text.alias("t"))
    bucket = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "id"), 64 - BUCKET_BITS)
    named = named.withColumn("bucket", bucket).join(small(ends, 256), "skey")
    rounds = F.size(F.filter("ends", lambda e: e["edge"].isNull() | (F.col("bucket") < e["edge"])))
    whole = named.withColumn("rounds", rounds).where((F.col("rounds") > 0) & F.col("t").rlike(WORD))
    whole = whole.select("row", "t", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("round")).select("row", "t")
    # the bucket where a source's target ends: words from the stream's place
    last = edges.where("edge is not null").select("skey", "round", "left", F.col("edge").alias("bucket"))
    inside = Window.partitionBy("skey", "bucket", "round").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    turns = bucketed(sizes).where("size > 0").join(small(last, 64), ["skey", "bucket"]).join(small(sums, 48), ["skey", "bucket"])
    turns = turns.withColumn("at", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    turns = turns.withColumn("nr", F.row_number().over(Window.partitionBy("skey", "id", "size", "round").orderBy("at")))
    turns = turns.withColumn("words", F.least("size", F.col("left") - F.col("at"))).where("words > 0").select(F.col("id").alias("t_id"), F.col("skey").alias("t_skey"), F.col("size").alias("t_size"), F.col("nr").alias("t_nr"), "words")
    listed = F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(0))
    cutting = named.where(F.exists("ends", lambda e: e["edge"].eqNullSafe(F.col("bucket")))).select("row", "t", "id", "skey", listed.alias("listed")).withColumn("size", F.size("listed"))
    cutting = cutting.withColumn("nr", F.row_number().over(Window.partitionBy("id", "skey", "size").orderBy(F.xxhash64("t"))))
    on = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("skey") == F.col("t_skey")) & (F.col("size") == F.col("t_size")) & (F.col("nr") == F.col("t_nr"))
    part = F.when(F.col("words") == F.col("size"), F.col("t")).otherwise(F.array_join(F.slice("listed", F.lit(1), F.col("words").cast("int")), " "))
    both = whole.unionByName(cutting.join(small(cut(turns), 64), on).select("row", part.alias("t")))
    kinds = dict(docs.dtypes)
    back = lambda c: F.col("t").cast(kinds[c]) if c == text_col else F.char_length("t").cast(kinds[c]) if c == "n_chars" else F.col("row").getField(c)
    return both.select(*(back(c).alias(c) for c in docs.columns))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))

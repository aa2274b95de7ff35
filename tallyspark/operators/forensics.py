"""Document integrity on relations: metadata, spans, pages and lines that a reader has extracted.

Inputs: ``meta(file_id, bank, creator, producer, created, modified, eofs, fonts, pages, file_size, text_a, text_b)``
and ``spans(file_id, page, text, font, size, color, x0, y0, x1, y1, visible)``. Each layer returns
``(file_id, layer, severity, message)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Editors that leave their name in a file; severities in order.
EDITORS = ("PHOTOSHOP", "ILLUSTRATOR", "CANVA", "SEJDA", "SMALLPDF", "ILOVEPDF", "PDFESCAPE", "FOXIT PHANTOM", "NITRO", "LIBREOFFICE DRAW", "GIMP", "INKSCAPE")
SEVERITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def finding(df: DataFrame, layer: str, severity: Column | str, message: Column | str, when: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.where(when).select("file_id", F.lit(layer).alias("layer"), lit(severity).alias("severity"), lit(message).alias("message"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metadata_layer(meta: DataFrame) -> DataFrame:
    """L1: an editor's name, a late change, several file ends."""
    maker = F.upper(F.concat_ws(" ", "creator", "producer"))
    days = F.datediff("modified", "created")
    return union(
        finding(meta, "L1", "HIGH", "editor in metadata", F.exists(F.array(*map(F.lit, EDITORS)), lambda e: maker.contains(e))),
        finding(meta, "L1", F.when(days > 30, "HIGH").otherwise("MEDIUM"), "changed after creation", days > 1),
        finding(meta, "L1", F.when(F.col("eofs") > 3, "HIGH").otherwise("MEDIUM"), "several file ends", F.col("eofs") > 2),
    )


def font_layer(spans: DataFrame) -> DataFrame:
    """Money in another font or colour than the main one, if that one covers under 85%; over eight fonts."""
    money = spans.where(F.col("text").rlike(r"^[\d,]+\.\d{2}$"))
    style = money.groupBy("file_id", "font", "color").agg(F.count("*").alias("n"))
    top = style.groupBy("file_id").agg((F.max("n").cast("double") / F.sum("n")).alias("share"))
    fonts = spans.groupBy("file_id").agg(F.countDistinct("font").alias("fonts"))
    return union(finding(top, "L2", "HIGH", "money in mixed styles", F.col("share") < 0.85), finding(fonts, "L2", "MEDIUM", "many fonts", F.col("fonts") > 8))


def rare_styles(spans: DataFrame, share: float = 0.05) -> DataFrame:
    """Styles under 5% of a file's characters."""
    n = spans.groupBy("file_id", "font", "size").agg(F.sum(F.length("text")).alias("chars"))
    out = n.withColumn("share", F.col("chars") / F.sum("chars").over(Window.partitionBy("file_id")))
    return out.where(F.col("share") < share).select("file_id", "font", "size", "chars", F.round("share", 6).alias("share"))


def overlap_layer(spans: DataFrame, cell: float = 40.0) -> DataFrame:
    """L3: spans of different text that cover each other by 30% on both axes; two or more hidden money spans.

    A box meets others of its page through the grid cells it covers, an equality join; the overlap is checked then.
    """
    boxed = spans.withColumn("id", F.xxhash64("file_id", "page", "text", "x0", "y0", "x1", "y1"))
    cells = boxed.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    a, b = cells.alias("a"), cells.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("file_id", "page", "cx", "cy")]
    over = lambda lo, hi: (F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}")) / F.least(F.col(f"a.{hi}") - F.col(f"a.{lo}"), F.col(f"b.{hi}") - F.col(f"b.{lo}"))
    pairs = a.join(b, [*on, F.col("a.id") < F.col("b.id"), F.col("a.text") != F.col("b.text"), over("x0", "x1") >= 0.3, over("y0", "y1") >= 0.3])
    hit = pairs.groupBy(F.col("a.file_id").alias("file_id")).agg(F.countDistinct("a.id", "b.id").alias("n"))
    hidden = spans.where(~F.col("visible") & F.col("text").rlike(r"^[\d,]+\.\d{2}$")).groupBy("file_id").agg(F.count("*").alias("n"))
    return union(finding(hit, "L3", "HIGH", "overlapping text", F.col("n") > 0), finding(hidden, "L3", "HIGH", "hidden amounts", F.col("n") >= 2))


def page_layer(pages: DataFrame) -> DataFrame:
    """Pages of another size than most, pages with an image and no text, ``pages(file_id, page, width, height, chars, images)``."""
    mode = pages.groupBy("file_id").agg(F.mode(F.struct("width", "height")).alias("m"))
    odd = pages.join(mode, "file_id").groupBy("file_id").agg(F.count_if((F.col("width") != F.col("m.width")) | (F.col("height") != F.col("m.height"))).alias("odd"), F.count_if((F.col("chars") == 0) & (F.col("images") > 0)).alias("scans"), F.count("*").alias("pages"))
    return union(finding(odd, "L4", "MEDIUM", "page sizes differ", F.col("odd") > 0), finding(odd, "L7", "MEDIUM", "pages without text", (F.col("scans") > 0) & (F.col("scans") < F.col("pages"))))


def engine_layer(meta: DataFrame) -> DataFrame:
    """Two readers see texts of different length, ratio under 0.85."""
    ratio = F.least("text_a", "text_b") / F.nullif(F.greatest("text_a", "text_b"), F.lit(0))
    return finding(meta, "L5", F.when(F.col("pages") >= 3, "HIGH").otherwise("MEDIUM"), "readers disagree", ratio < 0.85)


def profile_layer(meta: DataFrame, profiles: DataFrame) -> DataFrame:
    """Creator or producer is none that the bank's profile lists, ``profiles(bank, creator, producer)``."""
    known = profiles.groupBy("bank").agg(F.collect_set(F.upper("creator")).alias("creators"), F.collect_set(F.upper("producer")).alias("producers"))
    j = meta.join(F.broadcast(known), "bank")
    return union(finding(j, "L6", "MEDIUM", "unknown creator", ~F.array_contains("creators", F.upper("creator"))), finding(j, "L6", "MEDIUM", "unknown producer", ~F.array_contains("producers", F.upper("producer"))))


def arithmetic_layer(checked: DataFrame) -> DataFrame:
    """Files whose running balances do not add up, from W02's rows with a ``file_id``."""
    bad = checked.groupBy("file_id").agg(F.count_if("mismatch").alias("n"))
    return finding(bad, "L8", "HIGH", "balances do not add up", F.col("n") > 0)


def batch_comparison(meta: DataFrame) -> DataFrame:
    """Creator and producer against the bank group's most frequent, size a page against three times its median."""
    per = meta.withColumn("page_size", F.col("file_size") / F.greatest("pages", F.lit(1)))
    tops = [per.groupBy("bank", k).agg(F.count("*").alias("n")).groupBy("bank").agg(F.min_by(k, F.struct(-F.col("n"), k)).alias(f"top_{k}")) for k in ("creator", "producer")]
    mid = per.groupBy("bank").agg(F.expr("percentile(page_size, 0.5)").alias("mid"), F.count("*").alias("files"))
    j = per.join(mid, "bank").join(tops[0], "bank").join(tops[1], "bank").where("files > 1")
    return j.select("file_id", "bank", (F.col("creator") != F.col("top_creator")).alias("creator_differs"), (F.col("producer") != F.col("top_producer")).alias("producer_differs"), (F.col("page_size") > 3 * F.col("mid")).alias("size_differs"))


def roll_up(findings: DataFrame) -> DataFrame:
    """Worst severity and counts of each file."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("severity")]
    agg = findings.groupBy("file_id").agg(F.max(rank).alias("worst"), F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY))
    return agg.select("file_id", F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("worst")).alias("risk"), "findings", *(s.lower() for s in SEVERITY))


def priority(findings: DataFrame, k: int = 10) -> DataFrame:
    """The worst findings first."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("severity")]
    return findings.orderBy(rank.desc(), "file_id", "layer", "message").limit(k)


def flatten_findings(findings: DataFrame, benign: tuple[str, ...] = ()) -> DataFrame:
    """Rows for export without benign messages."""
    return findings.where(~F.col("message").isin(*benign)) if benign else findings


def visual_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """P20: words of a page whose y follow each other within the tolerance form a line; gaps and islands over y."""
    w = Window.partitionBy("file_id", "page").orderBy("y0", "x0")
    new = F.when(F.col("y0") - F.lag("y0").over(w) <= tolerance, 0).otherwise(1)
    lined = words.withColumn("new", new).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lined.groupBy("file_id", "page", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda t: t["text"]), " ").alias("text"), F.min("y0").alias("y0"))

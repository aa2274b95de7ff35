"""The parsers of all banks (P04), registered by one call: text lines for some, words with coordinates for others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bankparties, cascades, layouts, markers, partybanks, words
from .statements import register, text_layout

#: What reads the text lines ``(file, page, line, text)`` of a bank's statements.
BY_LINES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Alliance Bank": layouts.alliance, "Ambank": markers.ambank, "Bank Islam": cascades.bank_islam, "CIMB Bank": cascades.cimb, "OCBC": layouts.ocbc, "Public Bank (PBB)": layouts.public_bank, "RHB Bank": cascades.rhb,
}
#: What reads the words ``(file, page, x0, y0, x1, text, width)`` of a bank's statements.
BY_WORDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Affin Bank": words.affin, "Agro Bank": markers.agro, "Bank Muamalat": words.muamalat, "Bank Rakyat": words.rakyat, "Hong Leong": words.hong_leong, "Maybank": words.maybank, "UOB Bank": cascades.uob,
}


def printed_words(files: DataFrame) -> DataFrame:
    """Words of files ``(path, content)`` with a tab-separated line for each: page, x0, y0, x1, text and, if known, the page's width.

    Lines without a text or with positions that are no numbers give words without them, which the layouts leave out.
    """
    lines = files.select(F.col("path").alias("file"), F.explode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("t")).withColumn("p", F.split("t", "\t"))
    number = lambda k: F.get("p", F.lit(k)).try_cast("double")
    return lines.select("file", F.get("p", F.lit(0)).try_cast("int").alias("page"), number(1).alias("x0"), number(2).alias("y0"), number(3).alias("x1"), F.get("p", F.lit(4)).alias("text"), number(5).alias("width"))


def register_all() -> None:
    """Every bank's parser and party rules under its name, and the plain text layout under ``text``; a second call changes nothing."""
    bankparties.BANK_RULES.update(partybanks.RULES)
    register("text", text_layout)
    for bank, layout in BY_LINES.items():
        register(bank, lambda files, layout=layout: layout(layouts.text_lines(files)))
    for bank, layout in BY_WORDS.items():
        register(bank, lambda files, layout=layout: layout(printed_words(files)))

"""Item sections of filings: from each heading to the next, kept by form and length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.config import DEFAULTS
from sedimenta.functions.text import form_type

# The items of each form.
ITEMS = {
    "10-K": "1 1A 1B 2 3 4 5 6 7 7A 8 9 9A 9B 10 11 12 13 14 15".split(),
    "10-Q": "1 1A 1B 2 3 4".split(),
    "8-K": "1.01 1.02 1.03 1.04 1.05 2.01 2.02 2.03 2.04 2.05 2.06 3.01 3.02 3.03 4.01 4.02 5.01 5.02 5.03 5.04 5.05 5.06 5.07 5.08 6.01 6.02 6.03 6.04 6.05 7.01 8.01 9.01".split(),
}
HEADING = r"item\s+(\d{1,2}[a-z]?)(?:\.(\d{2}))?[\s.\-–—:]+(.*)"
BEFORE = rf"(?im)(?=^{HEADING.replace('(', '(?:').replace('(?:?:', '(?:')}$)"


def sections(docs: DataFrame, least: int = DEFAULTS.section_min_length) -> DataFrame:
    """``doc_id``, ``item``, ``title``, ``content``, ``start``, ``end`` of the sections of ``content``.

    A split before each heading keeps the heading at the start of its piece;
    lengths of the pieces before give the offsets. A section ends at the next
    heading even if that one is not kept. Items that the form does not have,
    and sections of under ``least`` characters, are left out.
    """
    d = docs.select("doc_id", form_type(F.col("content")).alias("form"), F.split("content", BEFORE, -1).alias("pieces"))
    at = lambda p, i: F.aggregate(F.slice(p, 1, i), F.lit(0), lambda s, x: s + F.char_length(x))
    p = d.select("doc_id", "form", F.explode(F.transform("pieces", lambda x, i: F.struct(at(F.col("pieces"), i).alias("start"), x.alias("piece")))).alias("s")).select("doc_id", "form", "s.*")
    head = lambda g: F.regexp_extract("piece", "(?i)^" + HEADING, g)
    tail = F.when(head(2) != "", F.concat(F.lit("."), head(2))).otherwise("")
    p = p.where(F.col("piece").rlike("(?i)^" + HEADING)).withColumns({"item": F.concat(F.when(tail == "", F.upper(head(1))).otherwise(head(1)), tail), "title": F.trim(head(3)), "end": F.col("start") + F.char_length("piece")})
    allowed = F.lit(True)
    for form, items in ITEMS.items():
        allowed = F.when(F.col("form") == form, F.col("item").isin(*items)).otherwise(allowed)
    p = p.withColumn("content", F.regexp_replace("piece", r"^\s+|\s+$", ""))
    return p.where(allowed & (F.char_length("content") >= least)).select("doc_id", "item", "title", "content", "start", "end")

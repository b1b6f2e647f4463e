"""What the operators share about texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word in Java's and Python's regular expressions. ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; null becomes empty.

    ``lower`` changes letters outside A-Z too and ``translate`` costs most of a pass over the text, so runs of capitals
    are lowered apart from the rest.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z]+|[^A-Z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when((r >= "A") & (r < "["), F.lower(r)).otherwise(r)), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

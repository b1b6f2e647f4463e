"""Counts over whole texts that rules and classifiers of quality use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pathweave.llm.workers import each_text, reachable

#: Words in a window that counts as repeated when it comes twice.
WINDOW = 8

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")

_SPACE = b" \t\n\r\x0b\x0c"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` that come twice or more. Windows get numbers from their halves' numbers, so
    equal numbers are equal windows."""
    n = len(ids)
    if n <= WINDOW:
        return 0
    for step in (1, 2, 4):
        pairs = ids[:-step] * (ids.max() + 1) + ids[step:]
        found, ids = np.unique(pairs, return_inverse=True)
        if len(found) == len(ids):  # nothing comes twice
            return 0
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int((np.cumsum(edges[:n]) > 0).sum())


def stats_of(text: bytes | None) -> tuple[int, ...]:
    """The counts of ``NAMES`` for one text; all 0 for none."""
    text = text or b""
    words = text.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda drop: len(text) - len(text.translate(None, drop))
    return (len(words), len(text.translate(None, _SPACE + _FOLLOWING)), without(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids),
            len(lines), len(numbers), without(_UPPER), without(_DIGITS), without(b"!?"))


@F.arrow_udf(StructType([StructField(n, LongType()) for n in NAMES]))
def _stats(texts: pa.Array) -> pa.Array:
    rows = np.array([stats_of(t) for t in each_text(texts)], np.int64).reshape(-1, len(NAMES))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(NAMES))], NAMES)


def text_stats(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with a structure of the counts of ``text``, a null one counting as empty."""
    return reachable(docs).withColumn(name, _stats(F.col(text)))

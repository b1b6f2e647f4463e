"""Secrets in texts, by one automaton of all rules in one pass over the bytes.

All rules' expressions become one minimal deterministic automaton, whose states say which rules' matches may end at a
byte. Where a rule's first match ends, its own automaton of the reversed expression goes back to the beginning, and the
one of the expression goes on to the longest end; then the rule waits for the next match behind it. That gives a rule's
leftmost, longest, non-overlapping matches as long as no match begins before and ends after the rule's first to end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pathweave.llm.automata import Dfa
from pathweave.llm.workers import each_text, reachable


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (ASCII) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: In order of kind. The first three are the base rules.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Dfa([r.pattern for r in rules], anywhere=True)
        self.forth = [Dfa([r.pattern]) for r in rules]
        self.back = [Dfa([r.pattern], backwards=True) for r in rules]
        self.checks = [re.compile(r.pattern.encode()) if r.least else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule number, end)`` in bytes, in order."""
        table, accepting, ends, state = self.all.table, self.all.accepting, self.all.ends, self.all.start
        behind = [0] * len(self.rules)
        found = []
        for end, c in enumerate(data.translate(self.all.classes), 1):
            state = table[state + c]
            if state >= accepting:
                for rule in ends[state]:
                    if end > behind[rule]:
                        begin = self.back[rule].last(data, range(end - 1, behind[rule] - 1, -1))
                        if begin < 0:  # it began in the match before
                            continue
                        behind[rule] = self.forth[rule].last(data, range(begin, len(data))) + 1
                        if self._holds(rule, data[begin:behind[rule]]):
                            found.append((begin, rule, behind[rule]))
        return sorted(found)

    def _holds(self, rule: int, match: bytes) -> bool:
        check = self.checks[rule]
        return check is None or len(check.fullmatch(match)[self.rules[rule].group]) >= self.rules[rule].least


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The compiled rules, once in a Python process."""
    return Scanner(rules)


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("kind", StringType()), StructField("end", LongType()), StructField("base", LongType())]))


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[s]), r, int(before[e])) for s, r, e in spans]


def find_secrets(docs: DataFrame, text: str = "text", name: str = "secrets", rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """``docs`` with ``name``: an array of ``(start, kind, end, base)`` by start, then kind in the order of the rules;
    offsets in code points, ends exclusive, ``base`` 1 for the first ``base`` rules. A null or empty text has none; very long ones are scanned
    whole."""

    @F.arrow_udf(_SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        own = scanner(rules)
        out = []
        for t in each_text(texts):
            spans = _code_points(t, own.spans(t)) if t else []
            out.append([{"start": s, "kind": rules[r].kind, "end": e, "base": int(r < base)} for s, r, e in spans])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.int64())]))
        return pa.array(out, kind)

    return reachable(docs).withColumn(name, scan(F.col(text)))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def secret_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, counts of the base kinds, the SHA-256 of the base spans and all spans.

    Other columns are not read; repeated rows give repeated rows; an empty table gives an empty one.
    """
    found = find_secrets(docs.select(F.col(key).alias(key), F.col(text).alias("_text")), "_text", "_spans")
    counts = [F.size(F.filter("_spans", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in RULES[:BASE]]
    base = F.filter("_spans", lambda s: s["base"] == 1)
    return found.select(key, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))

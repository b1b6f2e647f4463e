"""Quality rules whose cutoffs are chosen under control of false rejections.

Each rule rejects documents whose measure is above its cutoff. Cutoffs are picked per stratum (language) from a fixed
grid, on labelled documents: a cutoff is certified if the exact binomial bound says that at most ``LIMIT`` of the good
documents of the stratum are above it, ``LIMIT`` being the rule's share of the whole limit. A grid is tested from its
loosest value on and left at the first that fails, which needs no correction along the grid; across rules and strata the
confidence is divided by their number (Bonferroni), strata being all that have labels. With the given confidence, no stratum loses more of its good
documents to the rules than the whole limit. Among certified cutoffs the one that tells bad from good best is used.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.textstats import text_stats
from pathweave.llm.workers import reachable
from pathweave.session import settle, small

#: Good documents of a stratum that the rules together may reject, and the chance that a bound fails anywhere.
LIMIT = 0.05
RISK = 0.05
#: What a false rejection weighs against a right one, as rates, when certified cutoffs are compared.
WEIGHT = 10.0

#: Measures, as SQL over the counts, and their grids from loose to strict.
RULES = {
    "symbols": ("stats.n_symbols / greatest(stats.n_words, 1)", (5, 3, 2, 1.5, 1, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    "capitals": ("stats.n_upper / greatest(stats.word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "marks": ("stats.n_marks / greatest(stats.n_words, 1)", (3, 2, 1.5, 1, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1)),
    "copied lines": ("stats.n_dup_lines / greatest(stats.n_lines, 1)", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "few words": ("1 - stats.n_distinct / greatest(stats.n_words, 1)", (0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7)),
    "digits": ("stats.n_digits / greatest(stats.word_chars, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "long words": ("stats.word_chars / greatest(stats.n_words, 1)", (60, 40, 30, 25, 20, 16, 14, 12)),
}


def certified(rejected: int, good: int, limit: float, risk: float) -> bool:
    """Is the exact (Clopper-Pearson) upper bound of the rejection rate at confidence 1 - ``risk`` at most ``limit``?
    It is where so few rejections have a probability of ``risk`` or less at a rate of ``limit``."""
    if rejected >= good * limit:
        return False  # about one half or more
    total, k = 0.0, rejected
    while k >= 0:
        part = exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * log(limit) + (good - k) * log1p(-limit))
        total += part
        if total > risk or part < 1e-18:
            break
        k -= 1
    return total <= risk


def cutoffs(counts: dict[tuple[str, int], tuple[int, int]], strata: int, limit: float = LIMIT, risk: float = RISK) -> dict[str, float]:
    """One stratum's cutoffs by rule, ``strata`` being tested in all, from ``counts[rule, passed] = (good, bad)``, where
    ``passed`` is how many values of the rule's grid a measure is above. No entry: no cutoff is certified, or none is
    worth it."""
    chosen: dict[str, float] = {}
    for rule, (_, grid) in RULES.items():
        own = [counts.get((rule, i), (0, 0)) for i in range(len(grid) + 1)]
        good, bad = (sum(x[j] for x in own) for j in (0, 1))
        best = 0.0
        for i, value in enumerate(grid):
            above = own[len(grid) - i:]  # what passes the i-th value passes all stricter ones
            g, b = (sum(x[j] for x in above) for j in (0, 1))
            if not certified(g, good, limit / len(RULES), risk / (len(RULES) * strata)):
                break
            worth = b / max(bad, 1) - WEIGHT * g / max(good, 1)
            if worth > best:
                best = worth
                chosen[rule] = float(value)
    return chosen


def _passed(rule: str) -> Column:
    """How many values of the grid, counted from the strict end, the measure is above."""
    measure, grid = RULES[rule]
    return sum(((F.expr(measure) > float(v)).cast("int") for v in grid), F.lit(0))


def _name(stratum: str) -> Column:
    """A stratum's name; null and the empty string are two."""
    return F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality") -> DataFrame:
    """Cutoffs from documents with ``stats``: ``cut_stratum`` and one column ``cut_<i>`` by rule, null without a cutoff;
    broadcast unless strata are too many. Labels of one key are averaged; null labels and keys are not used. However often a
    labelled key is repeated, it is one document, the row of it whose counts have the smallest hash: the bounds are on
    independent documents."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg((F.avg(label) >= 0.5).alias("_good"))
    places = F.array(*(F.struct(F.lit(r).alias("rule"), _passed(r).alias("passed")) for r in RULES))
    own = F.struct(_name(stratum).alias("stratum"), places.alias("at"))
    # one row of each key, combined before the shuffle
    rows = docs.join(known, F.col(key) == F.col("_k")).select("_k", "_good", own.alias("_own"))
    rows = rows.groupBy("_k", "_good").agg(F.min_by("_own", F.struct(F.xxhash64("_own"), "_own")).alias("_own"))
    rows = rows.select("_own.stratum", "_good", F.explode("_own.at").alias("at"))
    counted = rows.groupBy("stratum", "at.rule", "at.passed").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))
    # a stratum has as many counts as the grids have places
    grouped, seen = settle(counted.groupBy("stratum").agg(F.collect_list(F.struct("rule", "passed", "good", "bad")).alias("counts")))
    strata = seen["rows"]

    def pick(batches):
        for batch in batches:
            found = [cutoffs({(c["rule"], c["passed"]): (c["good"], c["bad"]) for c in counts}, strata) for counts in batch.column(1).to_pylist()]
            limits = [pa.array([f.get(rule) for f in found], pa.float64()) for rule in RULES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *limits], names=["cut_stratum", *(f"cut_{i}" for i in range(len(RULES)))])

    schema = ", ".join(["cut_stratum string", *(f"cut_{i} double" for i in range(len(RULES)))])
    return small(*settle(reachable(grouped).mapInArrow(pick, schema)))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``key``, the base counts, ``base_failed`` and ``kept``.

    A null text counts as empty and fails the base rules; very long texts are counted whole. Strata without enough labels
    have no cutoffs and only the base rules; a null stratum is one of its own. Repeated rows are judged alike, and a
    repeated labelled document is evidence once; other columns are not read; an empty table gives an empty one.
    """
    slim = text_stats(docs.select(F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), F.col(text).alias("_text")), "_text").drop("_text")
    slim, _ = settle(slim)
    chosen = learn(slim, labels.withColumnRenamed(key, "_key"), "_key", "_stratum")
    slim = slim.join(chosen, _name("_stratum") == F.col("cut_stratum"), "left")
    passes = F.lit(True)
    for i, (measure, _) in enumerate(RULES.values()):
        passes = passes & (F.col(f"cut_{i}").isNull() | ~(F.expr(measure) > F.col(f"cut_{i}")))
    failed = (F.col("stats.n_words") < 20) | (100 * F.col("stats.n_repeat_words") > 30 * F.col("stats.n_words"))
    base = [F.col(f"stats.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return slim.select(F.col("_key").alias(key), *base, failed.alias("base_failed"), (~failed & passes).alias("kept"))

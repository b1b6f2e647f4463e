"""Mixing sources to target weights by Pareto order sampling.

Targets are shares of all words by the sources' weights, never above ``MOST`` times a source's own words. A source whose
target is ``r`` times its words gives the whole part of ``r`` copies of every document for certain. For the rest ``f``,
documents have unequal inclusion probabilities: ``f`` times their weight over the source's mean weight, where a document
weighs more the more of a ``FULL`` window it fills. Each gets the rank ``odds(u) / odds(p)`` from a uniform number of its
own, and documents are taken in the order of ranks until the source has the words it lacks.

Which documents those are is told by one cutoff per source, so a mix is a join with a table of sources, and the texts
are not moved for it. Sums along the order are taken inside ranges of the sorted rows and then over the ranges, so a
source of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.rank import ROW_BITS, global_rank
from pathweave.llm.text import word_count
from pathweave.session import settle, small

#: Weights that sources take in turn, most copies of a document, words of a full window, and the seed of ranks.
WEIGHTS = (5, 2, 1)
MOST = 3
FULL = 2048
SEED = "mix"


def _uniform(key: Column) -> Column:
    """A number between 0 and 1 of a key, from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _heaviness(size: str) -> Column:
    return F.lit(FULL) + F.least(F.col(size), F.lit(FULL))


def _rank() -> Column:
    """Odds of the random number over odds of inclusion, null where nothing is left to include; needs size,
    source_size, target, whole and heavy."""
    u = _uniform(F.col("id"))
    rest = F.try_divide("target", "source_size") - F.col("whole")
    p = F.try_divide(rest * _heaviness("size") * F.col("source_size"), F.col("heavy"))
    return F.try_divide((u / (F.lit(1.0) - u)) * F.greatest(F.lit(1.0) - p, F.lit(0.0)), p)


def targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source of ``(source, size)``: ``source_size``, ``heavy`` (sum of size times weight of documents),
    ``target``. Sources take the weights by code point, null last."""
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _heaviness("size")).alias("heavy"))
    sources = global_rank(sources, [F.col("source").asc_nulls_last()], "at")
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    sources, seen = settle(sources.drop("at"), words=F.sum("source_size"), weight=F.sum("weight"))
    level = (seen["words"] or 0) / (seen["weight"] or 1)
    while True:  # raising the level caps more sources, until it stays
        capped = F.lit(MOST) * F.col("source_size") < F.lit(level) * F.col("weight")
        held, free = sources.agg(
            F.coalesce(F.sum(F.when(capped, MOST * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        raised = ((seen["words"] or 0) - held) / free if free else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.lit(level) * F.col("weight"), (F.lit(MOST) * F.col("source_size")).cast("double"))
    return sources.select("source", "source_size", "heavy", target.alias("target"))


def plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source of ``(id, source, size)``: its targets, the ``whole`` copies of each document, and ``cutoff``,
    the last ``(rank, id)`` that gets one more (null: none)."""
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    sources, seen = settle(targets(slim, weights).withColumn("whole", whole))
    sources = small(sources, seen)
    lacking = sources.where(F.col("target") - F.col("whole") * F.col("source_size") > 0)
    names = lacking.withColumnRenamed("source", "of")
    ranked = slim.join(names, F.col("source").eqNullSafe(F.col("of"))).where("size > 0")
    ranked = ranked.select("source", "id", "size", _rank().alias("rank"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("lacks"))
    ordered, _ = settle(ranked.orderBy(F.col("source"), F.col("rank"), F.col("id")).withColumn("line", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("line", ROW_BITS))
    # sums inside a range of the order, then over the ranges of a source
    inside = Window.partitionBy("part", "source").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranges = ordered.groupBy("part", "source").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    summed = ordered.join(ranges, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    taken = summed.where(F.col("before") + F.col("earlier") + F.col("size") / F.lit(2.0) <= F.col("lacks"))
    cutoffs = taken.groupBy(F.col("source").alias("s")).agg(F.max(F.struct("rank", "id")).alias("cutoff"))
    planned, _ = settle(sources.join(cutoffs, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    return planned


def _copies() -> Column:
    extra = F.col("cutoff").isNotNull() & (F.col("size") > 0) & (F.struct(_rank().alias("rank"), "id") <= F.col("cutoff"))
    return F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")


def _slim(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``size``, ``source_size``, ``target`` (of its source), ``taken``.

    Rows that repeat key, source and size are taken alike. A very long text is counted whole, and taken whole or not at
    all. A null text has size 0 and gives no words, a null source is a
    source, the last one. Other columns are not read. An empty table gives an empty one.
    """
    slim, _ = settle(_slim(docs, text, key, source))
    sources, seen = settle(plan(slim, weights))
    rows = slim.join(small(sources.withColumnRenamed("source", "of"), seen), F.col("source").eqNullSafe(F.col("of")))
    taken = (_copies() * F.col("size")).cast("long")
    return rows.select(F.col("id").alias(key), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, with their columns, as often as they are taken."""
    slim, _ = settle(_slim(docs, text, key, source))
    sources, seen = settle(plan(slim, weights))
    whole = F.struct(*docs.columns).alias("row")
    named = docs.select(whole, F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = named.join(small(sources.withColumnRenamed("source", "of"), seen), F.col("source").eqNullSafe(F.col("of")))
    copies = rows.select("row", _copies().alias("n")).where("n > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")

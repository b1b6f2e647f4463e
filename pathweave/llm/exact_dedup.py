"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text, A-Z lower-cased, is cut into blocks of ``BLOCK`` characters. Equal blocks get one integer name, equal pairs of
adjacent names get one name on the next level, until every document has a single name: equal names are equal texts, with
no hash to collide. A block (or pair) that occurs once gets no name, as the document that holds it has no copy.

Leading blocks are named first, with the length of the text, from a table of one leading block per document. Only
documents that share both with another one have all their blocks cut, shuffled and named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.text import lower_ascii
from pathweave.session import settle, store

#: Characters in a block.
BLOCK = 256


def _cut(text: Column) -> Column:
    """Blocks of a text in order; an empty text has none."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def _names(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """An integer for each combination of ``keys`` that occurs more than once.

    Counting combines before the shuffle, so a frequent combination is one row per task. The number follows from the
    sorted order inside its partition: a task that is run again gives the same one.
    """
    counted = rows.groupBy(*keys).agg(F.sum("_times").alias("_n")).where("_n > 1")
    return counted.drop("_n").sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with the names of their ``keys``, null for a combination that occurs once.

    A hash of the keys joins too: the names, few and counted by the keys alone, are then dealt out anew like the rows,
    and where both sides are dealt out for the join, adaptive execution splits the rows of a frequent combination.
    """
    names = _names(rows, keys, name).withColumn("_key", F.xxhash64(*keys))
    return rows.withColumn("_key", F.xxhash64(*keys)).join(names, ["_key", *keys], "left").drop("_key")


def _deep_names(docs: DataFrame) -> DataFrame:
    """``(_id, _sha, _name)`` of each distinct document of ``(_id, _text)``; no name: it has no copy."""
    cut = docs.select("_id", lower_ascii(F.col("_text")).alias("_text"))
    cut = cut.select("_id", F.unhex(F.sha2("_text", 256)).alias("_sha"), F.posexplode(_cut(F.col("_text"))).alias("_at", "_block"))
    cut = cut.withColumn("_times", F.lit(1))
    rows = _named(cut, ["_block"], "_name").select("_id", "_sha", "_at", "_times", "_name")
    rows, seen = settle(rows, last=F.max("_at"))
    while seen["last"]:
        side = F.when(F.col("_at") % 2 == 0, F.lit(0)).otherwise(1)
        pairs = rows.groupBy("_id", "_sha", F.floor(F.col("_at") / 2).alias("_at")).agg(
            F.max(F.when(side == 0, F.col("_name"))).alias("_left"),
            # a last block without a neighbour
            F.coalesce(F.max(F.when(side == 1, F.col("_name"))), F.lit(-1)).alias("_right"),
            F.bool_or(F.col("_name").isNull()).alias("_alone"),
            # repeated rows of one document become one row that counts for them
            F.sum(F.when(side == 0, F.col("_times"))).alias("_times"),
        )
        # a level joins pairs with names made from them: a written table, whose size estimate is that of its files
        pairs, seen = store(pairs, "pairs", last=F.max("_at"))
        # an unnamed part leaves no pair to look up
        named = _named(pairs.where("not _alone"), ["_left", "_right"], "_name")
        alone = pairs.where("_alone").withColumn("_name", F.lit(None).cast("long"))
        rows = named.unionByName(alone).select("_id", "_sha", "_at", "_times", "_name")
    return rows.select("_id", "_sha", "_name")


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id`` (of the row that stays), ``group_size``, ``kept``,
    ``text_sha256`` (of the normalised text).

    Of equal texts the row with the largest key stays; of rows with that key one, whichever. A null text is empty, and
    empty texts are equal; very long ones are compared whole. A null key loses to any other and gives a null ``keep_id`` only where the whole group has
    none. Other columns are not read. An empty table gives an empty one.
    """
    base = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    size = F.coalesce(F.length("_text"), F.lit(0))
    # the leading block from a few more characters than it has: lower-casing A-Z keeps lengths
    head = lower_ascii(F.substring("_text", 1, BLOCK))
    slim, _ = settle(base.select(
        F.monotonically_increasing_id().alias("_row"), "_id", size.alias("_size"), head.alias("_head"),
        F.unhex(F.sha2(lower_ascii(F.col("_text")), 256)).alias("_sha")))
    slim = slim.withColumn("_times", F.lit(1))
    named = _named(slim, ["_size", "_head"], "_first")
    named, _ = settle(named.select("_row", "_id", "_size", "_sha", "_first"))

    more = (F.col("_size") > BLOCK) & F.col("_first").isNotNull()
    wanted = named.where(more).select(F.col("_id").alias("_wanted"), F.col("_size").alias("_long")).distinct()
    long = base.where(F.length("_text") > BLOCK)
    long = long.join(wanted, F.col("_id").eqNullSafe(F.col("_wanted")) & (F.length("_text") == F.col("_long")), "left_semi")
    deep = _deep_names(long).select(F.col("_id").alias("_deep_id"), F.col("_sha").alias("_deep_sha"), F.col("_name").alias("_deep"))
    found = named.where(more).join(deep, F.col("_id").eqNullSafe(F.col("_deep_id")) & (F.col("_sha") == F.col("_deep_sha")), "left")
    found = found.select("_row", "_id", "_sha", F.lit(1).alias("_kind"), F.col("_deep").alias("_name"))
    rest = named.where(~more).select("_row", "_id", "_sha", F.lit(0).alias("_kind"), F.col("_first").alias("_name"))
    rows, _ = settle(found.unionByName(rest))

    groups = rows.where(F.col("_name").isNotNull()).groupBy("_kind", "_name").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_top"))
    groups, _ = settle(groups)
    joined = rows.join(groups, ["_kind", "_name"], "left")
    copied = F.col("_n").isNotNull()
    return joined.select(
        F.col("_id").alias(key),
        F.when(copied, F.col("_top._id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.when(copied, F.col("_top._row") == F.col("_row")).otherwise(True).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows that repeat key and text are one document: one of them stays.
    """
    kept = exact_duplicates(docs, text, key).where("kept").select(F.col(key).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    kept, _ = settle(kept)
    repeated, seen = settle(docs.groupBy(F.col(key).alias("_rep")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_rep"))
    keys = kept.select("_kept_id").distinct()

    def among(rows: DataFrame, table: DataFrame, column: str, how: str) -> DataFrame:
        return rows.join(table, rows[key].eqNullSafe(table[column]), how)

    # without a repeated key the key alone finds the row, and the text needn't be hashed again
    if not seen["rows"]:
        return among(docs, keys, "_kept_id", "left_semi")
    once = among(among(docs, repeated, "_rep", "left_anti"), keys, "_kept_id", "left_semi")
    several = among(docs, repeated, "_rep", "left_semi")
    hashed = several.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_id"), F.sha2(lower_ascii(F.col(text)), 256).alias("_sha"))
    hashed = hashed.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
    return once.unionByName(hashed.dropDuplicates(["_id", "_sha"]).select("row.*"))

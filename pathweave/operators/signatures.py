"""Label signatures of id blocks: which labels leave any node of block ``id >> level``. Long form, one row a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.operators.fragments import node_set
from pathweave.session import settle, small
from pathweave.sources.text import SUBTREE, folders_of, in_folders


# Levels that one step between blocks and ids takes.
STEP_BITS = 10
# Levels that one step of a descent takes.
STRIDE = 5


def signature_build(edges: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """``(level, block, label)`` for ``levels``, by default 0 to the whole logarithm of the number of nodes.

    Edges are reduced to distinct ``(src, label)`` and dealt out by blocks of ``STEP_BITS`` levels, once: all levels up to
    there are then made in place, a block lying in one partition with all it consists of. There the blocks of a label are
    put in order, so that a block is new on just those levels on which the one before lies in another, and no table of
    blocks is held. Levels above are made from the distinct rows of the last one, a small part, in the same way.
    """
    if levels is None:
        # the length in bits, which unlike a floating logarithm is exact at powers of two
        levels = list(range(node_set(edges).agg(F.length(F.bin(F.count(F.lit(1))))).first()[0]))
    rows, base, made = edges.select(F.col("src").alias("block"), "label").distinct(), 0, None
    while levels:
        here = [k for k in levels if k <= base + STEP_BITS]
        levels = [k for k in levels if k > base + STEP_BITS]
        rows = rows.withColumn("_top", F.shiftright("block", STEP_BITS)).repartition("_top")
        wanted = sorted(set(here) | ({base + STEP_BITS} if levels else set()))
        blocks = _new_blocks(rows, wanted, base)
        own = blocks.where(F.col("level").isin(here)).select("level", "block", "label")
        made = own if made is None else made.unionByName(own)
        base += STEP_BITS
        rows = blocks.where(F.col("level") == base).select("block", "label")
    return made


def _new_blocks(rows: DataFrame, levels: list[int], base: int) -> DataFrame:
    """Distinct ``(level, block, label)`` for ``rows`` ``(_top, block, label)`` of level ``base``, none of them twice."""
    before = F.lag("block").over(Window.partitionBy("_top", "label").orderBy("block"))

    def within(block: str, level: Column) -> Column:
        return F.call_function("shiftright", F.col(block), level - base)

    def new(level: Column) -> Column:
        return F.col("_before").isNull() | (within("block", level) != within("_before", level))

    started = F.explode(F.filter(F.array(*map(F.lit, levels)), new)).alias("level")
    rows = rows.withColumn("_before", before).select("block", "label", started)
    return rows.select("level", within("block", F.col("level")).alias("block"), "label")


def signature_lookup(signatures: DataFrame, level: int, groups: list[list]) -> DataFrame:
    """Blocks of ``level`` with at least one label of every group (groups of one label each ask for all labels).

    A level that the index lacks is put together from the coarsest finer one it has; without any, nothing could be
    told from the index, which is an error.
    """
    found = signatures.where(F.col("level") <= level).agg(F.max("level")).first()[0]
    if found is None:
        raise ValueError(f"the index has no level up to {level}")
    return _with_groups(_of_level(signatures, found, groups).withColumn("block", F.shiftright("block", level - found)), groups)


def _of_level(signatures: DataFrame, level: int, groups: list[list]) -> DataFrame:
    return signatures.where((F.col("level") == level) & F.col("label").isin(sorted({x for g in groups for x in g})))


def _with_groups(rows: DataFrame, groups: list[list]) -> DataFrame:
    has = [F.bool_or(F.col("label").isin(g)).alias(f"g{i}") for i, g in enumerate(groups)]
    found = rows.groupBy("block").agg(*has)
    for i in range(len(groups)):
        found = found.where(F.col(f"g{i}"))
    return found.select("block")


def signature_descent(signatures: DataFrame, level: int, groups: list[list], stride: int = STRIDE) -> DataFrame:
    """The blocks of :func:`signature_lookup`, found from the coarsest level of the index down.

    A block has every label of the blocks inside it, so below a block that lacks a group nothing can qualify: a level is
    read only under the blocks kept ``stride`` levels above. Of an index written by ``store_signatures``, a level below
    ``SUBTREE`` is read only in the folders of the kept subtrees. A level that the index lacks is put together as
    :func:`signature_lookup` does.
    """
    held = [r[0] for r in signatures.select("level").distinct().collect()]  # one number a level
    if not [k for k in held if k <= level]:
        raise ValueError(f"the index has no level up to {level}")
    above = sorted((k for k in held if k > level), reverse=True)
    # the coarsest level, one in every stride below it, and the one whose blocks are the folders' subtrees
    path = [k for i, k in enumerate(above) if i % stride == 0 or k == SUBTREE]
    last = level if level in held else max(k for k in held if k <= level)
    kept, upper, seen = None, None, {}
    for here in [*path, last]:
        rows = _of_level(signatures, here, groups)
        if kept is not None:
            if here < SUBTREE and upper <= SUBTREE:
                rows = in_folders(rows, seen)
            # kept blocks are distinct, each the parent of a range of blocks here
            parents = small(kept.withColumnRenamed("block", "_parent"), seen)
            rows = rows.join(parents, F.shiftright("block", upper - here) == F.col("_parent"), "left_semi")
        if here == last:
            return _with_groups(rows.withColumn("block", F.shiftright("block", level - last)), groups)
        kept = _with_groups(rows, groups)
        folders = folders_of(F.shiftright("block", SUBTREE - here), signatures) if here <= SUBTREE else {}
        kept, seen = settle(kept, **folders)
        upper = here


def block_ids(blocks: DataFrame, level: int) -> DataFrame:
    """Node ids of the blocks: ``block << level`` up to the next block, written out ``STEP_BITS`` levels at a time, so
    that no row lists more than ``2^STEP_BITS`` ids and large blocks are dealt out between steps."""
    ids = blocks.select(F.col("block").alias("node"))
    while level:
        bits = min(level, STEP_BITS)
        below = F.shiftleft("node", bits)
        ids = ids.select(F.explode(F.sequence(below, below + ((1 << bits) - 1))).alias("node"))
        level -= bits
        if level:
            ids = ids.repartition("node")
    return ids


def in_blocks(edges: DataFrame, blocks: DataFrame, level: int) -> DataFrame:
    """Edges whose source lies in one of the blocks, without listing the blocks' ids."""
    inside = F.shiftright("src", level) == F.col("_block")
    return edges.join(blocks.withColumnRenamed("block", "_block"), inside, "left_semi")

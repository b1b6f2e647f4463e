"""A Merkle manifest of a dataset, with proofs by octopus multiproofs.

Every row is a leaf. The leaves of a group (language), in order of their keys, form a tree of ``ARITY``; the groups' roots,
in order of the groups, form one more. A proof of a leaf is the siblings on its way to the root of all.

Positions come from one distributed sort. A leaf partition is ``8^5`` neighbouring leaves of a tree. Digests of its own
subtree are derived inside its task; only their tops go on, so that a tree over any number of leaves takes a few passes,
each over a small part of the one before. For the proofs a partition works out the smallest set of nodes that the proofs of
its leaves need and that its leaves can't give (``missing``): it fetches them once, derives all interiors that its proofs
share, and expands every proof from what it then holds. Nothing but counts of groups is ever broadcast.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.rank import global_rank
from pathweave.llm.text import lower_ascii
from pathweave.llm.workers import reachable
from pathweave.session import settle, small

#: Children of a node, and levels of a tree that one pass derives: a leaf partition has ``ARITY ** DEPTH`` leaves at most.
ARITY = 8
DEPTH = 5
_BITS = ARITY.bit_length() - 1

#: The columns of a leaf, in the order in which they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: list[Column]) -> Column:
    """Hexadecimal SHA-256 of the columns' texts, each with its length in bytes before it, or ``-`` for a null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n = -(-n // ARITY)
        levels += 1
    return levels


def parents(digests: list[str]) -> list[str]:
    """One level up: each run of ``ARITY`` neighbours becomes its hash."""
    return [sha256("".join(digests[i:i + ARITY]).encode()).hexdigest() for i in range(0, len(digests), ARITY)]


def missing(held: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The fewest nodes ``(level, index)`` that the proofs of the leaves ``held`` (sorted) of ``n`` need besides what these
    leaves give: on each level the brothers of known nodes that are not known themselves."""
    out, level = [], 0
    known = np.unique(held)
    while n > 1:
        runs = np.unique(known >> _BITS)
        brothers = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        brothers = brothers[brothers < n]
        out += [(level, int(i)) for i in np.setdiff1d(brothers, known, assume_unique=True)]
        known, n, level = runs, -(-n // ARITY), level + 1
    return out


def expand(leaves: dict[int, tuple[str, str | None]], fetched: dict[tuple[int, int], str], n: int):
    """For each of the leaves ``position -> (digest, other digest)``: its position, its siblings level by level, and the
    root recomputed from the other digest, or its own without one.

    ``fetched`` holds the ``missing`` nodes. Interiors are derived once and shared by all proofs of the partition.
    """
    levels, size = [{i: digest for i, (digest, _) in leaves.items()}], n
    for level in range(height(n)):
        here = levels[-1]
        here.update({i: d for (at, i), d in fetched.items() if at == level})
        runs = sorted({i >> _BITS for i in here})
        # a run that is wholly here gives its parent; others are fetched on the next level if any proof needs them
        full = [r for r in runs if all(i in here for i in range(r * ARITY, min(r * ARITY + ARITY, size)))]
        size_up = -(-size // ARITY)
        levels.append({r: sha256("".join([here[i] for i in range(r * ARITY, min(r * ARITY + ARITY, size))]).encode()).hexdigest() for r in full})
        size = size_up
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    for position, (digest, other) in leaves.items():
        siblings, folded, i = [], other or digest, position
        for level in range(height(n)):
            first = i >> _BITS << _BITS
            run = [levels[level][j] for j in range(first, min(first + ARITY, sizes[level]))]
            at = i - first
            siblings += run[:at] + run[at + 1:]
            run[at] = folded
            folded = sha256("".join(run).encode()).hexdigest()
            i >>= _BITS
        yield position, siblings, folded


# -- streams of rows sorted by group -----------------------------------------------------------------------------------


def _groups(batches, keys: int):
    """``(key, table)`` of rows that come sorted by their first ``keys`` columns; a group may span batches."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            key = tuple(c[begin] for c in columns)
            if current is not None and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield current, pa.Table.from_batches(held)


def _subtrees(depth: int):
    def derive(batches):
        """Nodes above the leaves of each block ``(tree, block, position, digest, size)``."""
        for (tree, block), rows in _groups(batches, 2):
            digests, size = rows.column(3).to_pylist(), rows.column(4)[0].as_py()
            levels, indexes, out = [], [], []
            first = int(block) << (_BITS * depth)
            for level in range(1, min(depth, height(size)) + 1):
                digests = parents(digests)
                first >>= _BITS
                levels += [level] * len(digests)
                indexes += range(first, first + len(digests))
                out += digests
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(out), pa.string()), pa.array(levels, pa.int32()), pa.array(indexes, pa.int64()), pa.array(out, pa.string())],
                names=["tree", "level", "position", "digest"])

    return derive


def _tree_nodes(leaves: DataFrame, most: int) -> DataFrame:
    """``(tree, level, position, digest)`` of all nodes above ``leaves`` ``(tree, position, digest, size)``, ``size`` being
    the number of leaves of the tree, at most ``most``."""
    found, base, rows = None, 0, leaves
    while True:
        blocks = rows.select("tree", F.shiftright("position", _BITS * DEPTH).alias("block"), "position", "digest", "size")
        blocks = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
        nodes = reachable(blocks).mapInArrow(_subtrees(DEPTH), "tree string, level int, position long, digest string")
        nodes, _ = settle(nodes)
        above = nodes.withColumn("level", F.col("level") + base)
        found = above if found is None else found.unionByName(above)
        if most <= ARITY ** DEPTH:
            return found
        base, most = base + DEPTH, -(-most // ARITY ** DEPTH)
        # trees that have not reached their root go on with the tops of their blocks
        tops = nodes.where(F.col("level") == DEPTH).select("tree", "position", "digest")
        counts = tops.groupBy("tree").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        counts, seen = settle(counts)
        rows = tops.join(small(counts, seen), "tree")


def _trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Of ``leaves`` ``(tree, position, digest)``: ``(tree, size, root)`` of each tree, their nodes above the leaves, and
    what was measured of the first table."""
    sizes, seen = settle(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), most=F.max("size"))
    most = seen["most"] or 0
    nodes = _tree_nodes(leaves.join(small(sizes, seen), "tree"), most)
    every = leaves.select("tree", F.lit(0).alias("level"), "position", "digest").unionByName(nodes)
    # a root has position 0 on the highest level of its tree
    tops = every.where("position = 0").groupBy("tree").agg(F.max(F.struct("level", "digest")).alias("top"))
    roots, seen = settle(sizes.join(tops, "tree").select("tree", "size", F.col("top.digest").alias("root")))
    return roots, nodes, seen


def _proofs(wanted: DataFrame, leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Proofs inside their trees of ``wanted`` ``(tree, position, digest, other, size, key)``: ``(tree, key, digest,
    siblings, folded)``, the siblings joined in one string.

    A leaf partition asks for its missing nodes once, in one row each; the answers join it in the order of its rows.
    """
    block = F.shiftright("position", _BITS * DEPTH).alias("block")
    asked = wanted.select("tree", block, "position", "size").repartition("tree", "block").sortWithinPartitions("tree", "block", "position")

    def ask(batches):
        for (tree, number), rows in _groups(batches, 2):
            need = missing(rows.column(2).to_numpy(), rows.column(3)[0].as_py())
            n = len(need)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array([x for x, _ in need], pa.int32()), pa.array([x for _, x in need], pa.int64())],
                names=["tree", "block", "level", "position"])

    requests, seen = settle(reachable(asked).mapInArrow(ask, "tree string, block long, level int, position long"), lowest=F.min("level"))
    every = leaves.select("tree", F.lit(0).alias("level"), "position", "digest").unionByName(nodes)
    # partitions that want all their leaves ask for nothing on low levels, which then aren't read
    answers = requests.join(every.where(F.col("level") >= (seen["lowest"] or 0)), ["tree", "level", "position"])
    kind = wanted.schema["key"].dataType.simpleString()
    rows = wanted.select("tree", block, F.lit(-1).alias("level"), "position", "digest", "other", "size", "key").unionByName(
        answers.select("tree", "block", "level", "position", "digest", F.lit(None).cast("string").alias("other"), F.lit(0).cast("long").alias("size"), F.lit(None).cast(kind).alias("key")))
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "level", "position")

    def prove(batches):
        for (tree, _), table in _groups(batches, 2):
            level, position = table.column(2).to_pylist(), table.column(3).to_pylist()
            digest, other, size = table.column(4).to_pylist(), table.column(5).to_pylist(), table.column(6)[0].as_py()
            own = level.count(-1)  # they come first, in the order of their positions
            held = {position[i]: (digest[i], other[i]) for i in range(own)}
            fetched = {(level[i], position[i]): digest[i] for i in range(own, len(level))}
            keys, out, at = table.column(7).combine_chunks(), [], 0
            for _, siblings, folded in expand(held, fetched, size):
                out.append(("".join(siblings), folded))
                if len(out) == 2048 or at + len(out) == own:
                    n = len(out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree] * n, pa.string()), keys.slice(at, n), pa.array(digest[at:at + n], pa.string()), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())],
                        names=["tree", "key", "digest", "siblings", "folded"])
                    at, out = at + n, []

    return reachable(rows).mapInArrow(prove, f"tree string, key {kind}, digest string, siblings string, folded string")


# -- the manifest ------------------------------------------------------------------------------------------------------


def tampered(key: Column) -> Column:
    """Rows whose text the check changes: 3 divides the CRC-32 of the key as text."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 0, F.lit(False))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", text: str = "text", change: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot`` (of its group), ``root``, ``proof`` (its siblings from
    the leaf to the root, joined) and ``folded_root``, the root recomputed with them from the leaf, or, where ``change``
    holds, from the leaf with ``text`` lower-cased (A-Z).

    Keys ascend, null first; rows of one key follow each other by their leaves, so that equal rows may change places and
    nothing else. Null is a group of its own, the first; a null in any column is hashed as ``-``; texts of any length are
    hashed whole, and an empty one is not a null one. A group of one row has its leaf as root, and no siblings in it. Other
    columns are not read. An empty table gives an empty one.
    """
    named = [F.col(c) for c in columns]
    low = [F.when(F.col(c).isNotNull(), lower_ascii(F.col(c))) if c == text else F.col(c) for c in columns]
    change = tampered(F.col(key)) if change is None else change
    # no null, and in the order of the groups
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own, _ = settle(docs.select(F.col(key).alias("key"), tree.alias("tree"), leaf_digest(named).alias("digest"), F.when(change, leaf_digest(low)).alias("other")))
    ranked, _ = settle(global_rank(own, ["tree", F.col("key").asc_nulls_first(), "digest"], "_at"))
    firsts, seen = settle(ranked.groupBy("tree").agg(F.min("_at").alias("_first")))
    leaves = ranked.join(small(firsts, seen), "tree").select("key", "tree", (F.col("_at") - F.col("_first")).alias("position"), "digest", "other")
    bare = leaves.select("tree", "position", "digest")
    roots, nodes, held = _trees(bare)
    wanted = leaves.join(small(roots.select("tree", "size"), held), "tree")
    inside = _proofs(wanted, bare, nodes)

    # the tree over the groups' roots, whose leaves are all wanted too
    upper = global_rank(roots.select(F.col("tree").alias("key"), F.col("root").alias("digest")), ["key"], "position").withColumn("tree", F.lit(""))
    upper, count = settle(upper)
    flat = upper.select("tree", "position", "digest")
    top, top_nodes, _ = _trees(flat)
    all_in = upper.withColumn("other", F.lit(None).cast("string")).join(F.broadcast(top.select("tree", "size")), "tree")  # one row
    over = _proofs(all_in, flat, top_nodes).select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), F.col("siblings").alias("above"), F.col("folded").alias("root"))
    over, seen = settle(over.join(upper.select(F.col("key").alias("tree"), F.col("position").alias("place")), "tree"))

    proofs = inside.join(small(over, seen), "tree")
    # a changed subroot is folded on with the siblings above it
    folded_root = F.when(F.col("folded") == F.col("subroot"), F.col("root")).otherwise(_fold_on("folded", "above", "place", count["rows"]))
    return proofs.select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", F.concat("siblings", "above").alias("proof"), folded_root.alias("folded_root"))


def _fold_on(digest: str, siblings: str, place: str, n: int) -> Column:
    """The root of a tree of ``n`` leaves from the leaf ``digest`` at ``place`` and its siblings, in one string."""
    out, used = F.col(digest), F.lit(0)
    position, size = F.col(place), n
    while size > 1:
        at = position.bitwiseAND(ARITY - 1)
        run = F.least(F.lit(ARITY), F.lit(size) - (position - at))
        left = F.substring(F.col(siblings), (used + 1).cast("int"), (at * 64).cast("int"))
        right = F.substring(F.col(siblings), (used + at * 64 + 1).cast("int"), ((run - 1 - at) * 64).cast("int"))
        out = F.sha2(F.concat(left, out, right), 256)
        used = used + (run - 1) * 64
        position, size = F.shiftright(position, _BITS), -(-size // ARITY)
    return out


def proof_report(docs: DataFrame) -> DataFrame:
    """The manifest with ``proof_sha256`` in place of the siblings, and ``verified``: does the recomputed root agree?"""
    rows = manifest(docs)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Near duplicates by SimHash, compared bit-sliced.

A document's fingerprint has bit ``i`` set where more than half of its word shingles' 64-bit hashes have it set.
Fingerprints that differ in at most ``RADIUS`` bits are linked; a document's class is all it can reach.

Distinct fingerprints are gathered by keys such that two of a link share one: cut into ``RADIUS + 1`` parts of 16 bits,
one part is equal, and of the other 48 bits, cut into as many parts again, one more is equal. A key so holds 28 bits and
names its parts, and each fingerprint has 16 keys, so that groups stay small far beyond 2^28 documents. A crowded key is
cut into shares, and each pair of shares is one task's work.

Inside a group the comparison is bit-sliced: plane ``i`` holds bit ``i`` of 64 fingerprints in a machine word. Against a
pivot the planes give mismatch words, which carry-save counters of three bits add up for 64 fingerprints at a time;
blocks of words whose fingerprints have all passed the radius are left alone from then on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pathweave.llm.components import components
from pathweave.llm.workers import each_text, reachable
from pathweave.session import settle

#: Words in a shingle, and bits in which linked fingerprints may differ.
SHINGLE = 3
RADIUS = 3
#: Fingerprints of a key that one task holds at once.
SHARE = 16_384
#: Words of 64 fingerprints in a block that is left alone as a whole.
BLOCK_WORDS = 64


def fingerprint_of(text: bytes | None) -> int:
    """The fingerprint as a signed integer; 0 without a word."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[SHINGLE - 1:] if len(words) > SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), last.tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i:i + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


_LOWER = bytes(range(256)).lower()


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t) for t in each_text(texts)], pa.int64())


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a long."""
    return reachable(docs).withColumn(name, _fingerprint(F.col(text)))


# -- comparison inside a task ------------------------------------------------------------------------------------------


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes ``(64, words)`` of fingerprints: bit ``k`` of word ``w`` in plane ``i`` is bit ``i`` of number 64w+k."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(planes: np.ndarray, pivot: int, alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the ``alive`` fingerprints (bit words) differ from ``pivot`` in at most ``radius`` (3 or less) bits."""
    within = alive.copy()
    todo = np.flatnonzero(alive)  # words with anything to compare
    one, two, four = (np.zeros(len(todo), np.uint64) for _ in range(3))
    for i in range(64):
        x = planes[i, todo]
        if pivot >> i & 1:
            x = ~x
        carry = one & x
        one ^= x
        x = two & carry
        two ^= carry
        four |= x  # four or more: passed for good
        if i % 8 == 7 and i < 63:
            left = within[todo] & ~four
            blocks = np.arange(len(todo)) // BLOCK_WORDS if len(todo) > 4 * BLOCK_WORDS else np.arange(len(todo))
            live = np.zeros(blocks[-1] + 1 if len(blocks) else 0, bool)
            np.logical_or.at(live, blocks, left != 0)
            stay = live[blocks]
            if not stay.all():
                within[todo[~stay]] = 0
                todo, one, two, four = todo[stay], one[stay], two[stay], four[stay]
                if not len(todo):
                    return within
    over = four
    if radius < 3:
        over = over | (two & one) if radius == 2 else over | two if radius == 1 else over | two | one
    within[todo] &= ~over
    return within


def _lowest(word: int) -> int:
    return (word & -word).bit_length() - 1


def _numbers(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def linked_large(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``values``: breadth first from each fingerprint not reached yet.

    Only fingerprints that nothing has reached are compared with a pivot, so a dense group costs few comparisons.
    """
    planes = planes_of(values)
    alive = np.zeros(planes.shape[1] * 64, bool)
    alive[: len(values)] = True
    alive = np.packbits(alive, bitorder="little").view(np.uint64)
    froms, tos = [], []
    start = 0
    while True:
        words = np.flatnonzero(alive[start:])
        if not len(words):
            break
        start += int(words[0])
        first = start * 64 + _lowest(int(alive[start]))
        alive[start] &= ~np.uint64(1 << (first % 64))
        queue = [first]
        while queue:
            at = queue.pop()
            found = near(planes, int(values[at]), alive)
            new = _numbers(found)
            if len(new):
                alive &= ~found
                froms.append(np.full(len(new), values[at]))
                tos.append(values[new])
                queue.extend(new.tolist())
    none = np.zeros(0, np.uint64)
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (none, none)


def linked_small(values: np.ndarray, group: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of many small groups lying one after the other, at most ``longest`` fingerprints in each: neighbours at
    distance 1, then 2 and so on, are compared for all groups at once on shifted planes."""
    froms, tos = [], []
    for shift in range(1, longest):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(same):
            break
        left, right = values[same], values[same + shift]
        planes = planes_of(left ^ right)
        alive = np.zeros(planes.shape[1] * 64, bool)
        alive[: len(same)] = True
        hit = _numbers(near(planes, 0, np.packbits(alive, bitorder="little").view(np.uint64)))
        froms.append(left[hit])
        tos.append(right[hit])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (none, none)


#: Groups up to this size are compared side by side.
SMALL = 24


def _links_of(batches):
    """Links of the groups (lists of distinct fingerprints) in record batches."""
    for batch in batches:
        lists = batch.column(0)
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        few = np.repeat(sizes <= SMALL, sizes)
        pairs = [linked_small(values[few], group[few], SMALL)]
        pairs += [linked_large(values[e - n:e]) for e, n in zip(ends[sizes > SMALL], sizes[sizes > SMALL])]
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


# -- candidates --------------------------------------------------------------------------------------------------------


def _keys(fp: str):
    """The 16 keys of a fingerprint, as longs: 28 of its bits, and which parts they are."""
    out = []
    for i in range(4):
        part = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = F.col(fp).bitwiseAND((1 << (16 * i)) - 1)
        high = F.shiftrightunsigned(F.shiftrightunsigned(fp, 16 * i), 16)
        rest = low.bitwiseOR(F.shiftleft(high, 16 * i))
        for j in range(4):
            more = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            out.append(F.shiftleft(part, 16).bitwiseOR(F.shiftleft(more, 4)).bitwiseOR(F.lit(4 * i + j)))
    return F.array(*out)


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the distinct longs ``fp``: all, or of a dense group as many as keep it together."""
    keyed = distinct.select("fp", F.explode(_keys("fp")).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts, _ = settle(counts)  # so that the join deals out both sides and frequent keys can be split
    shared = keyed.join(counts, "key")
    shares = F.ceil(F.col("n") / SHARE)
    shared = shared.withColumn("shares", shares).withColumn("share", F.pmod(F.xxhash64("fp"), "shares"))
    # each pair of shares meets once; one share alone is one cell
    cells = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda o: F.struct(F.least("share", o).alias("x"), F.greatest("share", o).alias("y")))
    cells = shared.select("key", "fp", F.explode(cells).alias("cell"))
    groups = cells.groupBy("key", "cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return reachable(groups).select("fps").mapInArrow(_links_of, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest key in the
    class of the row, null only where the class has none).

    A null text and one without a word have fingerprint zero and are linked like others; very long texts are hashed whole;
    repeated rows share a class.
    Other columns are not read; an empty table gives an empty one.
    """
    marked, _ = settle(fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", "fp").select("id", "fp"))
    smallest, _ = settle(marked.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(links(smallest.select("fp")))
    classed = smallest.join(roots, smallest.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    classed, _ = settle(classed)
    least, _ = settle(classed.groupBy("root").agg(F.min("id").alias("component_id")))
    named = classed.select("fp", "root").join(least, "root").select("fp", "component_id")
    full = marked.join(named, "fp", "left")
    return full.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with the smallest key of their class, with all their columns; all rows of that key if it is
    repeated or null with its class."""
    kept = near_duplicates(docs, text, key).where(F.col(key).eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col(key).alias("_kept_id")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept_id"]), "left_semi")

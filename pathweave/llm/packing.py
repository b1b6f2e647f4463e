"""Packing documents into sequences of ``LENGTH`` tokens by patterns fitted with non-negative least squares.

Documents become pieces of at most ``LENGTH`` tokens. Only the histogram of piece lengths reaches the driver, ``LENGTH``
numbers at most. There all patterns of two or three lengths that fill a sequence are enumerated, lengths rounded up to
steps of ``STEP``; least squares finds how often to repeat each so that they use up the histogram; repeats are rounded
down. What the patterns leave over is packed best-fit-decreasing, on counts of lengths too. Both give intervals of the
pieces' global order by length, so each piece finds its sequence by its position in that order, wherever it lies.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pathweave.functions.rank import global_rank
from pathweave.llm.tokens import memory
from pathweave.llm.workers import each_text, reachable
from pathweave.session import settle

#: Tokens in a sequence, the id that ends a document, and the step to which patterns round lengths up.
LENGTH = 2048
END = 0
STEP = 4


# -- pieces ------------------------------------------------------------------------------------------------------------


def _pieces_type(with_ids: bool) -> ArrayType:
    fields = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    return ArrayType(StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * with_ids))


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", with_ids: bool = False, length: int = LENGTH) -> DataFrame:
    """``docs`` with one row per piece and the columns ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted,
    ``ids`` (as signed integers). ``tokenizer`` is a file that all executors have. A null text counts as empty; an
    empty document is one piece of its end token."""

    @F.arrow_udf(_pieces_type(with_ids))
    def cut(texts: pa.Array) -> pa.Array:
        known = memory(tokenizer)
        end = np.array([END], "<u4").tobytes()
        counts, starts, crcs, lengths, ids = [0], [], [], [], []
        for t in each_text(texts):
            own = known.ids(t or b"") + end
            for at in range(0, len(own), 4 * length):
                part = own[at:at + 4 * length]
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                crcs.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<i4"))
            counts.append(len(starts))
        columns = [pa.array([s // length for s in starts], pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
        names = ["piece", "start", "length", "ids_crc32"]
        if with_ids:
            flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat, pa.int32())))
            names.append("ids")
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(columns, names))

    kept = [c for c in docs.columns if c != text]
    return reachable(docs).select(*kept, F.explode(cut(F.col(text))).alias("_piece")).select(*kept, "_piece.*")


# -- the plan, on the histogram ----------------------------------------------------------------------------------------


def patterns(units: int) -> np.ndarray:
    """All ways to fill ``units`` with two or three lengths, as rows of three with 0 for none."""
    two = [(a, units - a, 0) for a in range(units - 1, (units - 1) // 2, -1) if a >= units - a > 0]
    three = [(a, b, units - a - b) for a in range(1, units) for b in range(1, a + 1) if 0 < units - a - b <= b]
    return np.array(two + three, np.int64).reshape(-1, 3)


def nnls(columns: np.ndarray, b: np.ndarray, at_once: int = 16, rounds: int = 200) -> np.ndarray:
    """Non-negative ``x`` with least ``|a x - b|`` by active sets, for an ``a`` of counts: column ``j`` counts the numbers
    in ``columns[j]``, 0 for none. Columns that promise most enter, those that would turn negative leave."""
    x = np.zeros(len(columns))
    own = np.zeros(0, np.int64)
    scale = max(float(np.abs(b).max(initial=0)), 1.0)

    def dense(at):
        out = np.zeros((len(b), len(at)))
        np.add.at(out, (columns[at], np.arange(len(at))[:, None]), 1)
        out[0] = 0
        return out

    for _ in range(rounds):
        rest = b - dense(own) @ x[own]
        rest[0] = 0
        gain = rest[columns].sum(axis=1)
        gain[own] = 0
        best = np.argpartition(-gain, min(at_once, len(gain) - 1))[:at_once]
        best = best[gain[best] > max(1.0, 1e-4 * scale)]  # counts are whole: less isn't worth a column
        if not len(best):
            break
        own = np.sort(np.concatenate((own, best)))
        while len(own):
            a = dense(own)
            s = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(own)), a.T @ b)
            low = s <= 1e-9 * scale
            now = x[own]
            if not low.any():
                x[own] = s
                break
            falling = low & (now > s)
            t = min(1.0, (now[falling] / (now[falling] - s[falling])).min()) if falling.any() else 0.0
            now = np.maximum(now + t * (s - now), 0)
            gone = low & (now <= 1e-9 * scale)
            x[own] = np.where(gone, 0, now)
            own = own[~gone]
    return x


def plan(histogram: dict[int, int], length: int = LENGTH, step: int = STEP) -> tuple[np.ndarray, int]:
    """Intervals of the order of pieces from long to short, as rows ``(first, end, sequence, slot)``: the piece at ``k``
    goes to ``sequence + k - first``, before those of higher slots. And the number of sequences."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    place, at = {}, 0  # next unused position of each length
    for n, c in left.items():
        place[n], at = at, at + c
    out: list[tuple[int, int, int, int]] = []
    sequences = 0
    if c := left.pop(length, 0):
        out.append((place[length], place[length] + c, 0, 0))
        sequences = c

    units = length // step
    bins: dict[int, list[int]] = {}
    for n in left:
        bins.setdefault(-(-n // step), []).append(n)
    usable = patterns(units)
    usable = usable[[all(u == 0 or u in bins for u in p) for p in usable.tolist()]]
    if len(usable):
        b = np.zeros(units + 1)
        for u, ns in bins.items():
            b[u] = sum(left[n] for n in ns)
        x = nnls(usable, b)
        for p in np.argsort(-x, kind="stable"):
            need = [int(u) for u in usable[p] if u]
            repeat = int(min([x[p] + 1e-6] + [sum(left[n] for n in bins[u]) // need.count(u) for u in set(need)]))
            if repeat < 1:
                break
            for slot, u in enumerate(need):
                base, todo = sequences, repeat
                for n in bins[u]:
                    if k := min(todo, left[n]):
                        out.append((place[n], place[n] + k, base, slot))
                        place[n], left[n], base, todo = place[n] + k, left[n] - k, base + k, todo - k
            sequences += repeat

    # what is left: the longest first, each into the fullest sequence that still takes it
    rooms: list[tuple[int, int, int, int]] = []  # (free tokens, slot, first sequence, how many), by free tokens
    for n in left:
        while left[n]:
            i = bisect_left(rooms, (n, 0, 0, 0))
            if i < len(rooms):
                room, slot, first, count = rooms.pop(i)
                k = min(left[n], count)
                if k < count:
                    insort(rooms, (room, slot, first + k, count - k))
            else:
                room, slot, first, k = length, 0, sequences, -(-left[n] // (length // n))
                sequences += k
            out.append((place[n], place[n] + k, first, slot))
            place[n], left[n] = place[n] + k, left[n] - k
            insort(rooms, (room - n, slot + 1, first, k))
    return np.array(sorted(out), np.int64).reshape(-1, 4), sequences


# -- placing -----------------------------------------------------------------------------------------------------------


def _place(intervals: np.ndarray):
    kind = StructType([StructField("sequence", LongType()), StructField("slot", LongType())])

    @F.arrow_udf(kind)
    def place(at: pa.Array) -> pa.Array:
        k = at.to_numpy(zero_copy_only=False)
        rows = intervals[np.searchsorted(intervals[:, 0], k, side="right") - 1] if len(k) else intervals[:0]
        return pa.StructArray.from_arrays([pa.array(rows[:, 2] + k - rows[:, 0], pa.int64()), pa.array(rows[:, 3], pa.int64())], ["sequence", "slot"])

    return place


def pack(cut: DataFrame, order: list[str], length: int = LENGTH) -> DataFrame:
    """Pieces (with a ``length`` each) with ``sequence_id`` and ``offset``, the place in the sequence, without gaps.

    ``order`` names columns that tell pieces of one length apart, so that runs agree. An empty table gives an empty one.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `length` rows
    intervals, _ = plan(counts, length)
    ranked = global_rank(cut, [F.col("length").desc(), *order], "_at")
    placed = reachable(ranked).withColumn("_to", _place(intervals)(F.col("_at"))).drop("_at")
    # a sequence has at most `length` pieces
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("sequence_id", F.col("_to.sequence")).withColumn("_slot", F.col("_to.slot")).drop("_to")
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("_slot")


def packed(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs``: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset`` and, if wanted, the token ``ids``. A null text counts as empty; a very long one becomes many pieces, none is
    cut short. Repeated rows are documents of their own; other columns are not read. An empty table gives an empty one.
    """
    cut = pieces(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), tokenizer, "_text", with_ids)
    cut, _ = settle(cut)
    return pack(cut, ["_key", "piece", "ids_crc32"]).withColumnRenamed("_key", key)

"""Similarity join of texts by the Jaccard similarity of their word n-grams, with prefix trees.

A document is the set of its distinct n-grams. All sets are ordered alike, n-grams that few documents have first: the order
is a number of 64 bits, a class of frequency above a hash. Classes come from counters over all documents, as many at any size
of the corpus, so that what tasks share is bounded; a class that is off makes work, not errors.

Two sets of similarity ``t`` share an n-gram among the first ``n - ceil(t n) + 1`` of either one. Those of every set are
dealt out by n-gram, and sets meet there. Whether a meeting can be a link is told by lengths and by how much of either set is
left behind the meeting place, and by parities of hashed members, a filter that loses nothing: where many sets meet, before a
pair is made, and for all pairs then. What is left is decided
by tries: a task holds candidates of one set in a trie,
walks it with that set, frequent n-grams first, so that candidates share the overlap of what they have in common, and leaves
a subtree when what is left in it and in the set can't reach the similarity any more.

Only classes of linked documents are asked for. So sets meet by their least hashes first, a few times, at one member of each
group, which already joins copies at linear cost: first at the one whose rarest n-grams are the most frequent, the copy with
the fewest changes, which others are nearest to; then, by the whole prefix, sets of different classes meet. Equal sets are
one set all the way.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.components import components
from pathweave.llm.workers import each_text, reachable
from pathweave.session import settle, small, store

#: Words in a shingle, and the similarity in hundredths from which documents are linked.
SHINGLE = 5
PERCENT = 80
#: Counters of n-grams, and bits of a number that hold its hash; above them is its class of frequency.
COUNTERS = 1 << 22
HASH_BITS = 58
#: Least hashes by which sets meet first, and how often they do, each time at another member of their groups.
LEAST = 2
HUBS = 2
#: Sets of an n-gram that one task compares, by the estimate of its class, and rows of a block of that comparison.
SHARE = 4096
BLOCK = 1024
#: Class of frequency from which n-grams bring parities to where sets meet, and members of a set that does so at most: its
#: parities go with each n-gram of its prefix.
CROWDED = 5
MEMBERS = 1024
#: Candidates in one trie.
CANDIDATES = 256

_LOWER = bytes(range(256)).lower()
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)


# -- sets --------------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of ``HASH_BITS`` bits, sorted, of a text's n-grams; of a shorter text as a whole; none without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(own) < SHINGLE:
        # as long as it is; the length tells it from n-grams that begin alike
        joined = np.array([digest(b" ".join(words), len(words))], np.uint64)
    else:
        n = len(own) - SHINGLE + 1
        joined = own[:n] * _FACTORS[0]
        for i in range(1, SHINGLE):
            joined += own[i:i + n] * _FACTORS[i]
        joined = _mixed(joined)
    return np.unique(joined >> np.uint64(64 - HASH_BITS))


def identity(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of as many cells as the set has members, the next power of two: is their number in it odd? Where the
    bits of two sets differ, one has a member that the other lacks, so that their difference is no smaller."""
    cells = max(64, 1 << (len(hashes) - 1).bit_length())
    counts = np.bincount(((hashes >> np.uint64(24)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def needed(n: int) -> int:
    """N-grams of a set of ``n`` that any set linked with it shares: the least whole number of ``PERCENT`` hundredths."""
    return -(-PERCENT * n // 100)


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the common order: numbers with the class of frequency on top."""
    kind = classes[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((kind << np.uint64(HASH_BITS)) | hashes)


# -- classes of frequency ----------------------------------------------------------------------------------------------

#: Counters in a row of partial counts.
_SLICE = 1024


def _count(batches):
    """Of all texts of a task, how many have an n-gram of each counter, in slices."""
    counts, any_ = np.zeros(COUNTERS, np.int32), False
    for batch in batches:
        for text in each_text(batch.column(0)):
            at = (shingles(text) & np.uint64(COUNTERS - 1)).astype(np.int64)
            if len(at):
                any_ = True
                np.add.at(counts, at, 1)
    if any_:
        rows = counts.reshape(-1, _SLICE)
        used = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(used), 256):
            yield _slices(used[i:i + 256], rows[used[i:i + 256]])


def _slices(numbers, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(numbers, np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["slice", "counts"])


def _add(batches):
    """Sums of slices, however many rows a slice has."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[number] = sums.get(number, 0) + np.frombuffer(row, np.int32).astype(np.int64)
    if sums:
        yield _slices(list(sums), list(sums.values()))


def frequency_classes(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The class of each counter: the length in bits of what it counts above the common level of all counters.

    Counts are over all rows. The driver gets ``COUNTERS`` numbers, and tasks one byte for each.
    """
    slices = reachable(docs.select(text)).mapInArrow(_count, "slice int, counts binary").repartition("slice").mapInArrow(_add, "slice int, counts binary")
    counts = np.zeros((COUNTERS // _SLICE, _SLICE), np.int64)
    for row in slices.collect():  # COUNTERS numbers in all
        counts[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    above = np.maximum(counts.ravel() - int(np.median(counts)), 0)
    return np.ceil(np.log2(above + 1)).astype(np.uint8)


# -- tries -------------------------------------------------------------------------------------------------------------


def walk(probe: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which of ``sets`` are linked with ``probe``, by one walk through the trie of the sets. All run from the end of the
    common order to its beginning (frequent n-grams first), where near copies have long ways in common.

    The sorted sets are the trie: a set leaves the way of the one before it where they first differ. The overlaps along the
    present way are kept, and what is known up to a branch serves all sets behind it. A subtree is left where the overlap so
    far and the most that can still come, in the probe or in sets of a length that can be linked, are too few.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    rows = [sets[i] for i in order]
    shared = [0, *(_common(a, b) for a, b in zip(rows, rows[1:])), 0]
    n, found = len(probe), []
    shortest, longest = needed(n), 100 * n // PERCENT
    rising = ~probe  # numbers fall along a way, their complements rise
    overlaps = np.zeros(0, np.int64)  # of the present way, after each of its n-grams
    left = None  # depth of a subtree that was left: sets that share so much are in it
    for i, row in enumerate(rows):
        depth, after = shared[i], shared[i + 1]
        if left is not None and depth >= left:
            continue
        left = None
        fits = shortest <= len(row) <= longest
        # a set of another length is followed no further than the next one shares its way
        way = row[depth:] if fits else row[depth:max(depth, after)]
        start = int(overlaps[depth - 1]) if depth else 0
        overlaps = np.concatenate((overlaps[:depth], start + np.cumsum(_held(rising, way))))
        if fits and 100 * overlaps[-1] >= PERCENT * (n + len(row) - overlaps[-1]):
            found.append(order[i])
        if after > depth:
            behind = n - np.searchsorted(rising, ~row[depth:after], side="right")
            best = overlaps[depth:after] + np.minimum(behind, longest - np.arange(depth + 1, after + 1))
            hopeless = np.flatnonzero(100 * best < PERCENT * np.maximum(n + shortest - best, n))
            if len(hopeless):
                left = depth + 1 + int(hopeless[0])
                overlaps = overlaps[:left]
    return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _held(rising: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Which n-grams of a way the probe has."""
    at = np.searchsorted(rising, ~way)
    return rising[np.minimum(at, len(rising) - 1)] == ~way


def _decide(batches):
    """Rows ``(probe, part, node, hashes)`` sorted by probe and part, the probe's own set first: links ``(a, b)``."""
    key, probe, nodes, sets = None, None, [], []

    def links():
        hits = walk(probe, sets) if probe is not None and sets else []
        if hits:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hits), pa.int64()), pa.array([nodes[i] for i in hits], pa.int64())], names=["a", "b"])

    for batch in batches:
        probes, parts, own = (batch.column(i).to_pylist() for i in range(3))
        column = batch.column(3)
        for i in range(batch.num_rows):
            if (probes[i], parts[i]) != key:
                yield from links()
                key, probe, nodes, sets = (probes[i], parts[i]), None, [], []
            values = np.frombuffer(column[i].as_py(), np.uint64)[::-1]
            if own[i] == key[0]:
                probe = values
            else:
                nodes.append(own[i])
                sets.append(values)
    yield from links()


# -- meetings ----------------------------------------------------------------------------------------------------------


def _prefixes(classes):
    """Rows ``(id, text, hash)`` in, ``(id, hash, n, node, prefix, least, bits)`` out: the size of a text's set, its name,
    the first numbers of its order, its least hashes and its parities. Sets that a task has seen come without the last
    three."""

    def prefixes(batches):
        table, seen = classes.value, set()
        for batch in batches:
            sizes, nodes, prefix, least, bits = [], [], [], [], []
            for text in each_text(batch.column(1)):
                hashes = shingles(text)
                n, node = len(hashes), identity(hashes) if len(hashes) else None
                new = n and node not in seen
                if new:
                    seen.add(node)
                sizes.append(n)
                nodes.append(node)
                prefix.append(ordered(hashes, table)[: n - needed(n) + 1].view(np.int64) if new else None)
                least.append(hashes[:LEAST].view(np.int64) if new else None)
                bits.append(parities(hashes) if new else None)
            arrays = [pa.array(x, pa.list_(pa.int64())) for x in (prefix, least)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *arrays, pa.array(bits, pa.binary())],
                names=["id", "hash", "n", "node", "prefix", "least", "bits"])

    return prefixes


#: Numbers of a set where it meets others, before its parities: ``before`` is the n-gram before this one in its prefix.
_MEETING = ["gram", "low", "high", "share", "node", "n", "at", "class", "before"]


def _meet(batches):
    """Rows ``(*_MEETING, bits)`` sorted by their first three: candidate pairs of one n-gram, of different classes, that
    lengths, places and parities, where there are any, leave possible."""
    held = bits = None
    for batch in batches:
        now, own = np.stack([batch.column(i).to_numpy() for i in range(9)]), batch.column(9)
        if held is not None:
            now, own = np.concatenate((held, now), axis=1), pa.concat_arrays([bits, own])
        if not now.shape[1]:
            continue
        change = np.flatnonzero((now[:3, 1:] != now[:3, :-1]).any(axis=0)) + 1
        cuts = np.concatenate(([0], change))
        yield from _pairs(now[:, : cuts[-1]], own, cuts)
        held, bits = now[:, cuts[-1]:], own.slice(cuts[-1])
    if held is not None and held.shape[1]:
        yield from _pairs(held, bits, np.array([0, held.shape[1]]))


def _pairs(rows: np.ndarray, bits: pa.Array, cuts: np.ndarray):
    sizes = np.diff(cuts)
    if not len(sizes):
        return
    # groups with more than one class
    differs = np.zeros(rows.shape[1] + 1, np.int64)
    differs[1:rows.shape[1]] = rows[7, 1:] != rows[7, :-1]
    total = np.cumsum(differs)
    mixed = np.flatnonzero((sizes > 1) & (total[cuts[1:] - 1] > total[cuts[:-1]]))
    out = []
    for g in mixed:
        part, own = rows[:, cuts[g]:cuts[g + 1]], bits.slice(cuts[g], sizes[g])
        levels = None if own.null_count == len(own) else _levels(own.to_pylist())
        low, high = part[1, 0], part[2, 0]
        for i in range(0, part.shape[1], BLOCK):
            for j in range(i, part.shape[1], BLOCK):
                x, y = _possible(part[:, i:i + BLOCK], part[:, j:j + BLOCK], low, high)
                x, y = x + i, y + j
                if levels is not None and len(x):
                    near = _within(levels, x, y, part[5, x] + part[5, y])
                    x, y = x[near], y[near]
                left, right = part[4, x], part[4, y]
                out.append(np.stack((np.minimum(left, right), np.maximum(left, right)), axis=1))
        if sum(map(len, out)) > 100_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _possible(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two blocks of pairs that classes, lengths and places leave possible."""
    n, m = a[5][:, None], b[5][None, :]
    i, j = a[6][:, None], b[6][None, :]
    # a pair is asked for where it meets first: it has nothing in common before this n-gram, and at most all from it on
    most = np.minimum(n - i, m - j)
    ok = a[7][:, None] != b[7][None, :]
    # the n-gram before is in both too: they have met there, where no less was possible
    ok &= (a[8][:, None] != b[8][None, :]) | (i == 0) | (j == 0)
    ok &= 100 * most >= PERCENT * (n + m - most)
    ok &= 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    if low != high:
        ok &= a[3][:, None] != b[3][None, :]  # pairs of one share meet in that share's own cell
    return np.nonzero(ok)


def _levels(bits: list[bytes | None]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Sizes of parities in bytes, none being 0, and for each size that occurs those of all sets that have as many or more,
    folded to it."""
    sizes = np.array([len(b or b"") for b in bits])
    own = {t: np.frombuffer(b"".join(b for b in bits if b and len(b) == t), np.uint8).reshape(-1, t) for t in np.unique(sizes[sizes > 0])}
    levels = {}
    for size in own:
        levels[size] = np.zeros((len(bits), size), np.uint8)
        for t in (t for t in own if t >= size):
            levels[size][sizes == t] = _folded(own[t], size)
    return sizes, levels


def _within(levels: tuple[np.ndarray, dict[int, np.ndarray]], x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Which pairs of sets, ``both`` of their members together, can be linked by their parities."""
    sizes, folded = levels
    least, differ = np.minimum(sizes[x], sizes[y]), np.zeros(len(x), np.int64)
    for size in np.unique(least[least > 0]):
        rows = np.flatnonzero(least == size)
        for part in np.array_split(rows, -(-len(rows) * int(size) // (8 << 20)) or 1):
            differ[part] = np.bitwise_count(folded[size][x[part]] ^ folded[size][y[part]]).sum(axis=1, dtype=np.int64)
    return _can_link(differ, both)


def _can_link(differ: np.ndarray, both: np.ndarray) -> np.ndarray:
    """A link's difference is at most ``(100 - PERCENT) / (100 + PERCENT)`` of both sizes together."""
    return (100 + PERCENT) * differ <= (100 - PERCENT) * both


def _batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs of ``nodes`` ``(node, n, prefix, bits, class)`` that meet in their prefixes and may be linked.

    An n-gram of a class of many documents is cut into shares, and each pair of shares is a cell of its own. There are many
    pairs there, so sets of up to ``MEMBERS`` bring their parities to n-grams from the class ``CROWDED`` on.
    """
    own = "prefix as gram", "slice(concat(array(0L), prefix), 1, size(prefix)) as before"
    nodes = nodes.select("node", "n", "class", "bits", F.struct(*map(F.expr, own)).alias("_p"))
    places = nodes.select("node", "n", "class", "bits", F.posexplode(F.arrays_zip("_p.gram", "_p.before")).alias("at", "_p"))
    places = places.select("node", "n", "class", "bits", "at", F.col("_p.gram").alias("gram"), F.col("_p.before").alias("before"))
    frequency = F.shiftrightunsigned("gram", HASH_BITS)
    places = places.withColumn("bits", F.when((frequency >= CROWDED) & (F.col("n") <= MEMBERS), F.col("bits")))
    shares = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(2.0), frequency) / SHARE)).cast("int")
    places = places.withColumn("shares", shares).withColumn("share", F.pmod(F.xxhash64("node"), "shares").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda o: F.struct(F.least("share", o).alias("low"), F.greatest("share", o).alias("high")))
    single = places.where("shares = 1").withColumns({"low": F.lit(0), "high": F.lit(0)})
    several = places.where("shares > 1").withColumn("cell", F.explode(cells)).withColumns({"low": F.col("cell.low"), "high": F.col("cell.high")})
    columns = [F.col(c).cast("long") for c in _MEETING] + [F.col("bits")]
    rows, keys = single.select(*columns).unionByName(several.select(*columns)), _MEETING[:3]
    return reachable(rows.repartition(*keys).sortWithinPartitions(*keys)).mapInArrow(_meet, "a long, b long").distinct()


def _sets(classes):
    def sets(batches):
        """The ordered sets of the texts whose names are asked for, once in a task."""
        table, seen = classes.value, set()
        for batch in batches:
            nodes, values = [], []
            for wanted, text in zip(batch.column(0).to_pylist(), each_text(batch.column(1))):
                if wanted in seen:
                    continue
                hashes = shingles(text)
                if len(hashes) and identity(hashes) == wanted:
                    seen.add(wanted)
                    nodes.append(wanted)
                    values.append(ordered(hashes, table).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], names=["node", "hashes"])

    return sets


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities over fewer cells, by adding those that fall together; ``bits`` has a row for each set."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _near_enough(batches):
    """Of rows ``(a, b, n, m, bits, bits of b)`` the pairs whose parities leave a link possible."""
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        left, right = batch.column(4), batch.column(5)
        size = np.stack([np.diff(np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1]) for x in (left, right)])
        differ = np.zeros(batch.num_rows, np.int64)
        for pair in np.unique(size, axis=1).T:
            rows = np.flatnonzero((size == pair[:, None]).all(axis=0))
            for part in np.array_split(rows, -(-len(rows) * int(pair.max()) // (8 << 20)) or 1):
                both = [np.frombuffer(b"".join(x.take(pa.array(part)).to_pylist()), np.uint8).reshape(len(part), -1) for x in (left, right)]
                x, y = (_folded(b, int(pair.min())) for b in both)
                differ[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        keep = pa.array(_can_link(differ, n + m))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, classes) -> DataFrame:
    """The links among ``pairs`` ``(a, b)`` of names. ``known`` ``(node, hash, n, bits)`` tells where the text of a name is
    among ``docs`` ``(text, hash)``."""
    for end in "ab":
        own = known.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
        pairs = pairs.join(own, end)
    pairs = reachable(pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b")).mapInArrow(_near_enough, "a long, b long")
    pairs, seen = store(pairs, "candidates")
    if not seen["rows"]:
        return pairs
    # a node is a probe for its pairs, CANDIDATES of them to a trie
    counts, few = settle(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("parts")).where("parts > 1"))
    cut = pairs.join(small(counts, few), "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).cast("int").alias("part"), "b")
    asked = cut.select(F.col("a").alias("probe"), "part", F.col("b").alias("node")).unionByName(cut.select(F.col("a").alias("probe"), "part", F.col("a").alias("node")).distinct())
    asked, _ = settle(asked)
    wanted, size = settle(known.join(asked.select("node").distinct(), "node", "left_semi").select("node", "hash"))
    texts = docs.join(small(wanted, size), "hash").select("node", "text")
    sets = reachable(texts).mapInArrow(_sets(classes), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    rows = sets.join(asked, "node").select("probe", "part", "node", "hashes")
    rows = rows.repartition("probe", "part").sortWithinPartitions("probe", "part")
    return reachable(rows).mapInArrow(_decide, "a long, b long").distinct()


def _classed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with ``class``, the smallest name that links reach."""
    roots, _ = settle(components(links))
    joined = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return joined.withColumn("class", F.coalesce("root", "node")).drop("_node", "root")


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles`` (distinct n-grams) and ``component_id``, the smallest key that
    links reach from it, its own included.

    Texts that are null, empty or without words have no n-grams and are linked with nothing, repeated rows of that kind
    neither. Repeated rows share their set and so their class. A null key never is a ``component_id`` unless all keys of a
    class are null. Texts of any length are compared whole. Other columns are not read. An empty table gives an empty one.

    N-grams are told apart by 58 bits of their hashes and sets by 64: two different ones of a pair of documents are taken
    for one with a chance near 10^-12.
    """
    # copies of a text have one hash; a text is found again by it, whatever the keys are
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    kind = own.schema["id"].dataType.simpleString()
    classes = own.sparkSession.sparkContext.broadcast(frequency_classes(own))
    slim = reachable(own).mapInArrow(_prefixes(classes), f"id {kind}, hash long, n long, node long, prefix array<long>, least array<long>, bits binary")
    slim, _ = store(slim, "prefixes")
    # tasks give a set's prefix and parities once; of several tasks one is taken
    known, _ = store(slim.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("hash").alias("hash"), F.max("n").alias("n"), F.max("bits").alias("bits")), "nodes")
    new = slim.where("prefix is not null")
    links = links_by_least_hashes(new, own, known, classes)
    links = links.unionByName(links_by_prefixes(new, own, known, classes, links))

    classed, _ = settle(_classed(known, links))
    smallest, _ = settle(classed.groupBy("class").agg(F.min("id").alias("component_id")))
    named, seen = settle(classed.join(smallest, "class").select(F.col("node").alias("_node"), "component_id"))
    rows = slim.select("id", "n", "node").join(small(named, seen), F.col("node") == F.col("_node"), "left")
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def links_by_least_hashes(new: DataFrame, docs: DataFrame, known: DataFrame, classes) -> DataFrame:
    """Links between sets that have one of their least hashes in common, each to one set of the group only. Sets that are
    not of its class then are asked for again at another one."""
    # a copy with fewer changes has fewer n-grams of its own, which would come first in its prefix
    changes = F.expr(f"-aggregate(prefix, 0L, (s, x) -> s + shiftrightunsigned(x, {HASH_BITS})) / size(prefix)")
    meets, _ = settle(new.select("node", "n", changes.alias("changes"), F.explode("least").alias("least")).distinct())
    links = None
    for turn in range(HUBS):
        # sets linked with one hub are of one class; whole components aren't needed to leave such pairs out
        classed = meets.withColumn("class", F.col("node"))
        if links is not None:
            stars, seen = settle(links.groupBy(F.col("b").alias("_node")).agg(F.min("a").alias("_hub")))
            classed = meets.join(small(stars, seen), F.col("node") == F.col("_node"), "left").withColumn("class", F.coalesce("_hub", "node")).drop("_node", "_hub")
        classed, _ = settle(classed)
        mixed = F.xxhash64("node", F.lit(turn))
        hub = F.min_by(F.struct("node", "n", "class"), mixed if turn else F.struct("changes", mixed)).alias("hub")
        hubs, _ = settle(classed.groupBy("least").agg(hub, F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("least", "hub"))
        pairs = classed.join(hubs, "least").where(F.col("class") != F.col("hub.class"))
        pairs = pairs.where(100 * F.least("n", "hub.n") >= PERCENT * F.greatest("n", "hub.n")).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        found, seen = store(_verified(pairs.distinct(), docs, known, classes), "links")
        links = found if links is None else links.unionByName(found)
        if not seen["rows"]:
            break
    return links


def links_by_prefixes(new: DataFrame, docs: DataFrame, known: DataFrame, classes, links: DataFrame) -> DataFrame:
    """All links between sets that ``links`` don't join to one class already."""
    nodes = _classed(new.select("node", "n", "prefix", "bits").dropDuplicates(["node"]), links)
    return store(_verified(_candidates(nodes), docs, known, classes), "links")[0]

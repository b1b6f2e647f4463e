"""How the tokens of two tokenizers lie on each other, and how often each pair of ids does in the whole corpus.

Both tokenizers cut the same bytes. Where tokens of both end at one byte, a group ends; a token of one and a token of the
other are linked where their bytes overlap. A byte at which any token ends closes exactly one link, so the links of a text
are the outer join of the two tokenizers' ends, and its groups the inner one.

A task works on Arrow arrays, a slice of texts at a time: lists are flattened with the indices of their parents, ends are
segmented cumulative sums of token lengths, an Acero hash join on ``(document, end)`` gives the links, and
``Table.group_by`` counts pairs of ids by document and by chunk. Spark merges the chunks' counts, finds the best of each id,
and sends every chunk the totals of its own pairs only, so that texts are encoded once and no table of pairs is broadcast.
"""

from __future__ import annotations

import base64
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.workers import each_text, reachable
from pathweave.session import store

#: Bytes of text and documents that one task turns into Arrow tables at once, and that share one table of pair counts.
SLICE_BYTES, SLICE_DOCS = 1 << 20, 512
CHUNK_BYTES = 16 << 20
#: Ids of the second tokenizer are below this; a pair is ``first * ID_RANGE + second``, below 2^31.
ID_RANGE = 1 << 15


class ByteBpe:
    """A byte-level BPE from a file of ranks (base 64 of the bytes, and the id) and its pattern of words. It knows no
    special tokens, so that their strings are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("align", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(" " + t) for t in texts]


class PieceBpe:
    """A piece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [_piece_bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


_tokenizers: dict[tuple, tuple] = {}


def _pair_of(first: tuple[str, str], second: str) -> tuple[ByteBpe, PieceBpe]:
    """This process's tokenizers, from their files."""
    if (first, second) not in _tokenizers:
        _tokenizers[first, second] = ByteBpe(*first), PieceBpe(second)
    return _tokenizers[first, second]


# -- Arrow tables of a slice -------------------------------------------------------------------------------------------


def _same_bytes(text: bytes, ids: list[np.ndarray], tokens: list[list[bytes]]) -> bool:
    """Do both tokenizers' tokens give the text, with a space before it?"""
    return all(b"".join(map(table.__getitem__, i.tolist())) == b" " + text for i, table in zip(ids, tokens))


def _ends(lists: list[np.ndarray], lengths: np.ndarray, side: str) -> pa.Table:
    """``(doc, end, <side>)``: of each token its document, the byte it ends at, and its number among all tokens."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    array = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists), pa.uint32()))
    parent, flat = pc.list_parent_indices(array), pc.list_flatten(array)
    sums = pc.cumulative_sum(pa.array(lengths).take(flat))
    # what has been summed before the document's first token
    before = pa.array(np.concatenate(([0], sums.to_numpy()))[offsets[:-1]]).take(parent)
    return pa.table({"doc": parent, "end": pc.subtract(sums, before), side: pa.array(np.arange(len(flat), dtype=np.int64)), f"{side}_id": flat.cast(pa.int64())})


def _links(first: pa.Table, second: pa.Table) -> pa.Table:
    """One row per link, in order: ``doc``, the numbers of its tokens where they end with it (else null), and their ids."""
    both = first.join(second, ["doc", "end"], join_type="full outer", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")])
    # a token that ends later covers the ends before its own
    return pa.table({"doc": both["doc"], "a": both["a"], "b": both["b"], "a_id": pc.fill_null_backward(both["a_id"]), "b_id": pc.fill_null_backward(both["b_id"])})


_SEPARATORS = b",|;"


def _written(size: int) -> np.ndarray:
    """Each id in decimal with a separator behind it, padded with zero bytes: ``[separator, id]``."""
    return np.array([[b"%d%c" % (i, s) for i in range(size)] for s in _SEPARATORS], "S6")


def _group_digests(lists_a, lists_b, links: pa.Table, written: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups, written as ``a1,a2|b1;a3|b2,b3``."""
    common = pc.and_(pc.is_valid(links["a"]), pc.is_valid(links["b"]))
    ends = links.filter(common)
    last_a, last_b = ends["a"].to_numpy(), ends["b"].to_numpy()  # the last token of either side of each group
    ids_a, ids_b = np.concatenate(lists_a).astype(np.int64), np.concatenate(lists_b).astype(np.int64)
    group_a, group_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
    earlier_b = np.concatenate(([0], last_b + 1))[group_a]
    out = np.empty(len(ids_a) + len(ids_b), "S6")
    out[np.arange(len(ids_a)) + earlier_b] = written[(last_a[group_a] == np.arange(len(ids_a))).astype(int), ids_a]
    out[np.arange(len(ids_b)) + last_a[group_b] + 1] = written[2 * (last_b[group_b] == np.arange(len(ids_b))), ids_b]
    starts = np.cumsum([0] + [len(a) + len(b) for a, b in zip(lists_a, lists_b)])
    return [sha256(out[s:e].tobytes().replace(b"\0", b"")[:-1]).hexdigest() for s, e in zip(starts, starts[1:])]


def align(texts: list[bytes | None], first: ByteBpe, second: PieceBpe, lengths: tuple[np.ndarray, np.ndarray], written: np.ndarray):
    """Of each text ``(n_a, n_b, n_groups, n_links, digest)``, and a table ``(doc, pair, times)`` of the texts' pairs of
    ids, by text."""
    rows: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    strings = [texts[i].decode() for i in some]
    lists = list(zip(first.encode(strings), second.encode(strings)))
    good = [k for k, i in enumerate(some) if _same_bytes(texts[i], lists[k], [first.bytes, second.bytes])]
    if not good:
        return rows, pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    lists_a, lists_b = [lists[k][0] for k in good], [lists[k][1] for k in good]
    links = _links(_ends(lists_a, lengths[0], "a"), _ends(lists_b, lengths[1], "b"))
    doc = links["doc"].to_numpy()
    n_links = np.bincount(doc, minlength=len(good))
    n_groups = len(good) and [len(a) + len(b) - n for a, b, n in zip(lists_a, lists_b, n_links.tolist())]
    digests = _group_digests(lists_a, lists_b, links, written)
    for k, at in enumerate(good):
        rows[some[at]] = (len(lists_a[k]), len(lists_b[k]), n_groups[k], int(n_links[k]), digests[k])
    pair = pc.add(pc.multiply(links["a_id"], ID_RANGE), links["b_id"])
    counted = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    numbers = pa.array(np.array([some[k] for k in good], np.int64))
    return rows, pa.table({"doc": numbers.take(counted["doc"]), "pair": counted["pair"], "times": counted["count_all"]}).sort_by("doc")


# -- chunks ------------------------------------------------------------------------------------------------------------


def _encode(first: tuple[str, str], second: str):
    """Rows of documents ``(kind 1)`` with their pairs, and of their chunks ``(kind 0)`` with the chunk's counts of pairs."""

    def encode(batches):
        a, b = _pair_of(first, second)
        lengths = tuple(np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        written = _written(max(len(a.bytes), len(b.bytes)))
        chunk, size, counts = TaskContext.get().partitionId() << 33, 0, []

        def closed():
            table = pa.concat_tables(counts).group_by("pair", use_threads=False).aggregate([("times", "sum")]) if counts else None
            if table is not None and table.num_rows:
                yield _batch(key_type, [None], [chunk], [0], [(0, 0, 0, 0, "")], [table["pair"].to_numpy()], [table["times_sum"].to_numpy()])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            at, texts, held = 0, [], 0
            todo = each_text(batch.column(1))
            while True:
                text = next(todo, StopIteration)
                if text is not StopIteration:
                    texts.append(text)
                    held += len(text or b"")
                if texts and (text is StopIteration or held >= SLICE_BYTES or len(texts) == SLICE_DOCS):
                    rows, pairs = align(texts, a, b, lengths, written)
                    cuts = np.searchsorted(pairs["doc"].to_numpy(), np.arange(len(texts) + 1))
                    flat, times = pairs["pair"].to_numpy(), pairs["times"].to_numpy()
                    parts = [(flat[s:e], times[s:e]) for s, e in zip(cuts, cuts[1:])]
                    yield _batch(key_type, batch.column(0).slice(at, len(texts)), [chunk] * len(texts), [1] * len(texts), rows, [p[0] for p in parts], [p[1] for p in parts])
                    counts.append(pairs.select(["pair", "times"]).group_by("pair", use_threads=False).aggregate([("times", "sum")]).rename_columns(["pair", "times"]))
                    at, size = at + len(texts), size + held
                    texts, held = [], 0
                    if size >= CHUNK_BYTES:
                        yield from closed()
                        chunk, size, counts = chunk + 1, 0, []
                if text is StopIteration:
                    break
        yield from closed()

    return encode


def _lists(arrays, kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if len(arrays) else [], kind))


def _batch(key_type, keys, chunks, kinds, rows, pairs, times) -> pa.RecordBatch:
    numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    keys = keys if isinstance(keys, pa.Array) else pa.array(keys, key_type)
    columns = [pa.array(chunks, pa.int64()), pa.array(kinds, pa.int32()), keys, *numbers, pa.array([r[4] for r in rows], pa.string()), _lists(pairs, pa.int32()), _lists(times, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "kind", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _scored(batches):
    """Rows sorted by chunk, the chunk's totals (kind 0) before its documents: what each document's links sum up to."""
    chunk, known, totals, best = None, np.zeros(0, np.int64), None, None
    names = ["chunk", "kind", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    for batch in batches:
        n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        chunks, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            pairs, times = (batch.column(names.index(c))[i].values.to_numpy() for c in ("pairs", "times"))
            if kinds[i] == 0:
                order = np.argsort(pairs)
                chunk, known, totals = chunks[i], pairs[order], times[order]
                best, totals = totals & 1, totals >> 1
            elif len(pairs):
                if chunks[i] != chunk:
                    raise RuntimeError(f"no totals of chunk {chunks[i]}")
                at = np.searchsorted(known, pairs)
                n_best[i], count_sum[i] = (best[at] * times).sum(), (totals[at] * times).sum()
        keep = pa.array(np.array(kinds) == 1)
        columns = [batch.column(c) for c in (2, 3, 4, 5, 6)] + [pa.array(n_best), pa.array(count_sum), batch.column(7)]
        out = pa.RecordBatch.from_arrays(columns, names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        yield out.filter(keep)


def alignment(docs: DataFrame, first: tuple[str, str], second: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose
    pair is the most frequent one of its second id), ``count_sum`` (of the links' pairs' counts in the corpus) and
    ``groups_sha256``.

    ``first`` is a file of ranks and its pattern, ``second`` a piece model; all executors have the files. Texts that are
    null or empty, and those whose tokens do not give the text back (the piece model rewrites some characters), have no
    tokens: zeros and an empty digest; they count for nothing. Very long texts are aligned whole, in a slice of their own.
    Repeated rows are documents of their own and count each. Ties for the most frequent pair are all best. Other columns
    are not read. An empty table gives an empty one.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = own.schema["key"].dataType.simpleString()
    schema = f"chunk long, kind int, key {key_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"
    coded, _ = store(reachable(own).mapInArrow(_encode(first, second), schema), "aligned")

    parts = coded.where("kind = 0").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("at")).select("chunk", F.col("at.pairs").alias("pair"), F.col("at.times").alias("times"))
    totals, _ = store(parts.groupBy("pair").agg(F.sum("times").alias("total")), "pairs")
    second_id = F.pmod("pair", F.lit(ID_RANGE))
    # at most ID_RANGE rows
    tops = totals.groupBy(second_id.alias("second")).agg(F.max("total").alias("most"))
    marked = totals.withColumn("second", second_id).join(F.broadcast(tops), "second").select("pair", (2 * F.col("total") + (F.col("total") == F.col("most")).cast("long")).alias("marked"))
    # every chunk gets the totals of its own pairs, as many as the chunk has
    sent = parts.select("chunk", "pair").join(marked, "pair").groupBy("chunk").agg(F.collect_list("pair").alias("pairs"), F.collect_list("marked").alias("times"))
    none = F.lit(0).cast("long")
    sent = sent.select("chunk", F.lit(0).alias("kind"), F.lit(None).cast(key_type).alias("key"), *(none.alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")), F.lit("").alias("groups_sha256"), "pairs", "times")
    rows = coded.where("kind = 1").unionByName(sent).repartition("chunk").sortWithinPartitions("chunk", "kind")
    result = f"key {key_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return reachable(rows).mapInArrow(_scored, result).withColumnRenamed("key", key)

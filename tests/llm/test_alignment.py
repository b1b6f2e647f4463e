import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pathweave.llm import alignment
from pathweave.llm.queries import byte_bpe, piece_bpe

SCHEMA = "doc_id long, text string, n_a string, key string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    """Byte-level vocabularies write each byte as a letter."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def coded(tokenizers, text):
    """Ids and bytes of the tokens of both, or nothing where they don't give the text back."""
    a, b = tokenizers
    letters = byte_letters()
    if not text:
        return [], []
    found = a.encode(" " + text, add_special_tokens=False)
    first = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in found.ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (first, second) if all(b"".join(x for _, x in side) == whole for side in (first, second)) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(tokenizers, rows):
    """By comparing all spans of a text with each other."""
    texts = []
    for doc_id, text in rows:
        a, b = map(spans, coded(tokenizers, text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(x[0]) for x in a if s < x[2] <= e) + "|" + ",".join(str(y[0]) for y in b if s < y[2] <= e) for s, e in zip([0] + ends, ends)]
        texts.append((doc_id, len(a), len(b), len(ends), links, sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    counts = Counter(pair for t in texts for pair in t[4])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return sorted(((d, na, nb, ng, len(ln), sum(counts[p] == most[p[1]] for p in ln), sum(counts[p] for p in ln), h) for d, na, nb, ng, ln, h in texts), key=str)


def corpus():
    rng = random.Random(3)
    parts = ["the", "Unbelievable", "naïve", "日本語", "😀", "<|endoftext|>", "<s>", "</s>", "12345", "...", "\n", "\t", "a▁b", "ﬁ", "don't", "  ", "​", "x" * 30, "é", "ß", "\x00", "<0x41>"]
    rows = [(i, " ".join(rng.choice(parts[: rng.choice((5, len(parts)))]) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    return rows + [(None, "the end"), (500, None), (501, ""), (502, " "), (503, "\n\n  two  spaces "), (7, rows[7][1]), (7, rows[7][1]), (504, "q")]


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in alignment.alignment(docs, byte_bpe(), piece_bpe()).collect()), key=str)


def test_alignment_equals_comparing_all_spans(spark, tokenizers):
    rows = corpus()
    want = plain(tokenizers, rows)
    assert any(w[1] == 0 for w in want) and sum(w[1] > 0 for w in want) > 60
    assert found(spark, rows) == want


def test_many_chunks_and_slices_count_as_one(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_DOCS", 7)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 400)
    rows = corpus()[:60]
    # workers import the module anew, so the sizes go along with the function
    size = alignment.SLICE_DOCS, alignment.CHUNK_BYTES
    assert size == (7, 400)
    got = list(_local(rows))
    assert sum(k == 0 for k, _ in got) > 3 and sorted(i for k, i in got if k) == sorted(i for i, _ in rows)
    assert found(spark, rows) == plain(tokenizers, rows)


def _local(rows):
    """The rows that one task would write, here."""
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 2

    kept, alignment.TaskContext = alignment.TaskContext, Context
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["key", "text"])
        for out in alignment._encode(byte_bpe(), piece_bpe())(iter([batch])):
            yield from zip(out.column(1).to_pylist(), out.column(2).to_pylist())
    finally:
        alignment.TaskContext = kept


def test_long_and_missing_texts(spark, tokenizers):
    long = "word after word, " * 40_000
    got = found(spark, [(1, long), (2, "word")])
    a, b = coded(tokenizers, long)
    assert got[0][:3] == (1, len(a), len(b)) and got[0][3] == len({x[2] for x in spans(a)} & {x[2] for x in spans(b)})
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pathweave.llm import mixing, packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, target double, ids string"


def documents(spark, seed=3, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "é", None, "tiny"]) if i else "tiny", 0.0, "x") for i in range(n)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] < 30] + [(None, "a b", "a", 0.0, ""), (5, None, "b", 0.0, ""), (7, "x y", "b", 0.0, ""), (7, "x y", "b", 0.0, ""), (8, "", "empty", 0.0, "")]
    return spark.createDataFrame(rows, DOCS), rows


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_ = float(sum(sizes.values())), set(names)
    target = {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over


def test_targets_and_takes(spark):
    docs, rows = documents(spark)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = plain_targets(sizes)
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    taken = Counter()
    for r in got:
        s = source[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60, (s, taken[s], t)  # within one document
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(3)).collect()))  # reruns agree


def test_mix_repeats_the_rows(spark):
    docs, _ = documents(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = out.selectExpr("source", "size(split(trim(text), ' +')) n", "text").where("text > ''").groupBy("source").sum("n").collect()
    taken = Counter()
    for r in mixing.mixed(docs).collect():
        taken["all"] += r["taken"]
    assert sum(r[1] for r in words) == taken["all"]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_longer_documents_are_likelier():
    assert mixing.FULL == 2048 and mixing.MOST == 3


def test_words_give_the_tokenizer_s_ids():
    rng = random.Random(1)
    plain = Tokenizer.from_file(PATH)
    parts = ["word", "Wörter", "ÉTÉ", "don't", "we'll", "x,", "...", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "3.14", "naïve;", "İ", "ǅ", "e\u0301", "日本語", "\U0001f600", "a\u00a0b", "\x1c",
             "'s", "ß", "ﬁ", "Ω", "\u2028", "_", "a-b"]
    known = tokens.memory(PATH)
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t "]) for _ in range(rng.randint(0, 12)))
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(known.ids(text.encode()), "<u4").tolist() == ids, text


def test_memory_forgets_but_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 5)
    known, plain = tokens.WordMemory(PATH), Tokenizer.from_file(PATH)
    for i in range(60):
        text = " ".join(f"word{j}," for j in range(i % 17))
        assert np.frombuffer(known.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def placed(histogram, **options):
    """Sequences of the pieces by a plan; checks that intervals cover all pieces and no sequence is overfull."""
    lengths = np.repeat(sorted(histogram, reverse=True), [histogram[n] for n in sorted(histogram, reverse=True)])
    intervals, sequences = packing.plan(histogram, **options)
    k = np.arange(len(lengths))
    rows = intervals[np.searchsorted(intervals[:, 0], k, side="right") - 1]
    assert (k >= rows[:, 0]).all() and (k < rows[:, 1]).all()
    sequence = rows[:, 2] + k - rows[:, 0]
    assert len(set(zip(sequence.tolist(), rows[:, 3].tolist()))) == len(k)
    fill = np.bincount(sequence, weights=lengths, minlength=sequences)
    assert len(fill) == sequences and fill.min() > 0 and fill.max() <= packing.LENGTH
    return sequences, lengths.sum()


def test_plans_fit_and_are_near_the_bound():
    rng = np.random.default_rng(2)
    for n in (1, 7, 3000, 200_000):
        lengths = np.clip(rng.lognormal(6, 1, n).astype(int) % 2048 + 1, 1, 2048)
        sequences, total = placed(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))))
        assert sequences <= max(-(-total // 2048) * 1.01 + 2, 1)
    assert placed({2048: 9})[0] == 9 and placed({1: 5000})[0] == 3 and placed({1500: 10})[0] == 10
    assert packing.plan({})[1] == 0


def test_nnls_against_known_solution():
    columns = np.array([[3, 1, 0], [2, 2, 0], [2, 1, 1]])
    b = np.array([0.0, 9, 8, 5])
    x = packing.nnls(columns, b)
    assert np.allclose(x, [5, 3, 2], atol=1e-3)  # the one that uses up b


def test_packing_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "γάμμα", "x1"]) for _ in range(rng.choice((0, 3, 300, 1500, 6000))))) for i in range(60)]
    rows += [(100, None), (100, "again"), (100, "again"), (None, "no key"), (101, "\U0001f600" * 3000)]
    docs = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, text string, offset int, sequence_id string")
    got = packing.packed(docs, PATH, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for key, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            part = ids[at:at + 2048]
            want.append((str(key), at // 2048, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(docs.limit(0), PATH).count() == 0

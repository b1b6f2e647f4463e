import random
import zlib
from hashlib import sha256

import numpy as np

from pathweave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, position string"


def h(text):
    return sha256(text.encode()).hexdigest()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf(row, change=False):
    doc_id, text, lang, source, n_chars = row[:5]
    text = low(text) if change and text is not None else text
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, i, digest):
    """Siblings of a leaf, and the root from another digest in its place."""
    siblings = []
    for level in levels[:-1]:
        first = i // 8 * 8
        run = level[first:first + 8]
        siblings += [x for j, x in enumerate(run) if first + j != i]
        run[i - first] = digest
        digest, i = h("".join(run)), i // 8
    return siblings, digest


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, tree([leaf(r) for r in own])
    top = tree([trees[lang][1][-1][0] for lang in langs])
    for place, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            inside, folded = walk(levels, i, leaf(r, changed))
            over, folded = walk(top, place, folded)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h("".join(inside + over)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def corpus(n, langs, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["Ab", "cd", "É", "日"]) for _ in range(rng.randint(0, 6))), rng.choice(langs), rng.choice([None, "s", "-"]), rng.choice([None, 7]), "t", "p") for i in range(n)]
    rows += [(None, "X", "en", None, None, None, None), (None, None, None, None, None, None, None), (5, "Again", rows[5][2], "s", 1, None, None), rows[7], rows[7]]
    return rows + [(n, "Long " * 200_000, "en", "s", 1, None, None), (n + 1, "", "", "s", 0, None, None), (n + 2, "lone", "zz", "s", 4, None, None)]


def report(spark, rows):
    return sorted((tuple(r) for r in merkle.proof_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_proofs_equal_plain_trees(spark):
    rows = corpus(420, ["en", "en", "de", None, "日"])
    assert report(spark, rows) == plain(rows)


def test_trees_of_several_passes_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)  # eight leaves in a partition: most siblings are fetched
    rows = corpus(150, ["en"] * 6 + [f"l{i}" for i in range(12)])
    assert report(spark, rows) == plain(rows)


def test_an_empty_table_and_a_single_row(spark):
    assert report(spark, []) == []
    one = [(3, "Ab", "en", "s", 2, None, None)]
    assert report(spark, one) == plain(one)


def test_missing_nodes_are_the_fewest_that_give_all_proofs():
    rng = random.Random(1)
    for n in (1, 2, 8, 9, 64, 65, 300):
        levels = tree([h(str(i)) for i in range(n)])
        for k in {1, min(n, 3), n}:
            held = sorted(rng.sample(range(n), k))
            need = merkle.missing(np.array(held), n)
            # no node of them lies above a held leaf or is asked for in vain
            siblings = {(lv, j) for i in held for lv in range(len(levels) - 1) for j in range((i >> 3 * (lv + 1)) * 8, min((i >> 3 * (lv + 1)) * 8 + 8, len(levels[lv])))}
            above = {(lv, i >> 3 * lv) for i in held for lv in range(len(levels))}
            assert set(need) == siblings - above and len(need) == len(set(need))
            fetched = {(lv, j): levels[lv][j] for lv, j in need}
            for i, found, root in merkle.expand({i: (levels[0][i], None) for i in held}, fetched, n):
                assert (found, root) == walk(levels, i, levels[0][i]) and root == levels[-1][0]

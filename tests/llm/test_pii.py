import hashlib
import random
import re

from pathweave.llm import pii


def base_spans(text):
    """The base spans by plain regular expressions, as the contract words them."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out)


def report(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pii_report(docs).collect()}


def check(spark, texts):
    got = report(spark, texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text, joined, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == j for x in want) for j in range(4)]
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_base_spans_equal_plain_expressions(spark):
    rng = random.Random(3)
    parts = ["a", "bob", "@", ".", "mail", "x.com", "-", "_", "%", " ", "  ", "1", "12", "255", "256", "0.0", "1.2.3.4", "+", "(", ")", "é", "\n",
             "4111 1111 1111 1111", "4111111111111112", "49", "+49 30 1234567", "a@b.c", "555-0100", "\U0001f600"]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)])


def test_long_runs_neither_recurse_nor_hang(spark):
    check(spark, [None, "", "1" * 60_000, "1 " * 30_000, "a@" + "b." * 20_000 + "c", "a" * 60_000, "1.2." * 20_000, "+1" + "-2" * 20_000,
                  "x@y.z " * 2_000, "é" * 50_000 + "a@b.de"])


def test_spans_are_added_where_they_look_right(spark):
    texts = [f"call me at phone +1 (212) 555-01{i:02d} or mail bob{i}@mail.com today" for i in range(60)]
    texts += [f"our phone 212-555-01{i:02d} is open" for i in range(20)] + [f"write to ann{i} [at] mail [dot] com" for i in range(20)]
    got = report(spark, texts)
    added = [got[i]["spans"] for i in range(60, 100)]
    assert sum(bool(s) for s in added) >= 30
    first = texts[60].index("212")
    assert added[0] in ("", f"phone:{first}:{first + 12}")
    assert all(got[i]["n_phone"] == 0 for i in range(60, 100))


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.com", "x", 2)], "doc_id long, text string, spans string, row int")
    assert [r["n_email"] for r in pii.pii_report(docs).collect()] == [1]
    assert pii.pii_report(docs.limit(0)).collect() == []
    twice = docs.unionByName(docs)
    assert pii.pii_report(twice).count() == 2


def test_reliabilities_find_the_bad_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        good = [(1 if truth else -1) * (1 if rng.random() < 0.9 else -1) for _ in range(4)]
        votes = (*good, rng.choice((-1, 1)))
        counts[votes] = counts.get(votes, 0) + 1
    chance = pii.reliabilities(counts)
    assert chance[(1, 1, 1, 1, -1)] > 0.95 and chance[(-1, -1, -1, -1, 1)] < 0.05

import hashlib
import random
import re

from pathweave.llm import secrets
from pathweave.llm.automata import Dfa

PARTS = ["token", "secret", "api_key", "apikey", "API_KEY", "PassWord", "passwd", " ", "=", ":", '"', "'", "abcdefgh12", "x", "==", "AKIA", "ABCDEFGH1234",
         "0123456789abcdef" * 2, "deadbeef", "é", "\n", "ghp_", "a" * 36, "eyJab.eyJcd.x", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN ", "xoxb-123456789012345678", "AIza" + "b" * 35, "."]


def plain(text):
    found = []
    for i, rule in enumerate(secrets.RULES):
        found += [(m.start(), i, m.end()) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
    return sorted(found)


def test_one_pass_equals_plain_search():
    rng = random.Random(1)
    scanner = secrets.scanner()
    for _ in range(8000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        data = text.encode()
        assert secrets._code_points(data, scanner.spans(data)) == plain(text), text


def test_the_automaton_is_small_and_minimal():
    assert secrets.scanner().all.states < 2_000
    same = Dfa([r"(ab|ac)x", r"[0-9]{2,3}"])
    assert Dfa([r"a(b|c)x", r"[0-9][0-9][0-9]?"]).states == same.states
    for pattern in (r"(a|b)*c", r"x{2,4}y?", r"[^a]b+", r"(?i:Key)[:=]"):
        dfa, check = Dfa([pattern]), re.compile(pattern.encode())
        rng = random.Random(3)
        for _ in range(500):
            data = bytes(rng.choice(b"abcxyKEk:=e") for _ in range(rng.randint(0, 7)))
            longest = max((n for n in range(1, len(data) + 1) if check.fullmatch(data[:n])), default=0)
            assert dfa.last(data, range(len(data))) + 1 == longest, (pattern, data)


def test_report(spark):
    rng = random.Random(2)
    texts = [None, "", "é" * 70_000 + " token=abcdefgh1234", "f" * 100_000] + ["".join(rng.choice(PARTS) for _ in range(8)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)] + [(3, "f" * 40, 1, "s")], "doc_id long, text string, n_hex int, spans string")
    got = secrets.secret_report(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got[:-1]:
        spans = plain(texts[r["doc_id"]] or "")
        name = lambda s: f"{secrets.RULES[s[1]].kind}:{s[0]}:{s[2]}"
        assert r["spans"] == ",".join(map(name, spans))
        base = [s for s in spans if s[1] < 3]
        assert r["base_sha256"] == hashlib.sha256(",".join(map(name, base)).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base) for k in range(3))
    assert secrets.secret_report(docs.limit(0)).count() == 0

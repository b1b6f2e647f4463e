"""Personal data by weak supervision, in DataFrame functions only.

Base patterns and a few looser ones propose spans. Labelers of three sorts vote on each: formats and checksums, gazetteers
of endings, calling codes and issuers, and words nearby. Expectation-maximisation over the votes estimates how reliable
each labeler is for each kind, without labels, and with that how likely each pattern of votes is a hit. Those
probabilities train a logistic regression on features of the spans. Base spans all stay; of the others those that it
accepts are added, where they overlap no base span.

Both fits see counts only: of vote patterns (``3^5`` a kind at most), and of votes with features (a bit each), so what
reaches the driver doesn't grow with the texts. Texts are read once and never moved: what is shuffled are candidates, a
match and its surroundings.

Positions come from ``split``: what lies between matches, and the matches, add up to the text. Quantifiers are possessive
where nothing follows, so that long runs neither recurse nor are tried again from each of their characters.
"""

from __future__ import annotations

from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.session import settle

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_DOMAIN = "A-Za-z0-9-"
#: (kind, pattern, is it the base pattern?). A base match that fails its check is a looser candidate of a card, else none.
PATTERNS = (
    ("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_DOMAIN}]++(?:\.[{_DOMAIN}]++)++", True),
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}\x20?[\[(](?i:at)[\])]\x20?[{_DOMAIN}]{{1,63}}(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[{_DOMAIN}]{{1,63}}){{1,8}}", False),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", False),
)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"

#: Gazetteers: endings of domains, first digits of cards by issuer, calling codes.
ENDINGS = "com org net edu gov mil int info biz io ai app dev de fr es it nl be ch at uk ie pt pl cz se no dk fi ru ua tr us ca mx br ar au nz jp cn in kr za"
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3[068]|35|6011|64[4-9]|65|62)"
CODES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-3]|5[09][0-9]|67[0-9]|85[0-9]|88[0-9]|9[679][0-9])"
RESERVED = r"^0*(?:0|10|127|255|192\.0*168|169\.0*254|172\.0*(?:1[6-9]|2[0-9]|3[01]))\."
#: Words before a span that speak for its kind, and such that speak against any.
FOR = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|kontakt|correo|courriel|write|reach|from|to)\b\W*$",
    "ip": r"(?i)\b(?:ip|address|adresse|host|server|client|login|from|ping)\b\W*(?:\w+\W+)?$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit|debit|pay|paid)\b\W*(?:\w+\W+)?$",
    "phone": r"(?i)\b(?:phone|tel|telefon|telephone|call|mobile|cell|fax|whatsapp|handy|contact)\b\W*(?:\w+\W+)?$",
}
AGAINST = r"(?i)\b(?:version|release|order|invoice|isbn|issn|ref|item|serial|token|hash|commit|section|figure|table|doi|id|no|nr)\b\W*$"

LABELERS = ("format", "gazetteer", "words", "against", "edges")
FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "base", "parted", "near", "far", "glued", "first", "known")
#: Rounds of expectation-maximisation, steps and L2 of the regression, and the score from which a span is added.
ROUNDS, STEPS, L2 = 40, 60, 1e-3
THRESHOLD = 0.5
#: Characters looked at before and after a span.
BEFORE, AFTER = 40, 8


# -- candidates --------------------------------------------------------------------------------------------------------


def _matches(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Matches of a pattern with the length of the gap before each and what lies around it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(F.arrays_zip(found.alias("match"), gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("rest")), lambda x: F.struct(
        F.lit(kind).alias("kind"), F.lit(base).alias("strict"), x["match"].alias("match"), F.length(x["gap"]).alias("gap"),
        F.right(x["gap"], F.lit(BEFORE)).alias("left"), F.left(x["rest"], F.lit(AFTER)).alias("right")))
    # what follows the last match is zipped with no match
    rows = F.filter(rows, lambda x: x["match"].isNotNull())
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(_ROWS))


_ROWS = "array<struct<kind:string,strict:boolean,match:string,gap:int,left:string,right:string>>"


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def proposals(text: Column) -> Column:
    """All patterns' matches in a text."""
    return F.flatten(F.array(*(_matches(F.coalesce(text, F.lit("")), *p) for p in PATTERNS)))


def candidates(rows: DataFrame) -> DataFrame:
    """From ``(row, hits)``: ``(row, kind, start, end, base, votes, features)``, one row per proposed span."""
    # the patterns' matches are told apart by kind and strictness
    hits = rows.select("row", F.posexplode("hits").alias("at", "hit")).select("row", "at", "hit.*")
    before = Window.partitionBy("row", "kind", "strict").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("match")
    start = F.coalesce(F.sum(F.col("gap") + length).over(before), F.lit(0)) + F.col("gap")
    hits = hits.withColumns({"start": start.cast("long"), "digits": F.regexp_replace("match", "[^0-9]", "")})
    hits = hits.withColumn("end", F.col("start") + length)

    kind, digits = F.col("kind"), F.col("digits")
    many = F.length(digits)
    valid = (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.col("match").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", _luhn(digits))
        .otherwise(many.between(9, 15)))
    hits = hits.withColumn("base", F.col("strict") & valid)
    hits = hits.where("base or not strict or kind = 'card'")

    ending = F.regexp_extract(F.lower("match"), r"([a-z]+)\W*$", 1)
    known = (
        F.when(kind == "email", ending.isin(ENDINGS.split()))
        .when(kind == "ip", ~F.col("match").rlike(RESERVED))
        .when(kind == "card", digits.rlike(ISSUERS))
        .otherwise((digits.rlike(CODES) & F.col("match").startswith("+")) | (many == 10)))
    words = F.coalesce(*(F.when(kind == k, F.col("left").rlike(p)) for k, p in FOR.items()))
    against = F.col("left").rlike(AGAINST)
    glued = F.col("left").rlike(r"[A-Za-z0-9_]$") | F.col("right").rlike(r"^[A-Za-z0-9_]")
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    votes = {
        "format": vote(F.col("base"), F.col("strict")),
        "gazetteer": vote(known, ~known),
        "words": vote(words),
        "against": vote(F.lit(False), against),
        "edges": vote(~glued, glued),
    }
    bits = {f"is_{k}": kind == k for k in KINDS} | {
        "base": F.col("base"), "parted": F.col("match").rlike(r"[\x20().-]"), "near": words, "far": against, "glued": glued,
        "first": F.col("left").rlike(r"(?:^|\n)\s*$"), "known": known,
    }
    feature = F.concat(*(F.when(bits[f], "1").otherwise("0") for f in FEATURES))
    return hits.select("row", "kind", "start", "end", "base", F.array(*(votes[v] for v in LABELERS)).alias("votes"), feature.alias("features"))


# -- fits, on counts ---------------------------------------------------------------------------------------------------


def reliabilities(counts: dict[tuple, float]) -> dict[tuple, float]:
    """From counts of vote patterns (tuples of -1, 0, 1), the probability of each that its spans are hits: labelers vote
    independently given the truth, each with three probabilities for a hit and three for none."""
    chance = {v: 1 / (1 + exp(-sum(v))) for v in counts}
    for _ in range(ROUNDS):
        whole = sum(counts.values())
        hits = sum(n * chance[v] for v, n in counts.items())
        prior = (hits + 1) / (whole + 2)
        given = []
        for truth in (1, 0):
            weight = {v: n * (chance[v] if truth else 1 - chance[v]) for v, n in counts.items()}
            total = sum(weight.values())
            given.append([{x: (sum(w for v, w in weight.items() if v[i] == x) + 1) / (total + 3) for x in (-1, 0, 1)} for i in range(len(LABELERS))])
        for v in counts:
            odds = log(prior / (1 - prior)) + sum(log(given[0][i][x] / given[1][i][x]) for i, x in enumerate(v))
            chance[v] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return chance


def span_weights(rows: list[tuple[str, float, float]]) -> tuple[list[float], float]:
    """Weights of the features and intercept by Newton steps, from ``(features, count, probability)``."""
    x = np.array([[float(c) for c in f] + [1.0] for f, _, _ in rows])
    n, p = (np.array([r[i] for r in rows], float) for i in (1, 2))
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        y = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) - L2 * n.sum() * w
        curve = (x * (n * y * (1 - y))[:, None]).T @ x + (L2 * n.sum() + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def train(found: DataFrame) -> tuple[list[float], float]:
    """The span classifier of settled candidates."""
    counted = found.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by construction
    patterns: dict[str, dict[tuple, float]] = {}
    for r in counted:
        own = patterns.setdefault(r["kind"], {})
        own[tuple(r["votes"])] = own.get(tuple(r["votes"]), 0) + r["n"]
    chance = {k: reliabilities(own) for k, own in patterns.items()}
    rows = [(r["features"], r["n"], chance[r["kind"]][tuple(r["votes"])]) for r in counted]
    return span_weights(rows) if rows else ([0.0] * len(FEATURES), -30.0)


def score(weights: list[float], intercept: float) -> Column:
    total = F.lit(intercept)
    for i, w in enumerate(weights):
        total = total + F.substring("features", i + 1, 1).cast("double") * F.lit(w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


# -- spans -------------------------------------------------------------------------------------------------------------


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``spans``, an array of ``(kind, start, end, base, score)`` by kind in the
    order of ``KINDS``, then start; offsets in code points, ends exclusive."""
    # rows get numbers where candidates are written, so both come from one reading
    marked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    slim, _ = settle(marked.select("row", "id", proposals(F.col("text")).alias("hits")))
    found, _ = settle(candidates(slim))
    scored = found.withColumn("score", score(*train(found)))
    inside = Window.partitionBy("row").orderBy("start")
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(inside.rowsBetween(1, Window.unboundedFollowing))
    free = ~F.coalesce((earlier > F.col("start")) | (later < F.col("end")), F.lit(False))
    scored = scored.withColumn("free", free).where(F.col("base") | (F.col("free") & (F.col("score") >= threshold)))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("place")
    lists = scored.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(place, "start", "end", "kind", "base", "score"))).alias("spans"))
    lists, _ = settle(lists)
    named = slim.select("row", "id").join(lists, "row", "left")
    spans = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    return named.select(F.col("id").alias(key), F.coalesce(spans, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>")).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def pii_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, counts of base spans by kind, the SHA-256 of the base spans, and all spans.

    A null text counts as empty and has none. Repeated rows give repeated rows; other columns are not read; an empty
    table gives an empty one.
    """
    found = find_pii(docs, text, key)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(key, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))

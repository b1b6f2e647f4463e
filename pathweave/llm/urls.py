"""URL filter: rules first, and gradient-boosted trees on lexical features for what no rule decides.

The trees learn from labelled URLs, by default those that rules decide. All features are counts and ratios over the
characters of a URL, and how often labelled URLs of its host's suffixes are blocked, smoothed towards the whole rate; in
learning, a URL's own labels are left out of that. Rates count all labelled URLs, the trees learn from a bounded sample of
distinct ones, and all URLs are scored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.text import lower_ascii
from pathweave.session import settle, small

#: (allowed, host, path) of the rules; hosts cover their subdomains.
RULES = (
    (True, "org", "/"),
    (False, "example.org", "/es/"),
    (False, "example.org", "/en/1"),
    (True, "com", "/fr/"),
    (False, "com", "/de/"),
)
#: Distinct labelled URLs that the trees learn from at most, those with the smallest hashes, half of them of either label
#: if there are so many; trees, their depth, and the step.
SAMPLE = 20_000
TREES, DEPTH, STEP = 20, 4, 0.2
#: Copies of a labelled URL that weigh in learning at most.
COPIES = 16
#: Labels that a suffix's rate is smoothed with.
SMOOTH = 10.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; line breaks are characters like others."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``(allowed, rule)``; null: none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    found = [F.struct(F.lit(allowed).alias("allowed"), F.lit(h + p).alias("rule")) for allowed, h, p in longest]
    return F.coalesce(*(F.when(f, s) for f, s in zip(fits, found)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    letters = F.array_distinct(F.split(text, ""))
    counts = F.transform(letters, lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(n > 0, F.log2(n) - bits / n).otherwise(0.0)


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": n,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "query_length": F.length(query).cast("double"),
        "labels": _count(host, "[^.]+"),
        "depth": _count(path, "/"),
        "parameters": _count(query, "[^&]+"),
        "digits": _count(url, "[0-9]") / F.greatest(n, F.lit(1.0)),
        "path_digits": _count(path, "[0-9]"),
        "hyphens": _count(host, "-"),
        "marks": _count(url, r"[^A-Za-z0-9./:]"),
        "capitals": _count(url, "[A-Z]"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": url.startswith("https").cast("double"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
    }


#: Suffixes of a host: its last label and its last two.
SUFFIXES = {"suffix1": -1, "suffix2": -2}


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (with ``url``, ``host``, ``path``) with lexical features and suffixes."""
    url = F.coalesce("url", F.lit(""))
    lexical = _lexical(url, F.col("host"), F.col("path"))
    suffixes = {name: F.substring_index("host", ".", n) for name, n in SUFFIXES.items()}
    return urls.withColumns(lexical | suffixes)


def _rates(known: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """Labelled and blocked URLs by suffix, combined before the shuffle, and the size of that table."""
    suffix = F.substring_index("host", ".", SUFFIXES[name]).alias(name)
    table, seen = settle(known.groupBy(suffix).agg(F.sum("n").alias(f"{name}_n"), F.sum("b").alias(f"{name}_b")))
    return table, seen


def _with_rates(rows: DataFrame, tables: dict[str, tuple[DataFrame, dict]], rate: float, own: bool) -> DataFrame:
    """``rows`` with the suffixes' smoothed rates; ``own``: without the labels ``n`` and ``b`` of the rows' own URL."""
    for name, (table, size) in tables.items():
        less_n, less_b = (F.col("n"), F.col("b")) if own else (F.lit(0.0), F.lit(0.0))
        n, b = F.coalesce(f"{name}_n", less_n) - less_n, F.coalesce(f"{name}_b", less_b) - less_b
        rows = rows.join(small(table, size), name, "left").withColumn(f"{name}_rate", (b + SMOOTH * rate) / (n + SMOOTH))
        rows = rows.drop(f"{name}_n", f"{name}_b")
    return rows


def _sample(known: DataFrame, seen: dict) -> DataFrame:
    """Distinct URLs of either label with ``blocked`` and ``weight``: at most ``SAMPLE`` rows. A URL weighs by its copies,
    up to ``COPIES``, and by how many URLs of its label are not in the sample."""
    sides = {1.0: (F.col("b"), seen["blocked_urls"]), 0.0: (F.col("n") - F.col("b"), seen["other_urls"])}
    fewer = min(SAMPLE // 2, *(urls for _, urls in sides.values()))
    chosen = []
    for blocked, (copies, urls) in sides.items():
        limit = fewer if urls == fewer else min(urls, SAMPLE - fewer)
        weight = F.least(copies, F.lit(float(COPIES))) * F.lit(urls / limit)
        some = known.where(copies > 0).orderBy(F.xxhash64("url"), "url").limit(limit)
        chosen.append(some.withColumns({"blocked": F.lit(blocked), "weight": weight}))
    return chosen[0].unionByName(chosen[1])


def judged(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """``urls`` with ``blocking``, the trees' probability that a URL is to be blocked.

    ``urls`` has features; ``labelled`` has ``url``, ``host``, ``path`` and ``blocked`` (1.0 or 0.0; null is not used).
    With labels of one kind only, that kind is certain; without labels nothing is blocked.
    """
    label = F.col("blocked")
    known = labelled.where(label.isNotNull()).groupBy("url", "host", "path").agg(F.count(label).cast("double").alias("n"), F.sum(label).alias("b"))
    known, seen = settle(known, n=F.sum("n"), b=F.sum("b"), blocked_urls=F.count_if(F.col("b") > 0), other_urls=F.count_if(F.col("b") < F.col("n")))
    rate = (seen["b"] or 0.0) / max(seen["n"] or 0.0, 1.0)
    if rate in (0.0, 1.0):
        return urls.withColumn("blocking", F.lit(rate))
    tables = {name: _rates(known, name) for name in SUFFIXES}
    names = [*_lexical(F.lit(""), F.lit(""), F.lit("")), *(f"{name}_rate" for name in SUFFIXES)]
    vectors = VectorAssembler(inputCols=names, outputCol="vector")
    trees = GBTClassifier(labelCol="blocked", featuresCol="vector", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=7)
    sample, _ = settle(_sample(known, seen))
    learning, _ = settle(vectors.transform(_with_rates(features(sample), tables, rate, True)).select("vector", "blocked", "weight"))
    model = trees.fit(learning)
    scored = model.transform(vectors.transform(_with_rates(urls, tables, rate, False)))
    return scored.withColumn("blocking", vector_to_array("probability")[1])


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: ``key``, ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    ``labelled`` has ``url`` and ``blocked``; without it, the URLs that rules decide are the labelled ones. A null URL, or
    one without ``://``, has an empty host and path and is judged by the trees; very long ones are read whole. Other columns are not read; repeated rows
    are judged alike; an empty table gives an empty one.
    """
    def parsed(rows: DataFrame) -> DataFrame:
        u = F.coalesce("url", F.lit(""))
        return rows.withColumns({"host": host_of(u), "path": path_of(u)})

    own = parsed(pages.select(F.col(key).alias("key"), F.col(url).alias("url")))
    own = own.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    known = own.where("found is not null").withColumn("blocked", (~F.col("found.allowed")).cast("double")) if labelled is None else parsed(
        labelled.select("url", F.col("blocked").cast("double").alias("blocked")))
    scored = judged(features(own), known.select("url", "host", "path", "blocked"))
    allowed = F.coalesce(F.col("found.allowed"), F.col("blocking") < threshold)
    return scored.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict"))

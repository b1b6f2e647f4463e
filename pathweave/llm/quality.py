"""Quality of documents by hierarchical empirical Bayes: what a document looks like, and where it comes from.

A logistic regression on counts over the text gives each document's own evidence. Evidence is summed by path and host:
here the source is the host and the language its path, the document tables having no addresses. Hosts are shrunk towards
the mean of all, paths towards their host, by a strength that the method of moments reads off the spread of the means:
the less hosts differ beyond chance, the more they are pulled together, and the fewer documents a site has, the more it
is. A document's score adds to its own evidence how much its path differs from all; the document itself is left out of its
path's mean, though not of the mean of the host that this is shrunk towards.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.textstats import text_stats
from pathweave.llm.toxicity import held_out
from pathweave.session import settle, small

#: Labelled documents that are learnt from at most, those with the smallest hashes of their keys.
SAMPLE = 20_000
#: Steps and L2 of the regression, and the score from which a document is kept.
STEPS, L2 = 25, 0.001
THRESHOLD = 0.5
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6

_WORDS = "greatest(stats.n_words, 1)"
#: The regression's inputs, as SQL over the counts; roots and logarithms keep long tails near.
EVIDENCE = {
    "size": "ln(1 + stats.n_words)",
    "symbols": f"sqrt(stats.n_symbols / {_WORDS})",
    "capitals": "stats.n_upper / greatest(stats.word_chars, 1)",
    "marks": f"sqrt(stats.n_marks / {_WORDS})",
    "digits": "stats.n_digits / greatest(stats.word_chars, 1)",
    "copied_lines": "stats.n_dup_lines / greatest(stats.n_lines, 1)",
    "repeats": f"stats.n_repeat_words / {_WORDS}",
    "distinct": f"stats.n_distinct / {_WORDS}",
    "word_length": f"ln(1 + stats.word_chars / {_WORDS})",
}


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def _logit(p: Column) -> Column:
    return F.ln(_clipped(p) / (F.lit(1.0) - _clipped(p)))


def evidence(rows: DataFrame, labels: DataFrame, key: str, label: str = "quality") -> DataFrame:
    """``rows`` (with ``stats``) with ``evidence``, the regression's probability of good quality.

    Labels of one key are averaged; null and held-out ones and those without a document are not used and take no places of
    the sample; keys of equal hash come in their order. Of a key's rows the one whose counts have the smallest hash is
    learnt from. Labels of one kind only make that kind certain;
    without labels the evidence is one half.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("_k")).agg((F.avg(label) >= 0.5).cast("double").alias("_good"))
    known = known.join(rows.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi")
    chosen = known.orderBy(F.xxhash64("_k"), "_k").limit(SAMPLE)
    inputs = {name: F.expr(sql).cast("double") for name, sql in EVIDENCE.items()}
    sample = rows.join(F.broadcast(chosen), F.col(key) == F.col("_k")).select("_k", "_good", F.struct(*(x.alias(n) for n, x in inputs.items())).alias("_in"))
    # one row of each key, so that repeated keys don't make the sample larger; combined before the shuffle
    sample = sample.groupBy("_k", "_good").agg(F.min_by("_in", F.struct(F.xxhash64("_in"), "_in")).alias("_in")).select("_good", "_in.*")
    sample, seen = settle(sample.coalesce(4), good=F.avg("_good"))
    if not seen["rows"] or seen["good"] in (0.0, 1.0):
        return rows.withColumn("evidence", F.lit(0.5 if not seen["rows"] else seen["good"]))
    vectors = VectorAssembler(inputCols=list(inputs), outputCol="_vector").transform(sample)
    model = LogisticRegression(featuresCol="_vector", labelCol="_good", maxIter=STEPS, regParam=L2).fit(vectors)
    total = F.lit(float(model.intercept))
    for weight, value in zip(model.coefficients.toArray().tolist(), inputs.values()):
        total = total + F.lit(weight) * value
    return rows.withColumn("evidence", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))


def strength(groups: DataFrame, centre: Column) -> float:
    """How many documents the prior of ``groups`` (``n``, ``s``) around ``centre`` counts, by the method of moments."""
    mean = F.col("s") / F.col("n")
    apart, noise = groups.where("n > 1").agg(
        F.avg((mean - centre) * (mean - centre)), F.avg(centre * (F.lit(1.0) - centre) / F.col("n"))).first()
    whole = groups.agg(F.avg(centre * (F.lit(1.0) - centre))).first()[0]
    if apart is None or apart <= noise:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, whole / (apart - noise) - 1))


def posteriors(rows: DataFrame) -> tuple[DataFrame, float, float]:
    """From ``(host, path, evidence)``: by path ``(host, path, n, s, host_score)``, the strength of a path's prior, and
    the mean of all. Sums combine before the shuffle."""
    paths, seen = settle(rows.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("evidence").alias("s")), n=F.sum("n"), s=F.sum("s"))
    if not seen["rows"]:
        return paths.withColumn("host_score", F.lit(0.5)), WEAKEST, 0.5
    mean = float(seen["s"] / seen["n"])
    hosts, _ = settle(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    pull = strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("s") + pull * mean) / (F.col("n") + pull)).alias("host_score"))
    joined, _ = settle(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"))
    return joined, strength(joined, F.col("host_score")), mean


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``held_out``, ``evidence``, ``host_score``, ``path_score`` (of the path's other
    documents, shrunk towards the host), ``score`` (0 to 1) and ``kept``.

    A null text counts as empty, very long ones are counted whole; null hosts are one host, null paths one path of each host. Repeated rows are scored
    alike; other columns are not read; an empty table gives an empty one.
    """
    slim = text_stats(docs.select(F.col(key).alias("_key"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("_text")), "_text").drop("_text")
    slim, _ = settle(slim)
    rows, _ = settle(evidence(slim, labels.withColumnRenamed(key, "_key"), "_key").select("_key", "host", "path", "evidence"))
    sites, pull, mean = posteriors(rows)
    sites, seen = settle(sites)
    sites = small(sites.withColumnRenamed("host", "_host").withColumnRenamed("path", "_path"), seen)
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    others = (F.col("s") - F.col("evidence") + F.lit(pull) * F.col("host_score")) / (F.col("n") - 1 + F.lit(pull))
    scored = joined.withColumn("path_score", others)
    total = _logit(F.col("evidence")) + _logit(F.col("path_score")) - _logit(F.lit(mean))
    scored = scored.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
    return scored.select(F.col("_key").alias(key), held_out("_key").alias("held_out"), "evidence", "host_score", "path_score", "score", (F.col("score") >= threshold).alias("kept"))

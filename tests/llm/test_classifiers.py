import math
import random
import zlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathweave.llm import quality, rules, textstats, toxicity, urls

WORDS = [f"w{i}" for i in range(400)]


def labelled(spark, bad, n=600, seed=1):
    """Documents of which a fifth are bad in the way ``bad(rng, words)`` makes them, and labels for most."""
    rng = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(25, 80))]
        worse = rng.random() < 0.2
        docs.append((i, bad(rng, words) if worse else " ".join(words), rng.choice(["en", "de"]), f"s{i % 7}", 1.0))
        truth.append((i, int(not worse), int(worse)))
    docs += [(None, "x", "en", None, 0.0), (n, None, None, "s1", 0.0), (n + 1, "", "en", "s1", 0.0), (0, docs[0][1], "en", "s0", 0.0)]
    labels = truth[: n * 9 // 10] + [(None, 1, 0), (3, None, None), (3, truth[3][1], truth[3][2])]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {t[0]: t for t in truth}, docs)


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_on_held_out_documents(spark):
    docs, labels, truth, rows = labelled(spark, lambda rng, w: " ".join([*w[:20], "You", rng.choice(["rotten!", "vile.", "VILEST"]), *w[20:]]))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and out(r["doc_id"])) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]][2]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) > 0.97
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r["predicted"] == 0 for r in got)
    assert {r["score"] for r in left.collect()} <= {0.0, 1.0}  # the table's own column of that name


def test_toxicity_without_labels_or_documents(spark):
    docs, labels, _, rows = labelled(spark, lambda rng, w: "bad", 20)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)


def test_ftrl_is_sparse():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) + (" awful" if i % 4 == 0 else "") for i in range(400)]
    at, w = toxicity.fit([t.encode() for t in texts], [float(i % 4 == 0) for i in range(400)], [1.0] * 400)
    assert len(at) < 2_000
    assert dict(zip(at.tolist(), w.tolist()))[int(toxicity.buckets_of(b"awful")[0])] > 0.5


def test_ftrl_does_not_depend_on_how_many_labels_a_sample_stands_for():
    rng = random.Random(4)

    def text(toxic):
        words = [rng.choice(WORDS) for _ in range(30)]
        return " ".join([*words[:9], rng.choice(["awful", "rotten", "vile"]), *words[9:]] if toxic else words).encode()

    truth = [float(i % 2) for i in range(3000)]
    texts, held = [text(y) for y in truth], [(text(i % 2), i % 2) for i in range(600)]
    sizes, recalls, false = [], [], []
    for total in (10**4, 10**7):  # a tenth of the labels toxic
        weights = [total * (0.1 if y else 0.9) / 1500 for y in truth]
        at, w = toxicity.fit(texts, truth, weights)
        dense = np.zeros(toxicity.BUCKETS + 1)
        dense[at] = w
        scores = [dense[np.unique(toxicity.buckets_of(t))].sum() + dense[toxicity.BUCKETS] for t, _ in held]
        called = [1 / (1 + np.exp(-x)) >= toxicity.THRESHOLD for x in scores]
        sizes.append(len(at))
        recalls.append(np.mean([c for c, (_, y) in zip(called, held) if y]))
        false.append(np.mean([c for c, (_, y) in zip(called, held) if not y]))
    assert min(recalls) > 0.95 and max(false) < 0.05, (recalls, false)
    assert max(sizes) < 2_000 and max(sizes) <= 1.1 * min(sizes), sizes


def _seen(settled, sizes, metrics):
    sizes.extend([settled[1]["rows"]] if "good" in metrics else [])
    return settled


def _count_task(batches):
    n = sum(b.num_rows for b in batches)
    yield pa.RecordBatch.from_arrays([pa.array([[n]], pa.list_(pa.int64())), pa.array([[0.0]], pa.list_(pa.float64()))], names=["places", "weights"])


def test_repeated_keys_do_not_enlarge_the_sample(spark, monkeypatch):
    docs, labels, truth, rows = labelled(spark, lambda rng, w: " ".join([*w[:20], "rotten", *w[20:]]), 200)
    hot = next(r for r in rows if r[0] is not None and r[0] > 3 and r[0] < 180 and not out(r[0]))
    more = spark.createDataFrame([(hot[0], f"{hot[1]} x{i % 3}", *hot[2:]) for i in range(300)], docs.schema)
    sizes = []
    kept = quality.settle
    monkeypatch.setattr(quality, "settle", lambda df, **m: _seen(kept(df, **m), sizes, m))
    quality.quality(docs.unionByName(more), labels)
    usable = {r["doc_id"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None and not out(r["doc_id"])}
    assert sizes == [len(usable)]
    monkeypatch.setattr(toxicity, "_fit_task", _count_task)
    assert toxicity.train(docs.unionByName(more), labels)[0].tolist() == [len(usable)]


def plain_stats(text):
    text = text or ""
    ws = " \t\n\r\x0b\x0c"
    words = "".join("\0" if c in ws else c for c in text).split("\0")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x.strip(ws)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + j for starts in windows.values() if len(starts) > 1 for i in starts for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_plain_ones():
    rng = random.Random(9)
    parts = ["a", "b", "é", "日", "#", "|", " ", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "word", "!"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        assert textstats.stats_of(text.encode())[:5] == plain_stats(text), text
    long = " ".join(rng.choice("abc") for _ in range(3000))
    assert textstats.stats_of(long.encode())[:5] == plain_stats(long)
    assert textstats.stats_of(None) == (0,) * len(textstats.NAMES)


def test_rules_keep_good_documents(spark):
    docs, labels, truth, rows = labelled(spark, lambda rng, w: " ".join(x + "***" for x in w), 4000)
    got = rules.quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        base = plain_stats(text[r["doc_id"]])
        assert tuple(r)[1:6] == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i, t in truth.items() if t[1])
    assert np.mean([kept[i] for i, t in truth.items() if not t[1]]) < 0.1
    assert rules.quality_rules(docs.limit(0), labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in rules.quality_rules(docs, labels.limit(0)).collect())


def test_no_language_takes_cutoffs_certified_on_others(spark):
    rng = random.Random(5)
    docs, labels = [], []

    def add(lang, shout, quality=None):
        words = [rng.choice(WORDS) + rng.choice(["ab", "cd"]) for _ in range(30)]
        docs.append((len(docs), " ".join(w.upper() if shout else w for w in words), lang))
        if quality is not None:
            labels.append((len(docs) - 1, quality))

    for lang, n in [*((f"a{i}", 51) for i in range(32)), *((f"b{i}", 50) for i in range(26))]:  # 1,300 good ones in b
        for _ in range(n):
            add(lang, False, 1)
    for _ in range(200):
        add("b0", True, 0)
    for _ in range(50):
        add("xx", True)  # capitals are how this language is written; nothing in it is labelled
    got = rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in got.collect()}
    assert len(kept) == len(docs)
    assert all(k != failed for k, failed in kept.values())  # no language has enough labels for a cutoff


def test_certified_is_the_exact_bound():
    def exact(k, n, p):
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for n in (0, 10, 150, 600):
        for k in range(0, min(n, 12) + 1):
            for limit in (0.01, 0.05):
                want = k < n * limit and exact(k, n, limit) <= 0.01
                assert rules.certified(k, n, limit, 0.01) == want, (k, n, limit)


def test_quality_combines_text_and_site(spark):
    docs, labels, truth, rows = labelled(spark, lambda rng, w: " ".join(x.upper() + "!!" for x in w))
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    held = [(r["kept"], truth[r["doc_id"]][1]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([k == bool(t) for k, t in held]) > 0.97
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).count() == len(rows)


def test_sparse_sites_are_shrunk_more(spark):
    rows = [("good", "p", 0.95)] * 400 + [("bad", "p", 0.05)] * 400 + [("few", "p", 0.05)] * 2 + [("mid", "p", 0.5)] * 300
    sites, pull, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    host = {r["host"]: r["host_score"] for r in sites.collect()}
    assert host["good"] > 0.9 and host["bad"] < 0.1 and host["bad"] < host["few"] < mean


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]


def plain_rule(host, path):
    best = None
    for allowed, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = ("allow" if allowed else "block", h + p)
    return best


def test_urls_against_plain_rules(spark):
    rng = random.Random(6)
    odd = [None, "", "no scheme", "://", "http://", "http://A.Example.ORG", "http://example.org?x", "http://org/", "http://x.org#/es/", "http://a://b/c", "http://example.org/en/1",
           "http://EXAMPLE.org/es/\n1", "http://notorg/es/", "http://com/fr/x", "ftp://é.com/de/", "http://h.net/" + "a" * 20_000]
    rows = [(i, u, "h", "v") for i, u in enumerate(odd)]
    for i in range(400):
        host = rng.choice(["", "www.", "Blog."]) + rng.choice(["abc", "spam-pills", "x9"]) + rng.choice([".example.org", ".example.com", ".net", ".com"])
        rows.append((100 + i, f"http://{host}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randint(1, 999)}" + rng.choice(["", "?a=1&b=2", "#top"]), "h", "v"))
    rows.append(rows[-1])
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = urls.filter_urls(pages).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    url = {r[0]: r[1] for r in rows}
    for r in got:
        host, path = plain_parts(url[r["page_id"]])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule and rule[1]) and r["verdict"] in ("allow", "block")
        assert rule is None or r["verdict"] == rule[0]
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_trees_learn_from_labels(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        bad = rng.random() < 0.4
        host = ("cheap-%d-pills-%d.biz" % (rng.randint(0, 99), rng.randint(0, 9))) if bad else rng.choice(["news", "blog", "docs"]) + ".site.info"
        rows.append((i, f"http://{host}/p/{rng.randint(1, 99)}", float(bad)))
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked double")
    got = urls.filter_urls(pages.where("page_id >= 800"), rules=((True, "none.such", "/"),), labelled=pages.where("page_id < 800"))
    right = got.join(pages, "page_id").where((F.col("verdict") == "block") == (F.col("blocked") == 1.0)).count()
    assert right > 390


NONE = ((True, "none.such", "/"),)


def test_suffix_rates_count_all_labelled_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE", 200)
    # so many hosts that few of them are in the sample, each wholly blocked or not, whatever the URL looks like
    rows = [(h, f"http://www.h{1000 + h}/p/{1000 + i}", float(h % 2)) for h in range(400) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked double")
    asked = spark.createDataFrame([(h, f"http://www.h{1000 + h}/p/9999") for h in range(400)], "page_id long, url string")
    got = urls.filter_urls(asked, rules=NONE, labelled=pages).collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got]) > 0.95


def test_a_repeated_url_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE", 200)
    rows = [(i, f"http://site{i % 7}.info/{'spam/' if i % 3 == 0 else ''}{i}", float(i % 3 == 0)) for i in range(900)]
    table = spark.createDataFrame(rows, "page_id long, url string, blocked double")
    # the URL that comes first by hash is the hot one
    hot = table.orderBy(F.xxhash64("url"), "url").limit(1).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("x")
    got = urls.filter_urls(table, rules=NONE, labelled=table.unionByName(hot)).collect()
    assert np.mean([(r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got]) > 0.95


def test_entropy(spark):
    rows = [("aabb", 1.0), ("aaaa", 0.0), ("abcd", 2.0), ("", 0.0)]
    got = spark.createDataFrame(rows, "t string, e double").select(urls._entropy(F.col("t")).alias("x"), "e").collect()
    assert all(abs(r["x"] - r["e"]) < 1e-9 for r in got)


def plain_ftrl(texts, labels, passes):
    """FTRL-proximal one coordinate at a time."""
    z, n = {}, {}
    last = toxicity.BUCKETS

    def weight(i):
        l1 = 0.0 if i == last else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(passes):
        for text, y in zip(texts, labels):
            features = sorted(set(toxicity.buckets_of(text).tolist())) + [last]
            before = [weight(i) for i in features]
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(before))))) - y
            for i, w in zip(features, before):
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old ** 0.5) / toxicity.ALPHA * w
    return {i: weight(i) for i in z if weight(i)}


def test_fit_equals_plain_ftrl():
    rng = random.Random(12)
    texts = [" ".join(rng.choice(WORDS[:60]) for _ in range(25)) + (" awful thing" if i % 3 == 0 else "") for i in range(50)] + [""]
    labels = [float(i % 3 == 0) for i in range(51)]
    texts = [t.encode() for t in texts]
    at, w = toxicity.fit(texts, labels, [1.0] * 51)
    want = plain_ftrl(texts, labels, toxicity.MOST_PASSES)
    got = dict(zip(at.tolist(), w.tolist()))
    assert len(want) > 5 and set(got) == set(want)
    assert all(abs(got[i] - x) < 1e-9 for i, x in want.items())


def test_labels_of_absent_documents_take_no_places(spark, monkeypatch):
    docs, labels, truth, rows = labelled(spark, lambda rng, w: " ".join([*w[:20], "rotten", *w[20:]]), 300)
    absent = spark.range(10**6, 10**6 + 20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 100)
    monkeypatch.setattr(quality, "SAMPLE", 200)
    sizes, kept = [], quality.settle
    monkeypatch.setattr(quality, "settle", lambda df, **m: _seen(kept(df, **m), sizes, m))
    quality.quality(docs, labels.unionByName(absent))
    assert sizes == [200]
    monkeypatch.setattr(toxicity, "_fit_task", _count_task)
    usable = [t for t in truth.values() if t[0] < 270 and not out(t[0])]
    toxic = sum(t[2] for t in usable)
    assert toxicity.train(docs, labels.unionByName(absent))[0].tolist() == [min(100, toxic) + 100]


def test_a_repeated_labelled_document_is_evidence_once(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(700):  # enough good documents for a cutoff; those that are bad are of symbols
        bad = i % 10 == 0
        words = [rng.choice(WORDS) + ("***" if bad else "") for _ in range(40)]
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad)))
    few = [(1000 + i, d[1], "de") for i, d in enumerate(docs[:40])]
    tables = [spark.createDataFrame(rows, "doc_id long, text string, lang string") for rows in (docs + few, few[1:2])]
    labelled_docs = spark.createDataFrame(labels + [(1000 + i, lab[1]) for i, lab in enumerate(labels[:40])], "doc_id long, quality int")
    copies = tables[1].withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(1000)))).drop("x")
    got = rules.quality_rules(tables[0].unionByName(copies), labelled_docs).collect()
    kept = {}
    for r in got:
        kept.setdefault(r["doc_id"], set()).add(r["kept"])
    # 36 good documents certify nothing, however often one of them is repeated
    assert all(kept[1000 + i] == {True} for i in range(40))
    assert len(got) == 740 + 1000 and all(len(k) == 1 for k in kept.values())


def test_null_and_empty_languages_are_two_strata(spark):
    docs = [(i, " ".join(random.Random(i).choice(WORDS) for _ in range(30)), None if i % 2 else "") for i in range(60)]
    slim = textstats.text_stats(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "text")
    found = rules.learn(slim, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int"))
    assert {r["cut_stratum"] for r in found.collect()} == {"", "="}


def test_very_long_texts_are_read_whole(spark):
    docs, labels, truth, rows = labelled(spark, lambda rng, w: " ".join([*w[:20], "rotten", *w[20:]]), 300)
    long = " ".join(WORDS) * 400 + " rotten " + " ".join(WORDS)
    more = spark.createDataFrame([(9_000_001, long, "en", "s1", 0.0)], docs.schema)
    every = docs.unionByName(more)
    found = toxicity.toxicity(every, labels).where("doc_id = 9000001").first()
    clean = toxicity.toxicity(docs.unionByName(more.withColumn("text", F.replace("text", F.lit("rotten"), F.lit("")))), labels).where("doc_id = 9000001").first()
    assert found["score"] > clean["score"]
    judged = rules.quality_rules(every, labels).where("doc_id = 9000001").first()
    assert tuple(judged)[1:6] == plain_stats(long)
    assert 0 <= quality.quality(every, labels).where("doc_id = 9000001").first()["score"] <= 1


def plain_strength(groups):
    """The method of moments over ``(n, s, centre)``."""
    some = [(n, s, c) for n, s, c in groups if n > 1]
    apart = np.mean([(s / n - c) ** 2 for n, s, c in some])
    noise = np.mean([c * (1 - c) / n for n, s, c in some])
    whole = np.mean([c * (1 - c) for _, _, c in groups])
    return min(quality.STRONGEST, max(quality.WEAKEST, whole / (apart - noise) - 1)) if apart > noise else quality.STRONGEST


def test_posteriors_equal_plain_moments(spark):
    rng = random.Random(6)
    rows = []
    for h in range(6):
        for p in range(4):
            centre = min(0.95, max(0.05, rng.gauss(0.15 + 0.13 * h, 0.1)))
            rows += [(None if h == 5 else f"h{h}", f"p{p}", float(rng.random() < centre)) for _ in range(rng.choice((1, 3, 20, 60)))]
    sites, pull, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    assert abs(mean - np.mean([r[2] for r in rows])) < 1e-12

    def grouped(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, s + r[2]
        return out

    hosts, paths = grouped(lambda r: r[0]), grouped(lambda r: r[:2])
    k = plain_strength([(n, s, mean) for n, s in hosts.values()])
    host = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    want = plain_strength([(n, s, host[h]) for (h, _), (n, s) in paths.items()])
    assert abs(pull - want) < 1e-6 * want
    got = {(r["host"], r["path"]): (r["n"], r["s"], r["host_score"]) for r in sites.collect()}
    assert set(got) == set(paths)
    assert all(got[x][:2] == paths[x] and abs(got[x][2] - host[x[0]]) < 1e-9 for x in paths)

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def kneser_ney(texts):
    """Plain recursion over the same byte classes."""
    top = Counter()
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        for g in quality.grams(b, np.array([0, len(b)])).tolist():
            top[tuple(g >> 6 * k & 63 for k in (3, 2, 1, 0))] += 1
    orders = {4: top}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    stats = {}
    for k, c in orders.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]
        total, cut = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            cut[g[:-1]] += d[min(x, 3) - 1]
        stats[k] = c, d, total, cut

    def p(g):
        if not g:
            return 1 / 64
        c, d, total, cut = stats[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        own = (c[g] - d[min(c[g], 3) - 1]) / total[g[:-1]] if c[g] else 0
        return own + cut[g[:-1]] / total[g[:-1]] * p(g[1:])

    def perplexity(t):
        b = np.frombuffer(t.encode(), np.uint8)
        g = quality.grams(b, np.array([0, len(b)])).tolist()
        return math.exp(-sum(math.log(p(tuple(x >> 6 * k & 63 for k in (3, 2, 1, 0)))) for x in g) / len(g))

    return perplexity


def test_perplexity_against_plain_kneser_ney(spark, odd_docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(30)] + [(4, 0, 0), (None, 1, 0), (999, 1, 0)], LABELS)
    good = quality.trusted(odd_docs, labels)
    texts = [r.text for r in good.collect()]
    score = kneser_ney(texts)
    got = quality.scores(odd_docs, quality.model(quality.gram_counts(good)), ["doc_id"]).collect()
    text = defaultdict(list)
    for r in odd_docs.collect():
        text[r.doc_id].append(r.text or "")
    for r in got:
        if r.n_bytes == 0:
            assert r.perplexity is None or math.isnan(r.perplexity)
        else:
            assert any(len(t.encode()) == r.n_bytes and abs(score(t) - r.perplexity) < 1e-3 * r.perplexity for t in text[r.doc_id])


def test_every_row_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS)
    out = quality.classify(odd_docs, labels)
    assert out.count() == odd_docs.count()
    assert {r.doc_id for r in out.filter("not keep").collect()} >= {200, 201}
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.classify(odd_docs, labels.limit(0)).filter(F.col("keep")).count() == odd_docs.filter("length(text) > 0").count()


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    out = quality.classify(docs, half).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rates = {r.quality: r.kept for r in out.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert rates[0] < 0.1 and rates[1] > 0.97


def test_thresholds_and_decisions_against_plain_python(spark):
    """Quantiles by rank, smoothing and limits by language, once more without Spark; long, empty and odd texts included."""
    rng = random.Random(4)
    words = {"en": ["the", "of", "house", "and", "tree", "walking"], "de": ["der", "und", "Häuser", "baum", "gehen"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 60))), lang) for i, lang in enumerate(["en"] * 80 + ["de"] * 30)]
    rows += [(200 + i, "".join(rng.choice("qxzj#%@ ") for _ in range(n)), ("en", "de", None)[i % 3]) for i, n in enumerate([1, 5, 40, 400, 3000, 20000])]
    rows += [(300, None, "en"), (301, "", "de"), (302, " ".join(rng.choice(words["en"]) for _ in range(20000)), "en"), (303, "the house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {i for i, _, _ in rows[:110] if i % 5} | {303}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i, _, _ in rows[:110]] + [(303, 1, 0)], LABELS)
    score = kneser_ney([t for i, t, _ in rows if i in good])
    raw = {i: score(t) if t else None for i, t, _ in rows}
    size = {i: len((t or "").encode()) for i, t, _ in rows}
    rank = lambda values, q: sorted(values)[max(math.ceil(q * len(values)) - 1, 0)]
    own = defaultdict(list)
    for i, _, lang in rows:
        if i in good:
            own[lang].append(i)
    overall = rank([raw[i] for i in good], 0.5)
    usual = {lang: rank([raw[i] for i in ids], 0.5) for lang, ids in own.items() if len(ids) >= quality.LEAST}
    assert set(usual) == {"en"}
    smooth = {i: math.exp((math.log(raw[i]) * size[i] + math.log(usual.get(lang, overall)) * quality.SMOOTHING) / (size[i] + quality.SMOOTHING)) for i, _, lang in rows if raw[i]}
    limit = {lang: rank([smooth[i] for i in own[lang]], quality.QUANTILE) * quality.SLACK for lang in usual}
    top = rank([smooth[i] for i in good], quality.QUANTILE) * quality.SLACK
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert set(got) == set(raw)
    for i, _, lang in rows:
        most = limit.get(lang, top)
        assert abs(got[i].threshold - most) < 2e-3 * most, i
        want = raw[i] is not None and smooth[i] <= most
        assert got[i].keep == want or abs(smooth[i] - most) < 2e-3 * most, i
    assert got[302].keep and got[303].keep and not got[204].keep and not got[205].keep and not got[300].keep
    kept = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    assert kept == {i for i in got if got[i].keep}


def test_scores_are_joined_and_no_model_is_sent(spark, odd_docs, monkeypatch):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], LABELS)
    fitted = quality.materialize(quality.model(quality.gram_counts(quality.trusted(odd_docs, labels))), "model")

    def none(*_, **__):
        raise AssertionError("the model goes through the driver")

    monkeypatch.setattr(type(fitted), "toPandas", none)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", none)
    rows = lambda: sorted(((r.doc_id, r.n_bytes), r.perplexity) for r in quality.scores(odd_docs.filter("doc_id is not null"), fitted, ["doc_id"]).collect())
    want = rows()
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    got = rows()
    assert [k for k, _ in got] == [k for k, _ in want] and any(x for _, x in want)
    assert all(x == y or abs(x - y) < 1e-6 * y for (_, x), (_, y) in zip(got, want))

import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_mixing import water_fill

from quillspark.llm import decontaminate, mixing, ngram_join, quality

SF = "/root/testdata/sf0.001"


def stage(spark, name, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, SF)


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


def test_quality_keeps_what_it_accepts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = stage(spark, "quality", docs)
    assert out.schema == docs.schema
    want = {r.doc_id for r in quality.classify(docs, labels).filter("keep").collect()}
    assert {r.doc_id for r in out.collect()} == want and 0.7 * docs.count() < len(want) < docs.count()


def test_one_document_of_each_group_stays(spark, odd_docs, no_docs):
    out = stage(spark, "near_duplicates", odd_docs)
    assert out.columns == odd_docs.columns
    rows = ngram_join.join(odd_docs).collect()
    groups = {r.component_id for r in rows if r.n_shingles}
    empty = sum(r.n_shingles == 0 for r in rows)
    got = out.collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in got if (r.text or "").strip())) == sorted((g is None, g or 0) for g in groups)
    assert len(got) == len(groups) + empty
    assert stage(spark, "near_duplicates", no_docs).count() == 0


def test_shuffle_forms_give_the_same(spark, odd_docs, monkeypatch):
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    want = ids(ngram_join.distinct(odd_docs)), ids(mixing.mixed(odd_docs, 64))
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert (ids(ngram_join.distinct(odd_docs)), ids(mixing.mixed(odd_docs, 64))) == want


def test_contaminated_documents_go(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    out = stage(spark, "decontamination", docs)
    gone = {r.doc_id for r in decontaminate.matches(docs, bench).collect()}
    assert out.schema == docs.schema and gone and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - gone


def test_mix_has_its_weights(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    out = stage(spark, "mixing", docs)
    assert out.columns == docs.columns
    n = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    size, got = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        size[r.source] += n(r.text)
    rows = out.collect()
    for r in rows:
        got[r.source] += n(r.text)
    want = water_fill(size, {s: i % 3 + 1 for i, s in enumerate(sorted(size))})
    longest = max(n(r.text) for r in rows)
    assert all(abs(got[s] - want[s]) <= longest for s in size)
    assert max(Counter(r.doc_id for r in rows).values()) <= 3


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.orderBy("start").collect()
    assert rows and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)

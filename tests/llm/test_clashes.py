from pyspark.sql import functions as F

from quillspark.llm import decontaminate, exact, langid, mixing, ngram_join, passages, quality, secrets, tokens

NAMES = ("node", "component", "least", "row", "run", "size", "key", "mark", "target", "taken", "before", "length", "norm", "check", "best", "keep", "kept", "threshold", "perplexity", "n_bytes", "usual", "held_out", "score", "lang_pred", "spans", "item_id", "similarity", "bucket", "a", "b", "g", "n", "id", "quality", "toxic", "start", "copies")


def test_extra_columns_with_clashing_names(spark, odd_docs, tmp_path):
    docs = odd_docs.filter("doc_id is null or doc_id < 10 or doc_id >= 128").withColumns({n: F.lit(i).cast("string") for i, n in enumerate(NAMES)})
    plain = docs.select(*odd_docs.columns)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no id here")], "item_id long, text string")
    same = lambda f: sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
    assert same(exact.dedup) and same(langid.identify) and same(secrets.spans) and same(passages.find)
    assert same(lambda d: quality.classify(d, labels)) and same(lambda d: decontaminate.matches(d, bench))
    assert same(lambda d: mixing.taken_words(d, 64).select("doc_id", "size", "target", "taken"))
    assert same(lambda d: tokens.write(d, f"file://{tmp_path}/{len(d.columns)}").documents())
    for stage in (lambda d: quality.accepted(d, labels), ngram_join.distinct, lambda d: decontaminate.clean(d, bench), lambda d: mixing.mixed(d, 64)):
        out = stage(docs)
        assert out.columns == docs.columns
        ids = lambda d: sorted((r.doc_id is None, r.doc_id or 0) for r in d.select("doc_id").collect())
        assert ids(out) == ids(stage(plain))

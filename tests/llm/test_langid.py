import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_vectors_are_bound_from_permuted_letters():
    a, b, c = langid._LETTERS[3].astype(int), langid._LETTERS[9].astype(int), langid._LETTERS[14].astype(int)
    assert (langid.vectors(np.array([3 << 12 | 9 << 6 | 14]))[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.union(spark.createDataFrame([(900, "123 !?", "en", "x", 1), (901, "中文", "en", "x", 1)], odd_docs.schema))
    got = {r.doc_id: r for r in langid.identify(rows).collect()}
    assert langid.identify(rows).count() == rows.count()
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202, 900))
    assert got[901].lang_pred in ("de", "en")
    assert langid.identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_learned_language_named_und_is_predicted(spark):
    rows = [(i, " ".join(["wosk zby mgla krzew"] * 9) if i % 2 else " ".join(["the lion thing over"] * 9), "und" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, "中文字", None), (101, "1 2 3", "und"), (102, None, "und")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[100][0] in ("en", "und") and got[101] == got[102] == ("und", 0.0)


def test_predictions_against_plain_vectors(spark, odd_docs):
    """Trigram by trigram, with plain sums of bound and rotated letter vectors."""
    docs = odd_docs.select("doc_id", "text", "lang").filter("doc_id is not null")
    rows = docs.withColumn("held", langid.held_out()).collect()

    def vector(text):
        out = np.zeros(langid.DIMENSIONS)
        codes = [0]
        for b in (text or "").encode():
            if langid._CODES[b] or codes[-1]:
                codes.append(int(langid._CODES[b]))
        codes += [0, 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b:
                out += np.roll(langid._LETTERS[a], 2) * np.roll(langid._LETTERS[b], 1) * langid._LETTERS[c].astype(float)
        return out

    counts = {}
    for r in rows:
        if not r.held and r.lang and any(langid._CODES[b] for b in (r.text or "").encode()):
            grams = next(langid.trigrams(pa.array([r.text])))
            counts[r.lang] = counts.get(r.lang, 0) + vector(r.text) / np.sqrt((grams[2] ** 2).sum())
    names = sorted(counts)
    profile = np.stack([counts[n] / np.linalg.norm(counts[n]) for n in names])
    profile -= profile.mean(0) if len(names) > 1 else 0
    for r in langid.predict(docs, langid.learn(docs.withColumn("held", langid.held_out()).filter("not held")), ["doc_id", "text"]).collect():
        own = vector(r.text)
        if r.lang_pred != "und" and np.linalg.norm(own):
            cosine = profile @ own / np.linalg.norm(own) / np.maximum(np.linalg.norm(profile, axis=1), 1e-9)
            assert abs(r.score - max(cosine.max(), 0)) < 1e-3
            assert cosine[names.index(r.lang_pred)] > cosine.max() - 1e-3

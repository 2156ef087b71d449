"""Target-distribution importance resampling with hashed n-gram features.

1. Identical texts are collapsed by grouping the full text. Each distinct text is turned into features once:
   A-Z lower-cased, words of digits, letters and everything beyond ASCII, all runs of one and two words, each
   put into the bucket crc32(feature) mod 10000. The buckets, two bytes each, are written with the text's
   digest and multiplicity; the texts are not needed again.
2. Bucket counts of the corpus are multiplied by the multiplicities; with those of the target texts they
   give each bucket's gain, the log-ratio of its smoothed frequencies. A table of 10000 gains goes to all tasks.
3. A text's weight is the mean gain of its features, made once and joined back to its documents by digest.
4. Gumbel noise of each document's own id is added: the highest scores are a sample without replacement.
   Ranks need no global sort: a score is one of some 100 thousand integers whatever the corpus, so counts by
   score say how many documents lie above; within a score documents are ranked by id. The noise spreads
   equal weights, so no score has more than about 1 in 2700 documents of one weight.

The crc32 of two words is combined from those of the distinct words of a slice: appending n zero bytes is a
linear map, kept as tables for n up to 64.

Defined cases: a null text is empty and, like a blank one, has no features and weight 0; texts of any length
are taken whole; a null doc_id draws its noise from the empty string and loses ties to other ids; rows with
equal doc_id each have a row; without documents or targets the counts are zero and the formula still
holds; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import join_hot, map_arrow, materialize

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
#: Longer second words are appended by zlib.
_SHIFTS = 64
_tables: list[np.ndarray] = []


def _shift_tables() -> np.ndarray:
    """[n, k, v]: what n zero bytes after it make of a checksum whose byte k is v and whose others are 0."""
    if not _tables:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
        out = [np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])]
        for _ in range(_SHIFTS):
            out.append(out[-1] >> 8 ^ step[out[-1] & 255])
        _tables.append(np.stack(out))
    return _tables[0]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(checksums of the features of a slice, bounds of each document in them, words of each document)."""
    words = textvec.Words(data, offsets, _INSIDE)
    code, distinct = words.distinct
    own = distinct.to_pylist()
    crc = np.array([zlib.crc32(w) for w in own], np.uint32)
    spaced = np.array([zlib.crc32(b" ", c) for c in crc.tolist()], np.uint32)
    length = np.array([len(w) for w in own], np.int64)
    n = np.diff(words.bounds)
    doc = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    a, b = code[pair], code[pair + 1]
    table, at, before = _shift_tables(), np.minimum(length[b], _SHIFTS), spaced[a]
    both = crc[b]
    for k in range(4):
        both = both ^ table[at, k, before >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(length[b] > _SHIFTS).tolist():
        both[i] = zlib.crc32(own[b[i]], int(before[i]))
    bounds = np.concatenate([[0], np.cumsum(n + np.maximum(n - 1, 0))])
    out = np.empty(bounds[-1], np.uint32)
    out[bounds[:-1][doc] + np.arange(len(code)) - words.bounds[:-1][doc]] = crc[code]  # words first, then pairs
    out[bounds[:-1][doc[pair]] + n[doc[pair]] + pair - words.bounds[:-1][doc[pair]]] = both
    return out, bounds, n


def featured(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """key (SHA-256), copies, n_words, buckets (packed) of ``texts`` (text, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in textvec.slices(batch.column(1)):
                crc, bounds, n = features(data, offsets)
                raw = pa.py_buffer((crc % np.uint32(buckets)).astype("<u2"))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(2 * bounds), raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), batch.column(2).slice(first, len(n)), pa.array(n, pa.int64()), packed], ["key", "copies", "n_words", "buckets"])

    return map_arrow(texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies"), run, "key binary, copies long, n_words long, buckets binary")


def _distinct(texts: DataFrame) -> DataFrame:
    return texts.groupBy(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))


def counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often each bucket occurs in all documents, copies included. A task has a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += copies * np.bincount(np.frombuffer(packed.as_buffer(), "<u2"), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return map_arrow(rows.select("copies", "buckets"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of all buckets, from ``counts`` of the corpus and of the target texts."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(F.broadcast(corpus.withColumnRenamed("n", "s")), "bucket", "left").join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_features, n_words, weight of each distinct text."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            each = [np.frombuffer(p.as_buffer(), "<u2") for p in batch.column(2)]
            mean = [int(own[x].sum()) // len(x) if len(x) else 0 for x in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in each], pa.int64()), batch.column(1), pa.array(mean, pa.int64())], ["key", "n_features", "n_words", "weight"])

    return map_arrow(rows.select("key", "n_words", "buckets"), run, "key binary, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (doc_id, score, eligible, ...) with rank: 1, 2, ... of the ``percent`` in a hundred eligible ones of highest score."""
    of = rows.filter("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.sum("_n").over(Window.partitionBy()) * percent
    of = of.select("score", above.alias("_above"), F.floor(quota / 100).alias("_quota"))  # a row for each score: bounded, see above
    rows = rows.join(F.broadcast(of), "score", "left")
    reach = F.col("eligible") & (F.col("_above") < F.col("_quota"))
    others = [c for c in rows.columns if c not in ("doc_id", "score")]
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), *others)
    place = F.col("_above") + F.row_number().over(within)
    top = rows.filter(reach).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("_quota"), F.col("rank")))
    rest = rows.filter(~reach).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("_above", "_quota")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null: not drawn)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError(f"buckets: {buckets} of 1 to 65536")
    rows = materialize(featured(_distinct(docs), buckets), "features")
    found = gains(materialize(counts(rows, buckets), "counts"), counts(featured(_distinct(target), buckets), buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in found.collect():  # one row a bucket
        gain[r.bucket] = r.gain
    own = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("key")), "keys")
    back = join_hot(own, weights(rows, gain), "key", own.count())
    back = back.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return ranked(materialize(back, "scores"), percent).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))

"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of byte classes (64 of them: each lower-case letter, classes of capitals, digits,
punctuation, symbols, the parts of UTF-8 sequences, and one for the first byte of a word that repeats
the word before it), of order 4, trained on the whole texts of all
trusted documents (labelled quality 1 and not toxic). Tasks send n-gram counts; the statistics of
Kneser-Ney, i.e. continuation counts, counts of counts and context totals, come from aggregations and
equi-joins sharded by n-gram or context, and so do the scores: blocks of documents ask for the values of
their own n-grams, which are joined with the model and sent back to the block.

A document is rejected when its perplexity (smoothed for short texts) exceeds the threshold of its
language: ``SLACK`` times the ``QUANTILE`` of the trusted documents' perplexities in this language, or
of all trusted documents where the language has fewer than ``LEAST`` of them.

Defined cases: a text that is null or empty has no perplexity and is rejected; a null language is a
language of its own; a document labelled both ways is not trusted; labels of unknown documents and
rows with null doc_id count for nothing; without any trusted text every perplexity is null and all
documents with text stay. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import apply_arrow, map_arrow, materialize

ORDER, BITS = 4, 6
QUANTILE, SLACK, LEAST = 0.99, 1.2, 50
#: A text's perplexity is smoothed with so many bytes at its language's usual perplexity: a few bytes prove little.
SMOOTHING = 30
#: Documents are scored in blocks of about so many bytes of text.
BLOCK_BYTES = 16 << 20
#: Limits of more languages than this are joined by shuffle.
MOST_LANGUAGES = 10_000
#: Up to so many trusted ids (16 bytes each) are sent to all tasks; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _classes() -> np.ndarray:
    table = np.full(256, 38, np.uint8)  # symbols
    for first, chars in ((0, "abcdefghijklmnopqrstuvwxyz"), (26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (27, "0123456789"), (28, " "), (29, "\n\t\r\x0b\x0c"), (30, "."), (31, ","), (32, "'-"), (33, ";:?!()\"")):
        for i, c in enumerate(chars):
            table[ord(c)] = first + (i if first == 0 else 0)
    table[:32][table[:32] == 38] = 34  # controls
    table[0xC0:0xE0], table[0xC3], table[0xE0:] = 35, 36, 37
    table[0x80:0xC0] = 39 + np.arange(64) % 24
    return table


CLASSES, REPEAT = _classes(), 63


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The code of each byte with the three before it; before a text stand spaces."""
    codes = CLASSES[data].astype(np.int32)
    words = textvec.Words(data, offsets)
    again = np.flatnonzero(words.hashes[1:] == words.hashes[:-1]) + 1
    codes[words.starts[again[~np.isin(again, words.bounds)]]] = REPEAT
    out = codes.copy()
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        before = np.empty_like(codes)
        before[:k], before[k:] = 28, codes[:-k]
        before[at < k] = 28
        out |= before << (BITS * k)
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """g, c: n-grams of the highest order in all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(1 << (BITS * ORDER), np.uint32), 0

        def out() -> Iterator[pa.RecordBatch]:
            seen = np.flatnonzero(total)
            for i in range(0, len(seen), 1 << 16):
                own = seen[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own].astype(np.int64), pa.int64())], ["g", "c"])

        for batch in batches:
            for _, data, offsets in textvec.slices(batch.column(0)):
                if size + len(data) >= 1 << 32:  # before a count could overflow
                    yield from out()
                    total[:], size = 0, 0
                np.add.at(total, grams(data, offsets), np.uint32(1))
                size += len(data)
        yield from out()

    return map_arrow(docs.select(F.col("text").cast("string")), run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def model(counts: DataFrame) -> DataFrame:
    """k, g, share, rest: for each seen k-gram, what it keeps of its context's mass; for k = -j, each context before j-grams and the mass it leaves to the lower order."""
    parts = None
    table = counts
    for k in range(ORDER, 0, -1):
        n = table.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = table.groupBy(F.shiftright("g", BITS).alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("cut"))
        seen = table.join(context.select("h", "total"), F.shiftright("g", BITS) == F.col("h")).select(F.lit(k).alias("k"), "g", ((F.col("c") - cut) / F.col("total")).alias("share"))
        both = seen.union(context.select(F.lit(-k), F.col("h"), F.col("cut") / F.col("total")))
        parts = both if parts is None else parts.union(both)
        if k > 1:  # lower orders count what precedes, not how often
            table = materialize(table.groupBy(F.col("g").bitwiseAND((1 << (BITS * (k - 1))) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c")), "continuations")
    return parts


def priced(seen: DataFrame, fitted: DataFrame) -> DataFrame:
    """g, price: -ln P of each n-gram of ``seen`` (g), by equi-joins with the model's n-grams and contexts, order by order."""
    out, p = seen.select("g").distinct(), F.lit(1 / (1 << BITS))
    for k in range(1, ORDER + 1):
        own = F.col("g").bitwiseAND((1 << (BITS * k)) - 1)
        share = fitted.filter(F.col("k") == k).select(F.col("g").alias("_g"), F.col("share").alias("_share"))
        rest = fitted.filter(F.col("k") == -k).select(F.col("g").alias("_h"), F.col("share").alias("_rest"))
        out = out.withColumn("p", p).join(share, own == F.col("_g"), "left").join(rest, F.shiftright(own, BITS) == F.col("_h"), "left")
        # A context never seen leaves all to the lower order.
        out = out.select("g", (F.coalesce("_share", F.lit(0.0)) + F.coalesce("_rest", F.lit(1.0)) * F.col("p")).alias("p"))
        p = F.col("p")
    return out.select("g", (-F.ln(F.greatest("p", F.lit(1e-9)))).alias("price"))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of ``docs`` that labels call good: a broadcast of ids up to a checked number, else a shuffle join."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(good) if few else good, "doc_id", "left_semi")


def scores(docs: DataFrame, fitted: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_bytes, perplexity of the column ``text``.

    Rows are dealt to blocks of bounded bytes. A block's different n-grams are joined with the model, sharded by
    n-gram or context, and their values come back to the block: no task and no driver ever holds the model.
    """
    n = len(keep)
    at = keep.index(text) if text in keep else n  # a text that is kept is sent once
    kinds = [f.dataType.simpleString() for f in docs.select(*keep).schema]
    names = [f"_k{i}" for i in range(n)]
    sent = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, names)), *([] if at < n else [F.col(text).cast("string").alias(f"_k{n}")]))
    size = sent.agg(F.sum(F.octet_length(f"_k{at}"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-size // BLOCK_BYTES), min(2 * cores, size >> 20))
    # By content, so that a task run again deals as before.
    dealt = sent.select(F.pmod(F.xxhash64(*sent.columns), F.lit(blocks)).alias("_block"), *sent.columns).repartition(blocks, "_block")
    out = [*(f"{x} {kind}" for x, kind in zip(names, kinds)), "n_bytes long", "perplexity double"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[order], prepend=-1))
            for rows in np.split(order, cuts[1:]):
                flags = held.setdefault(int(of[rows[0]]), np.zeros(1 << (BITS * ORDER), bool)) if len(rows) else None
                for _, data, offsets in textvec.slices(batch.column(1 + at).take(pa.array(rows))):
                    flags[grams(data, offsets)] = True
        for block, flags in held.items():
            seen = np.flatnonzero(flags)
            for i in range(0, len(seen), 1 << 16):
                own = seen[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block), pa.int64()), pa.array(own, pa.int64())], ["_of", "g"])

    def run(rows: pa.Table, known: pa.Table | None) -> pa.Table:
        textvec.only("")
        ppl, length = np.full(len(rows), np.nan), np.zeros(len(rows), np.int64)
        if known is not None:
            table = np.full(1 << (BITS * ORDER), np.nan, np.float32)  # one that was not asked for must not count
            table[known["g"].to_numpy()] = known["price"].to_numpy()
        for i, data, offsets in textvec.slices(rows.column(1 + at)):
            length[i : i + len(offsets) - 1] = np.diff(offsets)
            if known is not None:
                sums = np.concatenate([[0], np.cumsum(table[grams(data, offsets)], dtype=np.float64)])
                with np.errstate(invalid="ignore", divide="ignore"):
                    ppl[i : i + len(offsets) - 1] = np.exp((sums[offsets[1:]] - sums[offsets[:-1]]) / np.diff(offsets))
        made = pa.Table.from_arrays([*rows.columns[1 : 1 + n], pa.array(length), pa.array(ppl, pa.float64(), from_pandas=True)], [*names, "n_bytes", "perplexity"])
        textvec.trim()
        return made

    if fitted.isEmpty():
        found = apply_arrow(dealt.groupBy("_block"), lambda _, rows: run(rows, None), ", ".join(out))
    else:
        seen = map_arrow(dealt, met, "_of long, g long").repartition("g")
        known = seen.join(priced(seen, fitted), "g").select("_of", "g", "price")
        found = dealt.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(run, ", ".join(out))
    return found.select(*(F.col(x).alias(c) for x, c in zip(names, keep)), "n_bytes", "perplexity")


def limits(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, DataFrame, tuple[float | None, float | None]]:
    """(model, table of _lang, usual, threshold, those of all trusted documents), from the trusted documents."""
    good = trusted(docs, labels)
    fitted = materialize(model(materialize(gram_counts(good), "counts")), "model")
    scored = materialize(scores(good, fitted, ["doc_id", "lang"]).filter("perplexity is not null").drop("doc_id"), "trusted")
    which = lambda q: F.percentile_approx("perplexity", q, 2000)
    enough = F.count(F.lit(1)) >= LEAST
    overall = scored.agg(which(0.5)).first()[0]
    usual = materialize(scored.groupBy(F.col("lang").alias("_lang")).agg(which(0.5).alias("usual"), enough.alias("enough")).filter("enough").drop("enough"), "usual")
    smoothed = materialize(smooth(with_limits(scored, usual, overall=(overall, None))), "smoothed")
    table = usual.join(smoothed.groupBy(F.col("lang").alias("_l")).agg((which(quantile) * SLACK).alias("threshold")), F.col("_lang").eqNullSafe(F.col("_l"))).drop("_l")
    top = smoothed.agg(which(quantile)).first()[0]
    return fitted, materialize(table, "limits"), (overall, top and top * SLACK)


def with_limits(rows: DataFrame, table: DataFrame, overall: tuple[float | None, float | None]) -> DataFrame:
    """``rows`` with the usual perplexity and, where the table has it, the threshold of their language."""
    few = table.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    out = rows.join(F.broadcast(table) if few else table, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    columns = [c for c in ("usual", "threshold") if c in table.columns]
    return out.withColumns({c: F.coalesce(c, F.lit(x).cast("double")) for c, x in zip(columns, overall)})


def smooth(rows: DataFrame) -> DataFrame:
    return rows.withColumn("perplexity", F.exp((F.ln("perplexity") * F.col("n_bytes") + F.ln("usual") * SMOOTHING) / (F.col("n_bytes") + SMOOTHING)))


def _fits() -> Column:
    return (F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, perplexity, threshold, keep."""
    fitted, table, overall = limits(docs, labels, quantile)
    out = smooth(with_limits(scores(docs, fitted, ["doc_id", "lang"]), table, overall))
    return out.select("doc_id", "lang", "perplexity", "threshold", _fits().alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns; the texts are dealt to blocks once."""
    fitted, table, overall = limits(docs, labels, quantile)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text, lang = (names[docs.columns.index(c)] for c in ("text", "lang"))
    scored = scores(docs.toDF(*names), fitted, names, text).withColumn("lang", F.col(lang))
    out = smooth(with_limits(scored, table, overall)).filter(_fits())
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))

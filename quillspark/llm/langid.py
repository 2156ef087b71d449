"""Language ID with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs. A trigram's vector binds (multiplies) its
letters' vectors, permuted (rotated) by 2, 1 and 0 places; a text's vector bundles (adds) those of all
its trigrams. Letters are A-Z folded to a-z and each two-byte UTF-8 sequence as its two bytes; all runs
of other bytes count as one boundary letter. A language's prototype bundles its documents' vectors, each
scaled to length 1, and is centred by the mean of all prototypes; a text goes to the prototype of
largest cosine.

Bundling is linear, so a task sums trigram counts per language and turns them into a vector once.

Defined cases: a null text or one without letters is ``und`` with score 0, as is any text when nothing
was learned; a null lang is not learned from; ties go to the language first in code point order; an
empty table gives an empty result. Only text is an input of a prediction; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import map_arrow

DIMENSIONS = 512
#: More learned languages than this are an error: prototypes are held by every task.
MOST_LANGUAGES = 2000
_BITS = 6
_rng = np.random.Generator(np.random.PCG64(11))
_LETTERS = _rng.integers(0, 2, (1 << _BITS, DIMENSIONS), dtype=np.int8) * 2 - 1


def _codes() -> np.ndarray:
    table = np.zeros(256, np.int32)  # 0: boundary
    table[97:123] = table[65:91] = 1 + np.arange(26)
    table[0xC0:0xE0] = 27 + np.arange(32) % 4
    table[0xE0:] = 31
    table[0x80:0xC0] = 32 + np.arange(64) % 32
    return table


_CODES = _codes()


def vectors(grams: np.ndarray) -> np.ndarray:
    """One row of signs per trigram code."""
    a, b, c = grams >> (2 * _BITS), grams >> _BITS & ((1 << _BITS) - 1), grams & ((1 << _BITS) - 1)
    return np.roll(_LETTERS, 2, 1)[a] * np.roll(_LETTERS, 1, 1)[b] * _LETTERS[c]


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(vectors(np.arange(1 << (3 * _BITS))))
    return _TABLE[0]


def trigrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct trigrams, how often) of each text that has a letter."""
    for first, data, offsets in textvec.slices(texts):
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        codes = _CODES[data]
        edge = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
        keep = (codes > 0) | np.concatenate([[True], codes[:-1] > 0])[: len(codes)] | edge
        codes, doc = codes[keep], doc[keep]
        # A boundary stands before and after every text.
        n = np.bincount(doc, minlength=len(offsets) - 1)
        starts = np.concatenate([[0], np.cumsum(n + 2)])
        padded = np.zeros(starts[-1], np.int32)
        padded[np.arange(len(codes)) + 2 * doc + 1] = codes
        grams = (padded[:-2] << (2 * _BITS)) | (padded[1:-1] << _BITS) | padded[2:]
        for d in np.flatnonzero(n).tolist():
            own = grams[starts[d] : starts[d + 1] - 2]
            own, count = np.unique(own[(own >> _BITS & ((1 << _BITS) - 1)) > 0], return_counts=True)
            if len(own):
                yield first + d, own, count.astype(np.float32)


def _has_letter(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """The prototypes of the languages in ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, grams, count in trigrams(batch.column(0)):
                own = sums.setdefault(langs[i], np.zeros(1 << (3 * _BITS)))
                own[grams] += count / np.sqrt((count * count).sum())
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            vector = sum(own[p] @ vectors(p) for p in np.array_split(at, 1 + len(at) // 4096))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(np.round(vector * 1e6), pa.int64())], ["lang", "at", "x"])

    table = map_arrow(docs.filter("lang is not null").select(F.col("text").cast("string"), "lang"), run, "lang string, at int, x long")
    sums = table.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = sums.limit(MOST_LANGUAGES * DIMENSIONS + 1).collect()
    if len(rows) > MOST_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r["at"]] = r.x
    return dict(sorted(found.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score (the cosine, 0 where it is negative)."""
    names = list(prototypes)
    profile = np.stack([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()]) if names else np.zeros((0, DIMENSIONS))
    if len(names) > 1:
        profile = profile - profile.mean(0)
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    profile, n = profile.T.astype(np.float32), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        for batch in batches:
            best, score = np.full(len(batch), -1), np.zeros(len(batch))
            if names:
                texts, letters = batch.column(n), batch.column(n + 1)
                for i, grams, count in trigrams(texts):
                    if not letters[i].as_py():
                        continue
                    vector = sum(count[p] @ table[grams[p]].astype(np.float32) for p in np.array_split(np.arange(len(grams)), 1 + len(grams) // 4096))
                    cosine = vector @ profile / max(float(np.sqrt(vector @ vector)), 1e-9)
                    best[i] = int(cosine.argmax())
                    score[i] = min(max(float(cosine[best[i]]), 0.0), 1.0)
                # Letters only outside the model's alphabet: all cosines are equal.
                best[(best < 0) & np.array(letters.to_pylist(), bool)] = 0
            lang = [names[k] if k >= 0 else "und" for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_arrow(docs.select(*keep, F.col("text").cast("string").alias("_text"), _has_letter("text").alias("_letters")), run, f"{schema}{', ' if schema else ''}lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    rows = docs.withColumn("held_out", held_out(folds))
    prototypes = learn(rows.filter("not held_out").select("text", "lang"))
    return predict(rows, prototypes, ["doc_id", "held_out"])

"""Token-ID / binary output: documents as directly addressable codes in ascending doc_id order.

``write`` encodes whole texts and writes segments; ``TokenStore`` reads them back: all documents, or
any single token by its position in the corpus. A segment is one row of an uncompressed Parquet table
(so Spark's commit protocol guards it, and any file system that Spark reaches will do): its doc ids,
where each starts, and the ids of its documents coded as in ``dac``. Segments hold whole documents and
are closed at ``SEGMENT_IDS`` ids.

Defined cases: a null text is empty and yields only the end id; a null doc_id sorts first; rows with
equal doc_id are all kept, ordered by text; an empty table gives an empty store. Extra columns of the
input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import dac, textvec
from quillspark.llm.common import map_arrow

SEGMENT_IDS = 1 << 18
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bounds of a Python worker's caches: pieces in each of the two generations, bytes a piece, stems.
CACHE_PIECES, CACHE_BYTES, CACHE_STEMS = 500_000, 48, 100_000
#: Bytes of text whose distinct words are encoded together.
SLICE_BYTES = 1 << 20
SEGMENTS = "part int, segment int, first long, n_ids long, doc_ids array<long>, doc_starts array<long>, codes binary"
_SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("codes", pa.binary())])
#: A word of Latin-1 letters and what may follow it: these the tokenizer's normalisers and pattern treat simply.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch
_encoders: dict[str, "WordEncoder"] = textvec.caches.setdefault("tokens", {})


class Pieces:
    """Ids of pieces in arrays sorted by a 64-bit hash, with the pieces' bytes: some 50 bytes a piece."""

    def __init__(self):
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.at, self.length, self.raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def find(self, keys: np.ndarray, begin: np.ndarray, length: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pieces, of hashes ``keys`` and at ``begin`` in ``raw``, are held, where): hash and bytes agree."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        ok = np.flatnonzero((self.keys[at] == keys) & (self.length[at] == length))
        same = _gather(raw, begin[ok], length[ok]) == _gather(self.raw, self.at[at[ok]], length[ok])
        ok = ok[np.logical_and.reduceat(same, np.cumsum(length[ok]) - length[ok])] if len(ok) else ok
        return ok, at[ok]

    def add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray, length: np.ndarray, raw: np.ndarray) -> None:
        """Pieces whose hash is held already are left out."""
        begin, place = len(self.flat) + np.cumsum(size) - size, len(self.raw) + np.cumsum(length) - length
        self.flat, self.raw = np.concatenate([self.flat, flat]), np.concatenate([self.raw, raw])
        order = np.unique(keys, return_index=True)[1]
        at = np.searchsorted(self.keys, keys[order])  # both are sorted: np.isin would hash all that are held, for each slice
        held = at < len(self.keys)
        held[held] = self.keys[at[held]] == keys[order[held]]
        order, at = order[~held], at[~held]
        self.begin, self.size = np.insert(self.begin, at, begin[order]), np.insert(self.size, at, size[order])
        self.at, self.length = np.insert(self.at, at, place[order]), np.insert(self.length, at, length[order])
        self.keys = np.insert(self.keys, at, keys[order])


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at ``begin``, one after the other."""
    return flat[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]


class WordEncoder:
    """Ids of texts by way of their distinct pieces between ASCII white space.

    The tokenizer's pattern never matches across white space and its normalisers don't look across it,
    so the ids of a text are those of its pieces, one after the other. Each distinct piece of a slice of
    texts is looked up once, by a 64-bit hash and its bytes, and its ids are copied to all its places by
    index. Of pieces met for the first time, a plain word, lower-cased, goes straight to the library's model; others
    go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.new, self.old = Pieces(), Pieces()
        self.stems: dict[str, list[int]] = {}
        self.marks: dict[str, list[int]] = {}  # of up to three characters

    def encode(self, piece: bytes) -> list[int]:
        text = piece.decode()
        if not (plain := _PLAIN(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        stem = plain[1].lower()
        if (ids := self.stems.get(stem)) is None:
            letters = stem if stem.isascii() else "".join(map(self.letters.__getitem__, stem.encode()))
            if len(self.stems) >= CACHE_STEMS:
                self.stems.clear()
            ids = self.stems[stem] = [t.id for t in self.model.tokenize(letters)]
        if not plain[2]:
            return ids
        if (end := self.marks.get(plain[2])) is None:
            end = self.tokenizer.encode(plain[2], add_special_tokens=False).ids
            if len(plain[2]) <= 3:
                self.marks[plain[2]] = end
        return ids + end

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, flat): the ids of distinct ``pieces`` (large binary)."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
        starts, length, raw = offsets[:-1], np.diff(offsets), np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        keys = textvec.word_hashes(raw, starts, length)
        size, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for cache in (self.new, self.old):
            rest = np.flatnonzero(~known)
            ok, at = cache.find(keys[rest], starts[rest], length[rest], raw)
            size[rest[ok]], known[rest[ok]] = cache.size[at], True
            parts.append((rest[ok], _gather(cache.flat, cache.begin[at], cache.size[at])))
        missed = np.flatnonzero(~known)
        ids = [self.encode(p) for p in pieces.take(pa.array(missed)).to_pylist()]
        size[missed] = np.fromiter(map(len, ids), np.int64, len(ids))
        parts.append((missed, np.fromiter(chain.from_iterable(ids), "<u4", int(size[missed].sum()))))
        flat = np.concatenate([f for _, f in parts])
        begin = np.zeros(len(keys), np.int64)
        order = np.concatenate([w for w, _ in parts])
        begin[order] = np.cumsum(size[order]) - size[order]
        fresh = np.concatenate([parts[1][0], missed])  # what is used again moves back from the old ones
        fresh = fresh[length[fresh] <= CACHE_BYTES]
        self.new.add(keys[fresh], size[fresh], _gather(flat, begin[fresh], size[fresh]), length[fresh], _gather(raw, starts[fresh], length[fresh]))
        if len(self.new.keys) >= CACHE_PIECES:
            self.new, self.old = Pieces(), self.new
        return begin, size, flat

    def texts(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds of each text in them) of slices of ``texts``, an ``end`` after each text."""
        for first, data, offsets in textvec.slices(texts, SLICE_BYTES):
            words = textvec.Words(data, offsets, fold=textvec.EXACT)
            code, pieces = words.distinct
            begin, size, flat = self.distinct(pieces)
            n = size[code]
            before = np.concatenate([[0], np.cumsum(n)])
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
            ids = np.full(before[-1] + len(offsets) - 1, end, "<u4")
            ids[np.arange(before[-1]) + np.repeat(doc, n)] = _gather(flat, begin[code], n)
            yield first, ids, before[words.bounds] + np.arange(len(offsets))

    def __call__(self, text: str) -> bytes:
        return next(self.texts(pa.array([text]), 0))[1][:-1].tobytes()


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> TokenStore:
    """Encodes ``docs`` (doc_id, text) and writes the segments to ``path``; one shuffle of the texts, by range of doc_id."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        state = {"segment": 0, "first": 0}
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal held, doc_ids
            starts = np.cumsum([0, *map(len, held)])
            codes = dac.encode(np.concatenate(held))
            out = pa.RecordBatch.from_pylist([{"part": part, **state, "n_ids": int(starts[-1]), "doc_ids": doc_ids, "doc_starts": starts[:-1].tolist(), "codes": codes}], _SEGMENTS)
            state["segment"] += 1
            state["first"] += int(starts[-1])
            held, doc_ids = [], []
            return out

        size = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, ids, bounds in encode.texts(batch.column(1), end_id):
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    held.append(ids[a:b])
                    doc_ids.append(own[first + i])
                    size += b - a
                    if size >= segment_ids:
                        yield close()
                        size = 0
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(rows, segments, SEGMENTS, "tokens").write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return TokenStore(docs.sparkSession, path)


class TokenStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.segments = spark.read.schema(SEGMENTS).parquet(path)

    def parts(self) -> DataFrame:
        """part, before: ids before the part. One row per partition written, so one task adds them up and it can be broadcast."""
        sums = self.segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sums.select("part", before.cast("long").alias("before"))

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32: of the ids as they were written, as little-endian u32."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = dac.Codes(row["codes"]).all().astype("<u4")
                    cuts = [*row["doc_starts"], len(ids)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array([row["before"] + row["first"] + x for x in cuts[:-1]], pa.int64()),
                        "n_tokens": pa.array(np.diff(cuts), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                    })

        rows = self.segments.join(F.broadcast(self.parts()), "part").select("before", "first", "doc_ids", "doc_starts", "codes")
        return map_arrow(rows, read, "doc_id long, start long, n_tokens long, ids_crc32 long", "tokens")

    def token_ids(self) -> DataFrame:
        """doc_id, token_ids: whole documents, decoded."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = dac.Codes(row["codes"]).all().astype(np.int32)
                    cuts = pa.array([*row["doc_starts"], len(ids)], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(ids))], ["doc_id", "token_ids"])

        return map_arrow(self.segments.select("doc_ids", "doc_starts", "codes"), read, "doc_id long, token_ids array<int>", "tokens")

    def token_at(self, position: int) -> int:
        """The token at a position of the whole corpus: one segment is read, none is decoded."""
        at = self.segments.join(F.broadcast(self.parts()), "part").select((F.col("before") + F.col("first")).alias("start"), "n_ids", "codes")
        row = at.filter((F.col("start") <= position) & (F.col("start") + F.col("n_ids") > position)).first()
        if row is None:
            raise IndexError(position)
        return dac.Codes(bytes(row["codes"]))[position - row["start"]]

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are maximal runs of letters, digits and non-ASCII characters, A-Z folded to a-z; an item's
shingles are its 5-word runs (an item of fewer words is one shingle as a whole). Every position of a
document where a shingle of an item of m shingles occurs makes windows of m shingles that contain it;
windows that share no shingle with any item can't be similar to one, so none is left out. Windows get a
64-bit weighted SimHash. Item fingerprints are indexed by 8 blocks of 8 bits: two fingerprints within
``RADIUS`` differ by at most RADIUS // 8 bits in some block, so looking up each block among the items sorted
by theirs, with all values that near, finds all of them. What is found is verified by the weighted Jaccard similarity of the two
multisets of shingles; a shingle weighs 1 + ln(items / items that hold it).

Benchmarks go to all tasks as an index of bounded size: one of more than ``PART_CHARS`` characters is
dealt into parts by hash, and the corpus is read once per part. Documents are never shuffled.

Defined cases: null texts are empty; texts of any length are searched whole; an item without words matches nothing; equal items are each
reported; an item longer than the document is compared with the whole document; a null doc_id or
item_id is passed through; empty tables give empty results. Extra columns are not read by ``matches``
and are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import map_arrow

WIDTH, SIMILARITY = 5, 0.8
#: A similarity of 0.8 makes 10 differing bits of 64 on average; 19 is more than three deviations above.
RADIUS, BLOCKS = 19, 8
PART_CHARS = 1 << 24
#: Words of a text, and pairs of windows and items, that are worked on at a time.
STRETCH, PAIRS = 1 << 16, 1 << 20
_U = np.uint64
_NEAR = np.array([sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(8), k)], np.uint8)


def signs(tokens: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of a fingerprint, for each shingle."""
    bits = np.unpackbits(textvec.mix(tokens ^ _U(0xD6E8FEB86659FD93)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _shingles(rows: list[Row]) -> list[tuple[int, np.ndarray]]:
    """(width, shingles) of each item."""
    texts = pa.array([r.text for r in rows], pa.string())
    own: list[tuple[int, np.ndarray]] = []
    for _, data, offsets in textvec.slices(texts):
        words = textvec.Words(data, offsets, textvec.ALNUM)
        by_width = {w: words.shingles(w) for w in range(1, WIDTH + 1)}
        for i, n in enumerate(np.minimum(np.diff(words.bounds), WIDTH).tolist()):
            tokens, bounds = by_width[max(n, 1)]
            own.append((n, tokens[bounds[i] : bounds[i + 1]]))
    return own


class Index:
    """Of a part of the benchmark: shingles of each item, fingerprints and block tables by item size."""

    def __init__(self, rows: list[Row], similarity: float, whole: tuple | None = None):
        self.similarity, self.ids = similarity, [r.item_id for r in rows]
        own = _shingles(rows)
        self.items = [t for _, t in own]
        self.widths = np.array([w for w, _ in own])
        held = [np.unique(t) for t in self.items]
        n, df_keys, df = whole or (len(rows), *np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True))
        self.df_keys, self.df_weight = df_keys, (1 + np.log(max(1, n) / np.maximum(df, 1))).astype(np.float32)
        self.most = np.float32(1 + np.log(max(1, n)))
        self.by_width = {}
        for w in sorted(set(self.widths.tolist()) - {0}):
            of = np.flatnonzero(self.widths == w)
            keys = np.concatenate([held[i] for i in of])
            item = np.repeat(of, [len(held[i]) for i in of])
            order = np.argsort(keys, kind="stable")
            keys, item = keys[order], item[order]
            filter_ = np.zeros(1 << 20, bool)
            filter_[(keys >> _U(44)).astype(np.int64)] = True
            self.by_width[w] = (keys, item, filter_)
        self.sizes = np.array([len(t) for t in self.items])
        self.prints = np.array([self.fingerprints(t, np.zeros(1, np.int64), len(t))[0] if len(t) else 0 for t in self.items], np.uint64)
        self.tables = {}
        for key in {(w, m) for w, m in zip(self.widths.tolist(), self.sizes.tolist()) if w}:
            of = np.flatnonzero((self.widths == key[0]) & (self.sizes == key[1]))
            blocks = self.prints[of].view(np.uint8).reshape(-1, BLOCKS).T
            order = np.argsort(blocks, axis=1, kind="stable").astype(np.int32)  # per block the items by its value, and where each value begins
            first = np.stack([np.searchsorted(np.sort(b), np.arange(257)) for b in blocks])
            self.tables[key] = (of, order, first)

    def weights(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.df_keys):
            return np.full(len(tokens), self.most)
        at = np.minimum(np.searchsorted(self.df_keys, tokens), len(self.df_keys) - 1)
        return np.where(self.df_keys[at] == tokens, self.df_weight[at], self.most)

    def fingerprints(self, tokens: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Of the windows at ``starts``, in ascending order; a stretch of the text at a time, so a long one takes no more memory."""
        out = [np.zeros(0, np.uint64)]
        at = 0
        while at < len(starts):
            base = int(starts[at])
            end = int(np.searchsorted(starts, base + STRETCH))
            own = tokens[base : int(starts[end - 1]) + size]
            sums = np.zeros((len(own) + 1, 64), np.float64)
            np.cumsum(signs(own) * self.weights(own)[:, None], axis=0, out=sums[1:])
            mine = starts[at:end] - base
            out.append(np.packbits(sums[np.minimum(mine + size, len(own))] - sums[mine] > 0, axis=1).view(np.uint64).ravel())
            at = end
        return np.concatenate(out)

    def near(self, key: tuple[int, int], prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all fingerprints of items of width and size ``key`` within the radius, windows in order.

        Each block of a window is looked up among the items sorted by theirs, with every value that near. Windows go
        in chunks, so memory is bounded however many items there are.
        """
        of, order, first = self.tables[key]
        own, step = self.prints[of], max(1, PAIRS // len(of))
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            found = [np.zeros(0, np.int64)]
            for b, values in enumerate(some.view(np.uint8).reshape(-1, BLOCKS).T):
                v = (values[:, None] ^ _NEAR).astype(np.int64)
                lo, n = first[b][v].ravel(), (first[b][v + 1] - first[b][v]).ravel()
                window = np.repeat(np.repeat(np.arange(len(some)), len(_NEAR)), n)
                item = order[b][np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
                ok = np.bitwise_count(some[window] ^ own[item]) <= RADIUS
                found.append(window[ok] * len(of) + item[ok])
            for pair in np.unique(np.concatenate(found)).tolist():
                yield at + pair // len(of), int(of[pair % len(of)])

    def score(self, tokens: np.ndarray, item: int) -> float:
        x, nx = np.unique(tokens, return_counts=True)
        y, ny = np.unique(self.items[item], return_counts=True)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        wx, wy = self.weights(x), self.weights(y)
        common = float((np.minimum(nx[i], ny[j]) * wx[i]).sum())
        return common / (float((nx * wx).sum()) + float((ny * wy).sum()) - common)

    def search(self, tokens: np.ndarray, width: int) -> list[tuple[int, float, int]]:
        """(item, similarity, first shingle) of the best window of each item that passes, in one document's shingles."""
        keys, item, filter_ = self.by_width[width]
        at = np.flatnonzero(filter_[(tokens >> _U(44)).astype(np.int64)])
        if not len(at):
            return []
        lo = np.searchsorted(keys, tokens[at], "left")
        hi = np.searchsorted(keys, tokens[at], "right")
        if not (hi > lo).any():
            return []
        n = hi - lo
        hits = np.repeat(at, n)
        items = item[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        found: dict[int, tuple[float, int]] = {}
        for size in np.unique(self.sizes[items]).tolist():
            last = max(0, len(tokens) - size)
            edge = np.zeros(last + 2, np.int64)
            mine = np.unique(hits[self.sizes[items] == size])
            np.add.at(edge, np.minimum(np.maximum(mine - size + 1, 0), last), 1)
            np.add.at(edge, np.minimum(mine, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            prints = self.fingerprints(tokens, starts, size)
            for i, k in self.near((width, size), prints):
                s = int(starts[i])
                if found.get(k, (0, 0))[0] < 1:
                    score = self.score(tokens[s : s + size], k)
                    if score >= self.similarity and score > found.get(k, (0, 0))[0]:
                        found[k] = (score, s)
        return [(k, score, s) for k, (score, s) in found.items()]

    def documents(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
        """(row, matches) of the rows with any."""
        for first, data, offsets in textvec.slices(texts):
            words = textvec.Words(data, offsets, textvec.ALNUM)
            got: dict[int, list] = {}
            for width in self.by_width:
                tokens, bounds = words.shingles(width)
                if width < WIDTH or self.by_width[width][2].any():
                    maybe = np.flatnonzero(self.by_width[width][2][(tokens >> _U(44)).astype(np.int64)])
                    for d in np.unique(np.searchsorted(bounds, maybe, "right") - 1).tolist():
                        if m := self.search(tokens[bounds[d] : bounds[d + 1]], width):
                            got.setdefault(d, []).extend(m)
            for d in sorted(got):
                yield first + d, got[d]


def parts(benchmark: DataFrame, limit: int = PART_CHARS) -> Iterator[list[Row]]:
    """The items of one part after the other, each of about ``limit`` characters at most."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // limit)
    for i in range(n):
        yield benchmark.filter("text is not null").filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).select("item_id", "text").collect()


def indexes(benchmark: DataFrame, limit: int, similarity: float) -> Iterator[Index]:
    """One per part, all with the shingle counts of the whole benchmark."""
    n, keys, df = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for rows in parts(benchmark, limit):
        n += len(rows)
        every = np.concatenate([keys, *(np.unique(t) for _, t in _shingles(rows))])
        keys, at = np.unique(every, return_inverse=True)
        df = np.bincount(at, np.concatenate([df, np.ones(len(every) - len(df))]), len(keys)).astype(np.int64)
    many = df > 1  # a shingle of one item weighs as much as one of none
    for rows in parts(benchmark, limit):
        yield Index(rows, similarity, (n, keys[many], df[many]))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, similarity, start_word: for each document and item, the first of the most similar windows."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, similarity double, start_word long"
    out = None
    for index in indexes(benchmark, part_chars, similarity):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[i].as_py(), index.ids[k], score, s) for i, m in index.documents(batch.column(1)) for k, score, s in m]
                columns = zip(*found) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "similarity", "start_word"])

        own = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
        out = own if out is None else out.union(own)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``docs`` without a match, all columns kept; one pass over the documents per part of the benchmark."""
    for index in indexes(benchmark, part_chars, similarity):
        shared, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[i for i, _ in shared.value.documents(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, run, docs.schema)
    return docs

"""Vectorised word hashing over Arrow string columns.

Texts stay in Arrow's UTF-8 buffers: words, word hashes and word shingles come out as numpy arrays
for a slice of documents at once, so no Python string is made per word. A word is a maximal run of
bytes other than space, tab, LF, VT, FF and CR; A-Z are folded to a-z before hashing. Equal words of a
slice are found by their bytes. Hashes of words of up to eight bytes are a bijection of their bytes; longer
ones are hashed by SipHash-2-4 (Aumasson and Bernstein, 2012), very long ones by BLAKE2b: nobody can write
words that collide but by trying some 2**32 of them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Longer words are hashed one at a time.
SIP_BYTES = 256
#: What operators keep in a Python worker between tasks, by operator; see ``only``.
caches: dict[str, dict] = {}
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A-Z as a-z, and every byte as it is.
_FOLD = np.arange(256, dtype=np.uint8)
EXACT = _FOLD.copy()
_FOLD[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes where punctuation separates too.
ALNUM = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
#: Of words of up to eight bytes: which bytes are theirs, and the mark of their length.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LENGTH = np.array([(0xF8 + n << 56) % (1 << 64) for n in range(8)] + [0], np.uint64)
_SHINGLE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INV)):
            full = np.full(size, _U(base & (2**64 - 1)))
            full[0] = 1
            _powers[k] = np.cumprod(full)
    return _powers[0], _powers[1]


def only(operator: str) -> None:
    """Drops what other operators have kept in this worker: workers outlive a query."""
    for name, cache in caches.items():
        if name != operator:
            cache.clear()


def trim() -> None:
    """Gives free memory back to the system: workers stay between tasks, and their memory counts for the executor."""
    if len(_powers[0]) > 1 << 20:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``sizes`` at ``starts`` in UTF-8 ``data``.

    A word of up to eight bytes is one number: its bytes and, if it has fewer, a last byte that tells how many,
    which is none that UTF-8 has. So no two of them have one hash.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    each = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))  # the eight bytes at every place
    short = np.minimum(sizes, 8)
    out = mix(each[starts] & _BYTES[short] | _LENGTH[short])
    some = np.flatnonzero((sizes > 8) & (sizes <= SIP_BYTES))
    out[some] = siphash(each, starts[some], sizes[some])
    for i in np.flatnonzero(sizes > SIP_BYTES).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    return out


def siphash(each: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: tuple[int, int] = (0x0706050403020100, 0x0F0E0D0C0B0A0908)) -> np.ndarray:
    """SipHash-2-4 of the words at ``starts``, all at once; ``each``: the eight bytes at every place of the data."""
    order = np.argsort(-sizes, kind="stable")  # words of as many parts lie in front of those of fewer
    starts, sizes = starts[order], sizes[order]
    parts = sizes >> 3
    k0, k1 = map(_U, key)
    # The initial state.
    v = [np.full(len(starts), c, np.uint64) for c in (_U(0x736F6D6570736575) ^ k0, _U(0x646F72616E646F6D) ^ k1, _U(0x6C7967656E657261) ^ k0, _U(0x7465646279746573) ^ k1)]

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << _U(n) | x >> _U(64 - n)

    def take(m: np.ndarray | None, rounds: int, n: int) -> None:
        a, b, c, d = (x[:n] for x in v)
        if m is not None:
            d = d ^ m
        for _ in range(rounds):
            a, c = a + b, c + d
            b, d = turned(b, 13) ^ a, turned(d, 16) ^ c
            a = turned(a, 32)
            a, c = a + d, c + b
            d, b = turned(d, 21) ^ a, turned(b, 17) ^ c
            c = turned(c, 32)
        if m is not None:
            a = a ^ m
        for x, y in zip(v, (a, b, c, d)):
            x[:n] = y

    for i in range(int(parts.max(initial=0))):
        n = int(np.searchsorted(-parts, -i, "left"))  # words of more than i parts
        take(each[starts[:n] + 8 * i], 2, n)
    take(each[starts + 8 * parts] & _BYTES[sizes & 7] | (sizes & 255).astype(np.uint64) << _U(56), 2, len(starts))
    v[2] ^= _U(0xFF)
    take(None, 4, len(starts))
    out = np.empty(len(starts), np.uint64)
    out[order] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, offsets) for runs of rows of about ``limit`` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a slice: byte spans, per document the range of its words, distinct words and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _IS_WORD, fold: np.ndarray = _FOLD):
        n = len(data)
        inside = inside[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._own = data, inside, fold

    @cached_property
    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """(code of each word, the distinct words in order of their first places), told apart by their bytes."""
        data, inside, fold = self._own
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(fold[data[inside]])])
        words = words.dictionary_encode()
        return words.indices.to_numpy().astype(np.int64), words.dictionary

    @cached_property
    def hashes(self) -> np.ndarray:
        data, _, fold = self._own
        return word_hashes(fold[data], self.starts, self.ends - self.starts)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` words of one document, and per document the range of them.

        A document with fewer words, but at least one, has one: its whole sequence.
        """
        h, n = self.hashes, len(self.hashes)
        counts = np.diff(self.bounds)
        full = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            full += h[k : k + len(full)] * _SHINGLE[k]
        full = mix(full)
        each = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
        bounds = np.concatenate([[0], np.cumsum(each)])
        take = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], each)
        short = np.flatnonzero((counts > 0) & (counts < width))
        out = full[np.minimum(take, max(0, len(full) - 1))] if len(full) else np.zeros(bounds[-1], np.uint64)
        for d in short:
            own = h[self.bounds[d] : self.bounds[d + 1]]
            out[bounds[d]] = mix(np.array([int((own * _SHINGLE[: len(own)]).sum(dtype=np.uint64)) + len(own) & (2**64 - 1)], np.uint64))[0]
        return out, bounds

"""Directly addressable codes for unsigned integers.

Each value is split into 8-bit chunks, lowest first. Level k holds chunk k of every value that needs
more than k chunks, in order, with a bitmap of the entries that continue on level k + 1 and a rank
directory over that bitmap (ones before each 512-bit block). The place of a value on the next level is
the rank of its continuation bit, so any value is read with one byte and one rank per level; no block
is decoded.

Layout, little-endian: ``DAC1``, u32 levels, u64 values; per level u64 entries, the chunk bytes and,
except on the last level, the bitmap (64-byte blocks, zero-padded) and u64 ranks, one per block.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
_BLOCK = 64  # bytes of bitmap per rank


def encode(values: np.ndarray) -> bytes:
    rest = np.ascontiguousarray(values, np.uint64)
    top = int(rest.max()) if len(rest) else 0
    levels = max(1, -(-top.bit_length() // 8))
    out = [MAGIC, struct.pack("<IQ", levels, len(rest))]
    for level in range(levels):
        out += [struct.pack("<Q", len(rest)), (rest & np.uint64(255)).astype(np.uint8).tobytes()]
        if level + 1 < levels:
            rest = rest >> np.uint64(8)
            goes_on = rest > 0
            bits = np.packbits(goes_on, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % _BLOCK, np.uint8)])
            ones = np.bitwise_count(bits).reshape(-1, _BLOCK).sum(1, dtype=np.uint64)
            out += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
            rest = rest[goes_on]
    return b"".join(out)


class Codes:
    """Reads a coded sequence; ``codes[i]`` touches one chunk, one bitmap block and one rank per level."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a sequence of directly addressable codes")
        levels, self.n = struct.unpack_from("<IQ", blob, 4)
        at, self.levels = 16, []
        for level in range(levels):
            (m,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunk, at = np.frombuffer(blob, np.uint8, m, at), at + m
            bits = ranks = None
            if level + 1 < levels:
                blocks = -(-m // (8 * _BLOCK))
                bits, at = np.frombuffer(blob, np.uint8, blocks * _BLOCK, at), at + blocks * _BLOCK
                ranks, at = np.frombuffer(blob, "<u8", blocks, at), at + 8 * blocks
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * level)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = (i >> 9) * _BLOCK
            ones = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[i >> 9]) + ones
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint64)
        at = np.arange(self.n)
        for level, (chunk, bits, _) in enumerate(self.levels):
            out[at] |= chunk.astype(np.uint64) << np.uint64(8 * level)
            if bits is not None:
                at = at[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)]
        return out

"""Edit distance and indel similarity: bit-parallel routines in Arrow UDFs.

Distances follow Myers (1999) in Hyyrö's form (2003), the common subsequence Crochemore et al. (2001);
both take any sequences, so characters and words go the same way. Common ends are cut off first. Distances
of an Arrow batch are found together: long pairs that are near by waves along the diagonals, whose work grows with
the distance, others by numpy lanes of 64 rows within a band about the diagonal, which widens
for the pairs that turn out to lie farther apart; very different ones go through Python's long integers.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions import text as T
from quillspark.functions.batches import by_row


def _masks(a: Sequence) -> dict:
    at: dict = defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    return at


def _inner(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence, int]:
    """Without common ends, and how many elements those had."""
    n, i, j = min(len(a), len(b)), 0, 0
    while i < n and a[i] == b[i]:
        i += 1
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return a[i : len(a) - j], b[i : len(b) - j], i + j


def distance(a: Sequence, b: Sequence) -> int:
    """Unit-cost edit distance."""
    a, b, _ = _inner(a, b)
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    at, full, top = _masks(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        down = (((eq & plus) + plus) ^ plus) | eq | minus
        right_plus, right_minus = minus | (full & ~(down | plus)), plus & down
        score += bool(right_plus & top) - bool(right_minus & top)
        right_plus = (right_plus << 1) | 1
        plus, minus = (right_minus << 1) & full | (full & ~(down | right_plus)), right_plus & down & full
    return score


def common(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    a, b, same = _inner(a, b)
    if not a or not b:
        return same
    at, full = _masks(a), (1 << len(a)) - 1
    free = full
    for x in b:
        hit = free & at.get(x, 0)
        free = ((free + hit) | (free - hit)) & full
    return same + len(a) - free.bit_count()


def ratio(a: Sequence, b: Sequence) -> float:
    """0 to 100: share of both sequences in their longest common subsequence; two empty ones give 100."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if len(a) + len(b) else 100.0


#: Half the width of the first band; beyond the widest, pairs go one at a time. Pairs and masks that are worked on together.
BAND, WIDEST, TOGETHER, MASKS = 64, 1024, 512, 1 << 22
#: Pairs of so many elements are first tried by waves, up to a distance of 1 in so many elements; elements that are worked on together.
LONG, SHARE, SIGNS = 256, 16, 1 << 21
_FULL = np.uint64(2**64 - 1)


def distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Unit-cost edit distances of pairs of sequences of integers."""
    out = np.zeros(len(pairs), np.int64)
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (a, b) in enumerate(pairs):
        n = min(len(a), len(b))
        head = _equal(a[:n], b[:n])
        tail = _equal(a[len(a) - n + head :][::-1], b[len(b) - n + head :][::-1])
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if len(a) > len(b):
            a, b = b, a
        if len(a):
            todo.append((i, a, b))
        else:
            out[i] = len(b)
    todo.sort(key=lambda x: len(x[2]))
    todo = _near(todo, out)
    band = BAND
    while todo and band <= WIDEST:
        ready, later = [x for x in todo if len(x[2]) - len(x[1]) <= band], [x for x in todo if len(x[2]) - len(x[1]) > band]
        chunk: list[tuple[int, np.ndarray, np.ndarray]] = []
        for x in [*ready, None]:
            # Pairs of like length, not too many at a time, and masks that fit a cache or so.
            if chunk and (x is None or len(chunk) >= TOGETHER or len(x[2]) > 1.5 * len(chunk[0][2]) + 64 or (len(chunk) + 1) * len(x[1]) * min(len(x[1]), 256) > 64 * MASKS):
                found = _banded([(a, b) for _, a, b in chunk], band)
                for (i, a, b), d in zip(chunk, found.tolist()):
                    if d <= band:
                        out[i] = d
                    else:
                        later.append((i, a, b))
                chunk = []
            if x is not None:
                chunk.append(x)
        todo, band = sorted(later, key=lambda x: len(x[2])), 4 * band
    for i, a, b in todo:
        out[i] = distance(a.tolist(), b.tolist())
    return out


def _near(pairs: list[tuple[int, np.ndarray, np.ndarray]], out: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Puts the distances of long pairs that are near into ``out``, and returns the other pairs."""
    long, rest = [x for x in pairs if len(x[2]) >= LONG], [x for x in pairs if len(x[2]) < LONG]
    chunk: list[tuple[int, np.ndarray, np.ndarray]] = []
    for x in [*long, None]:
        if chunk and (x is None or len(chunk) >= TOGETHER or sum(len(y[1]) + len(y[2]) for y in chunk) > SIGNS):
            found = _waves([(a, b) for _, a, b in chunk])
            for own, d in zip(chunk, found.tolist()):
                if d < 0:
                    rest.append(own)
                else:
                    out[own[0]] = d
            chunk = []
        if x is not None:
            chunk.append(x)
    return sorted(rest, key=lambda x: len(x[2]))


def _waves(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distances of pairs (shorter, longer) of up to 1 in ``SHARE`` of their length, -1 for others (Ukkonen 1985, Myers 1986).

    Wave e holds how far e edits reach on each diagonal; what matches behind an edit is skipped eight bytes at a time.
    Pairs are lanes of one array, with the diagonals that may still reach their end in time.
    """
    every = np.concatenate([x for p in pairs for x in p])
    if 0 <= every.min() and every.max() < 4 * len(every):
        there = np.zeros(int(every.max()) + 1, bool)
        there[every] = True
        kinds, code = np.flatnonzero(there), (np.cumsum(there) - 1)[every]
    else:
        kinds, code = np.unique(every, return_inverse=True)
    kind = np.dtype("u1" if len(kinds) < 254 else "<u2" if len(kinds) < 65534 else "<u4")
    step = 8 // kind.itemsize
    # Behind each sequence stand signs that match nothing, another on each side.
    n, m = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    sides, at = [np.full(int(x.sum()) + len(pairs) + step, len(kinds) + i, kind) for i, x in enumerate((n, m))], 0
    base = [np.cumsum(x + 1) - x - 1 for x in (n, m)]
    for p in range(len(pairs)):
        for side, start, x in zip(sides, base, (n, m)):
            side[start[p] : start[p] + x[p]] = code[at : at + x[p]]
            at += x[p]
    a, b = (np.ndarray((len(s) - step + 1,), "<u8", s.data, 0, (kind.itemsize,)) for s in sides)
    shift = np.uint64((8 * kind.itemsize).bit_length() - 1)
    delta, out = m - n, np.full(len(pairs), -1, np.int64)
    most = np.maximum(m // SHARE, 1)
    for p in np.flatnonzero(n == m).tolist():  # replaced signs bound the distance
        most[p] = min(most[p], int((pairs[p][0] != pairs[p][1]).sum()))
    # Lanes: of each pair the diagonals low to high (place in b less place in a), with two beside them that nothing reaches.
    live = np.flatnonzero(delta <= most)
    slack = (most[live] - delta[live]) // 2
    low, size = -slack, delta[live] + 2 * slack + 1
    never = -(1 << 40)

    def lanes() -> tuple[np.ndarray, ...]:
        first = np.cumsum(size + 2) - size - 1
        of = np.repeat(np.arange(len(live)), size + 2)
        return first, of, np.arange(len(of)) - first[of] + low[of]

    first, of, diagonal = lanes()
    reach = np.full(len(of), never, np.int64)
    e = 0
    while len(live):
        # Diagonals that e edits get to, and from which what is left gets to the end.
        lo, hi = np.maximum(-e, np.maximum(low, delta[live] - (most[live] - e))), np.minimum(e, np.minimum(low + size - 1, delta[live] + most[live] - e))
        count = np.maximum(hi - lo + 1, 0)
        lane = np.repeat(first + lo - low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        own, k = live[of[lane]], diagonal[lane]
        if e:
            i = np.maximum(np.maximum(reach[lane], reach[lane + 1]) + 1, reach[lane - 1])
            np.minimum(i, np.minimum(n[own], m[own] - k), out=i)
        else:
            i = np.zeros(len(lane), np.int64)
        x, y = base[0][own] + i, base[1][own] + i + k
        some = np.arange(len(lane)) if e == 0 else np.flatnonzero((i >= 0) & (i + k >= 0))
        x, y = x[some], y[some]
        while len(some):
            differ = a[x] ^ b[y]
            same = (np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> shift).astype(np.int64)
            i[some] += same
            on = np.flatnonzero(same == step)
            some, x, y = some[on], x[on] + step, y[on] + step
        reach[:] = never
        reach[lane] = i
        ends = reach[first + delta[live] - low] >= n[live]
        out[live[ends]] = e
        e += 1
        gone = ends | (e > most[live])
        if gone.any():
            held = ~gone
            reach = reach[held[of]]
            live, low, size = live[held], low[held], size[held]
            first, of, diagonal = lanes()
    return out


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sequences of one length have in common from the start."""
    differ = a != b
    return int(differ.argmax()) if differ.any() else len(a)


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Distances of pairs (shorter, longer) that lie within ``band``; others come out larger than it.

    Word w of a pair, its rows 64 w + 1 to 64 w + 64, goes through column t - w at time t, one behind the word
    above it, whose step it needs. So the words of all pairs are lanes of one array. A word takes part from the
    column where its first row enters the band to that where its last one leaves; lanes are used in turn. Both
    sequences are filled up with as many signs of their own, which match, until rows fill whole words.
    """
    words = np.array([-(-len(a) // 64) for a, _ in pairs])
    fill = 64 * words - np.array([len(a) for a, _ in pairs])
    columns = np.array([len(b) for _, b in pairs]) + fill
    signs, base, masks, n = [], [], [], 0
    codes = np.zeros((int(columns.max()), len(pairs)), np.int64)
    for p, (a, b) in enumerate(pairs):
        kinds, code = np.unique(a, return_inverse=True)
        k = len(kinds) + 2  # 0: not in a; last: fills
        rows = np.concatenate([code + 1, np.full(fill[p], k - 1)])
        own = np.zeros(words[p] * k, np.uint64)
        np.add.at(own, np.arange(len(rows)) // 64 * k + rows, np.uint64(1) << (np.arange(len(rows)) % 64).astype(np.uint64))
        at = np.minimum(np.searchsorted(kinds, b), len(kinds) - 1)
        codes[: len(b), p] = np.where(kinds[at] == b, at + 1, 0)
        codes[len(b) : columns[p], p] = k - 1
        signs.append(k)
        base.append(n)
        masks.append(own)
        n += len(own)
    mask, sign, base = np.concatenate(masks), np.array(signs), np.array(base)
    lanes = (2 * band + 63) // 65 + 2
    shape = (lanes, len(pairs))
    plus, minus, score = np.full(shape, _FULL), np.zeros(shape, np.uint64), np.zeros(shape, np.int64)
    up, down = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)  # steps along a word's last row: 1 where it rises, falls
    out = np.zeros(len(pairs), np.int64)
    ends = columns + words - 1
    order = np.argsort(ends)
    done, high, row, word = 0, -1, np.zeros(shape, np.int64), np.zeros(lanes, np.int64)
    before, one, top, last = np.arange(-1, lanes - 1) % lanes, np.uint64(1), np.uint64(63), len(codes) - 1
    most = int(words.max()) - 1
    for t in range(1, int(ends.max()) + 1):
        low = max(0, -(-(t - 64 - band) // 65))
        first_up, first_down = up[before], down[before]
        while high < min(t - 1, (t - 1 + band) // 65, most):
            high += 1
            at, above = high % lanes, (high - 1) % lanes
            plus[at], minus[at] = _FULL, 0
            score[at] = 64 if high == 0 else score[above] - up[above].view(np.int64) + down[above].view(np.int64) + 64
            word = high - (high - np.arange(lanes)) % lanes  # of each lane: the last that took it
            row[at] = base + np.minimum(high, words - 1) * sign
        first_up[low % lanes], first_down[low % lanes] = 1, 0
        eq = mask[row + codes[np.minimum(np.maximum(t - 1 - word, 0), last)]]
        either = eq | minus
        eq |= first_down
        across = eq & plus
        across += plus
        across ^= plus
        across |= eq
        left = plus & across
        across |= plus
        right = minus | ~across
        up, down = right >> top, left >> top
        score += up.view(np.int64)
        score -= down.view(np.int64)
        right <<= one
        right |= first_up
        left <<= one
        left |= first_down
        minus = right & either
        either |= right
        plus = left | ~either
        while done < len(order) and ends[order[done]] == t:
            p = order[done]
            out[p] = score[(words[p] - 1) % lanes, p]
            done += 1
    return out


def word_diff(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, str]]:
    """eq, ins and del steps from a to b along a longest common subsequence; on ties insertions come last in the walk back.

    Rows of the table of lengths are kept as bits, set where a length doesn't grow; only each n-th row, n the
    root of their number, and the rows between two of them while the walk is there. So 50,000 words a side take
    a few megabytes.
    """
    at, full = _masks(b), (1 << len(b)) - 1

    def below(row: int, x: str) -> int:
        hit = row & at.get(x, 0)
        return ((row + hit) | (row - hit)) & full

    every = max(1, math.isqrt(len(a)))
    kept, row = [full], full
    for i, x in enumerate(a):
        row = below(row, x)
        if (i + 1) % every == 0:
            kept.append(row)
    block, rows = -1, [full]

    def get(i: int) -> int:
        nonlocal block, rows
        if i // every != block:
            block = i // every
            rows = [kept[block]]
            for x in a[block * every : block * every + every - 1]:
                rows.append(below(rows[-1], x))
        return rows[i % every]

    def length(row: int, j: int) -> int:
        return j - (row & ((1 << j) - 1)).bit_count()

    i, j, out = len(a), len(b), []
    here, above = get(i), get(i - 1) if i else full
    own, over = length(here, j), length(above, j)  # lengths at (i, j) and (i - 1, j)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            out.append(("eq", a[i - 1]))
            i, j = i - 1, j - 1
            here, above = above, get(i - 1) if i else full
            own, over = length(here, j), length(above, j)
        elif j and (not i or own - (not here >> (j - 1) & 1) >= over):
            j -= 1
            out.append(("ins", b[j]))
            own, over = own - (not here >> j & 1), over - (not above >> j & 1)
        else:
            i -= 1
            out.append(("del", a[i]))
            here, above = above, get(i - 1) if i else full
            own, over = over, length(above, j)
    return out[::-1]


_TOKEN = re.compile(r"\w+")
_SPLIT = {"chars": lambda s: s, "words": str.split, "tokens": _TOKEN.findall}


def _udf(split: str) -> Column:
    cut = _SPLIT[split]

    @F.pandas_udf("struct<distance: int, reference: int, hypothesis: int>")
    def measure(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        known: dict[tuple, int] = {}  # a batch's equal pairs are measured once
        place = np.array([known.setdefault(p, len(known)) for p in zip(ref, hyp)], np.int64)
        pairs = []
        for r, h in known:
            x, y = (np.frombuffer((s or "").encode("utf-32-le", "surrogatepass"), "<u4") if split == "chars" else cut(s or "") for s in (r, h))
            if split != "chars":
                code = pd.factorize(np.array([*x, *y], object))[0]
                x, y = code[: len(x)], code[len(x) :]
            pairs.append((x, y))
        found = pd.DataFrame({"distance": distances(pairs), "reference": [len(x) for x, _ in pairs], "hypothesis": [len(y) for _, y in pairs]})
        return found.iloc[place].reset_index(drop=True)

    return measure


def measures(ref: Column, hyp: Column, split: str = "chars") -> Column:
    """struct(distance, reference, hypothesis): the edit distance and both lengths, of chars, words or tokens."""
    return _udf(split)(ref, hyp)


def error_rate(m: Column) -> Column:
    """Distance over the reference's length; may exceed 1; an empty reference gives 0 or 1."""
    return F.when(m["reference"] == 0, F.when(m["hypothesis"] == 0, 0.0).otherwise(1.0)).otherwise(m["distance"] / m["reference"])


def cer(ref: Column, hyp: Column) -> Column:
    return error_rate(measures(ref, hyp, "chars"))


def wer(ref: Column, hyp: Column) -> Column:
    return error_rate(measures(ref, hyp, "words"))


def normalised(a: Column, b: Column, split: str = "chars") -> Column:
    """Distance over the longer length; 0 for two empty ones."""
    m = measures(a, b, split)
    return T.safe_div(m["distance"].cast("double"), F.greatest(m["reference"], m["hypothesis"]).cast("double"))


@F.pandas_udf(DoubleType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def diff_words(a: Column, b: Column) -> Column:
    """The steps of ``word_diff`` between the words of two texts: array of struct(op, word)."""
    steps = lambda x, y: [{"op": o, "word": w} for o, w in word_diff((x or "").split(), (y or "").split())]
    return by_row(steps, "array<struct<op: string, word: string>>")(a, b)

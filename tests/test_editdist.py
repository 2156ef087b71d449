import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import editdist
from quillspark.operators import matching


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=150), st.text("abcd", max_size=150)), min_size=1, max_size=8))
def test_distances_of_a_batch(pairs):
    codes = [tuple(np.array(list(map(ord, s)), np.int64) for s in p) for p in pairs]
    assert editdist.distances(codes).tolist() == [table(a, b) for a, b in pairs]


def edited(rng, a, n):
    b = list(a)
    for _ in range(n):
        at = rng.randrange(len(b) + 1)
        b[at : at + rng.choice([0, 1])] = [rng.randrange(60)] * rng.choice([0, 1, 2])
    return b


@pytest.mark.parametrize("sizes", [(1, 70), (500, 3000), (64, 64), (4000, 4100)])
def test_bands_widen_for_what_lies_apart(sizes):
    rng = random.Random(3)
    pairs = []
    for i in range(40):
        a = [rng.randrange(60) for _ in range(rng.randint(*sizes))]
        b = [rng.randrange(60) for _ in range(rng.randint(*sizes))] if i % 8 == 0 else edited(rng, a, rng.choice([0, 1, 5, 60, 70, 200, 300]))
        pairs.append((np.array(a, np.int64), np.array(b, np.int64)))
    assert editdist.distances(pairs).tolist() == [editdist.distance(a.tolist(), b.tolist()) for a, b in pairs]


def test_a_batch_is_faster_than_one_at_a_time():
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = [rng.randrange(60) for _ in range(rng.randint(1500, 3000))]
        pairs.append((np.array(a, np.int64), np.array(edited(rng, a, 40), np.int64)))
    begun = time.process_time()
    got = editdist.distances(pairs).tolist()
    together = time.process_time() - begun
    begun = time.process_time()
    assert got == [editdist.distance(a.tolist(), b.tolist()) for a, b in pairs]
    assert 2 * together < time.process_time() - begun


def walked(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("eq", a[i]))
        elif j and (not i or t[i][j - 1] >= t[i - 1][j]):
            j -= 1
            out.append(("ins", b[j]))
        else:
            i -= 1
            out.append(("del", a[i]))
    return out[::-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abce"), max_size=40))
def test_word_diff_walks_as_the_whole_table_does(a, b):
    assert editdist.word_diff(a, b) == walked(a, b)


def test_word_diff_of_long_texts():
    rng = random.Random(5)
    a = [str(rng.randrange(3000)) for _ in range(50_000)]
    b = [w for w in a if rng.random() > 0.02]
    steps = editdist.word_diff(a, b)
    assert [w for o, w in steps if o != "ins"] == a and [w for o, w in steps if o != "del"] == b and sum(o == "eq" for o, _ in steps) == len(b)


def by_all_lines(candidate, source, threshold=matching.ANCHOR):
    lines, wanted = [x for x in source.splitlines() if x.strip()], [x for x in candidate.splitlines() if x.strip()]
    if not lines or not wanted:
        return candidate
    score, first = max((editdist.ratio(wanted[0], x), -i) for i, x in enumerate(lines))
    if score <= 0 or score < threshold:
        return candidate
    end = first = -first
    for want in wanted[1:]:
        best, at = 0.0, end
        for i in range(end, min(len(lines), end + 2 * matching.MAX_JOIN)):
            for n in range(1, min(matching.MAX_JOIN, len(lines) - i) + 1):
                s = editdist.ratio(want, " ".join(lines[i : i + n]))
                if s > best:
                    best, at = s, i + n - 1
        if best >= threshold and best > 0:
            end = at
    return "\n".join(lines[first : end + 1])


def test_alignment_compares_few_lines_and_finds_the_same(monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    asked = []
    ratio = editdist.ratio
    for i in range(30):
        lines = [" ".join(word() for _ in range(rng.randint(1, 7))) for _ in range(60)]
        lines[7] = lines[30]
        at = rng.randrange(50)
        taken = "\n".join("".join("x" if rng.random() < 0.05 else c for c in " ".join(lines[j : j + 2]) if rng.random() > 0.03) for j in range(at, at + 6, 2))
        candidate = word() if i % 7 == 0 else taken
        want = by_all_lines(candidate, "\n\n".join(lines))
        monkeypatch.setattr(editdist, "ratio", lambda a, b: asked.append(1) or ratio(a, b))
        assert matching.align(candidate, "\n\n".join(lines)) == want
        monkeypatch.setattr(editdist, "ratio", ratio)
    assert len(asked) < 30 * 60  # of some 60 lines and 2 times 57 runs each


def test_long_texts_that_are_near_need_no_pass_over_the_table(monkeypatch):
    """Work by distance, not by length: pairs of 100,000 signs, of small and large alphabets, with known distances."""
    rng = random.Random(7)
    pairs, want = [], []
    for kinds, n, every in ((60, 100_000, 80), (60, 3000, 100), (100_000, 20_000, 50), (3, 2000, 100)):
        a = np.array([rng.randrange(kinds) for _ in range(n)], np.int64)
        b = a.copy()
        b[::every] = kinds + 1  # a sign that a doesn't have: one edit each
        pairs.append((a, b))
        want.append(-(-n // every))
        pairs.append((a, np.concatenate([b, [kinds + 2] * 5])))
        want.append(want[-1] + 5)
    some = [(a, np.array(edited(rng, a.tolist(), len(a) // 60), np.int64)) for a, _ in pairs if len(a) < 5000]
    exact = [editdist.distance(a.tolist(), b.tolist()) for a, b in some]

    def none(*_):
        raise AssertionError("a pass over the table")

    monkeypatch.setattr(editdist, "_banded", none)
    monkeypatch.setattr(editdist, "distance", none)
    assert editdist.distances(pairs).tolist() == want
    assert editdist.distances(some).tolist() == exact

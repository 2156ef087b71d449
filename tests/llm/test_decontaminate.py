import math
import random
import re
from collections import Counter

import pytest

from quillspark.llm import decontaminate


def words(t):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(w, width):
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]


def brute(docs, bench, limit=0.8):
    items = [(i, words(t)) for i, t in bench if words(t)]
    df = Counter(s for _, w in items for s in set(shingles(w, min(5, len(w)))))
    weight = lambda s: 1 + math.log(len(bench) / max(1, df[s]))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            width = min(5, len(x))
            y, mine = Counter(shingles(x, width)), shingles(w, width) or ([tuple(w)] if w and width == 5 else [])
            m, best = sum(y.values()), (0, 0)
            for s in range(max(1, len(mine) - m + 1)):
                z = Counter(mine[s : s + m])
                both, either = sum(n * weight(g) for g, n in (y & z).items()), sum(n * weight(g) for g, n in (y | z).items())
                if both / either > best[0] + 1e-9:
                    best = (both / either, s)
            if best[0] >= limit:
                out[d, i] = best
    return out


@pytest.fixture
def bench(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(rng.randint(14, 60))).capitalize() + ".") for i in range(25)]
    return rows + [(50, "two words"), (51, None), (52, "!?"), (53, rows[0][1])], rng, word


@pytest.mark.parametrize("part_chars", [1 << 24, 1500])
def test_against_brute_force(spark, bench, odd_docs, part_chars):
    rows, rng, word = bench
    docs = [(1000 + i, " ".join(word() for _ in range(rng.randint(0, 90)))) for i in range(30)]
    for i, t in rows[:20]:
        w = t.split()
        for _ in range(rng.choice([0, 0, 1, 2])):  # verbatim and edited
            w[rng.randrange(len(w))] = word()
        docs.append((2000 + i, " ".join([word() for _ in range(rng.randint(0, 50))] + w + [word() for _ in range(rng.randint(0, 50))]).upper()))
    docs += [(3000, "here are two, words"), (3001, rows[3][1] + " x " + rows[4][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).union(odd_docs.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.matches(table, spark.createDataFrame(rows, "item_id long, text string"), part_chars=part_chars).collect()}
    want = brute(docs, rows)
    if part_chars > 1500:  # weights count the items of a part
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-5 and got[k][1] == want[k][1] for k in want)
    else:
        assert {k for k, v in want.items() if v[0] == 1} <= set(got)
    kept = decontaminate.clean(table.withColumnRenamed("doc_id", "id"), spark.createDataFrame(rows, "item_id long, text string"), part_chars=part_chars)
    assert {r.id for r in kept.collect()} == {r.doc_id for r in table.collect()} - {d for d, _ in got}


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(odd_docs, none).count() == 0
    assert decontaminate.clean(odd_docs, none).count() == odd_docs.count()
    assert decontaminate.matches(no_docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_parts_weigh_as_the_whole_benchmark(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(20)]
    rows = [(i, " ".join(shared + [word() for _ in range(20)])) for i in range(20)]
    docs = [(i, " ".join(t.split()[:-2] + [word(), word()])) for i, t in rows]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    whole, dealt = (sorted(map(tuple, decontaminate.matches(docs, bench, part_chars=n).collect())) for n in (1 << 24, 1500))
    assert len(whole) and [x[:2] for x in dealt] == [x[:2] for x in whole]
    assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(dealt, whole))


def test_lookup_in_chunks_finds_all_that_is_near(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    monkeypatch.setattr(decontaminate, "PAIRS", 500)
    index = decontaminate.Index.__new__(decontaminate.Index)
    index.prints = rng.integers(0, 2**64, 120, dtype=np.uint64)
    blocks = index.prints.view(np.uint8).reshape(-1, 8).T
    index.tables = {(5, 9): (np.arange(120), np.argsort(blocks, axis=1, kind="stable"), np.stack([np.searchsorted(np.sort(b), np.arange(257)) for b in blocks]))}
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(200)], np.uint64)
    prints = index.prints[rng.integers(0, 120, 200)] ^ flips
    want = [(i, j) for i, p in enumerate(prints) for j, q in enumerate(index.prints) if bin(int(p) ^ int(q)).count("1") <= decontaminate.RADIUS]
    assert list(index.near((5, 9), prints)) == want and len(want) > 100


def test_long_texts_in_stretches(spark, monkeypatch):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = " ".join(word() for _ in range(40))
    text = " ".join([*(word() for _ in range(3000)), item, *(word() for _ in range(3000)), item.replace(" ", "  ", 3)])
    docs, bench = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    whole = decontaminate.matches(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "STRETCH", 50)
    index = next(decontaminate.indexes(bench, 1 << 20, 0.8))
    import pyarrow as pa

    assert [(i, [(k, s) for k, _, s in m]) for i, m in index.documents(pa.array([text, "x"]))] == [(0, [(0, 3000)])]
    assert [(r.doc_id, r.item_id, r.start_word) for r in whole] == [(1, 7, 3000)]

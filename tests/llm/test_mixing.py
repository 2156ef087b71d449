import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm import mixing


def water_fill(size, weight, cap=3):
    total, target, open_ = sum(size.values()), {}, set(size)
    while open_:
        rest = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > cap * size[s]}
        if not over:
            return target | {s: rest * weight[s] / w for s in open_}
        target |= {s: cap * size[s] for s in over}
        open_ -= over
    return target


def check(docs, block):
    rows = docs.collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    want = water_fill(size, {s: i % 3 + 1 for i, s in enumerate(names)})
    got = mixing.taken_words(docs, block).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 1, s
    return {(r.doc_id, r.source, r.size, r.taken) for r in got}


def test_targets_caps_and_reruns(spark, odd_docs):
    assert check(odd_docs, 64) == check(odd_docs.repartition(5), 64)
    check(odd_docs, 100_000)


def test_slices_cover_what_is_taken_in_slot_order(spark, odd_docs):
    slices, _, sources = mixing.mix(odd_docs, 50)
    per_slot = slices.groupBy("slot", "source").agg(F.sum(F.col("last_word") - F.col("first_word")).alias("n")).collect()
    by = defaultdict(list)
    for r in per_slot:
        by[r.source].append(r.n)
    for s, n in by.items():
        assert sorted(n)[1:] == [50] * (len(n) - 1) and 0 < min(n) <= 50, (s, n)  # one block size; only the last may be shorter
    slots = [r.slot for r in per_slot]
    assert len(slots) == len(set(slots))


def test_first_slots_walk_the_points(spark, odd_docs):
    """The whole schedule once more in plain Python: which slot each document is first taken in."""
    block, rows = 64, mixing.taken_words(odd_docs, 64).collect()
    source = {}
    for r in rows:
        source.setdefault(r.source, (min(round(r.target), 3 * r.source_size), r.slots))
    names = sorted(source, key=lambda s: (s is None, s))
    total, at, edges = sum(t for t, _ in source.values()), 0, []
    for s in names:
        at += source[s][0]
        edges.append((s, int(at / total * float(1 << 62))))
    order, points = defaultdict(list), -(-total // block)
    for i in range(points):
        u = i * mixing.STEP % (1 << 62)
        own = next((s for s, high in edges if u < high), None)
        if any(u < high for _, high in edges) and len(order[own]) < source[own][1]:
            order[own].append(i)
    late = sorted(((k, names.index(s), s) for s in names for k in range(len(order[s]), source[s][1])))
    for j, (_, _, s) in enumerate(late):
        order[s].append(points + j)
    assert all(len(order[s]) == -(-source[s][0] // block) for s in names)
    before = {r.row: r.before for r in mixing.mix(odd_docs, block)[1].collect()}
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
        assert (r.first_slot is None) == (r.taken == 0)
        if r.first_slot is not None:
            assert r.first_slot == min(order[r.source][b] for b in range(before[r.row] // block, min(before[r.row] + r.size - 1, source[r.source][0] - 1) // block + 1))


def test_points_follow_the_golden_ratio(spark):
    shares = spark.createDataFrame([("a", 0, 1 << 61), ("b", 1 << 61, 1 << 62)], "source string, low long, high long")
    got = {r.slot: (r.source, r.block) for r in mixing.schedule(shares, 5000).collect()}
    ranks = {"a": 0, "b": 0}
    for i in range(5000):
        s = "a" if i * mixing.STEP % (1 << 62) < 1 << 61 else "b"
        assert got[i] == (s, ranks[s])
        ranks[s] += 1
    assert abs(ranks["a"] - 2500) < 10


def test_empty_table(no_docs):
    assert mixing.taken_words(no_docs).count() == 0

import hashlib
import re
from collections import defaultdict

from quillspark.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        t = r.text or ""
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), r.doc_id is None, r.doc_id))
    return groups


def test_against_brute_force(spark, odd_docs):
    rows = odd_docs.collect()
    groups = brute(rows)
    got = exact.dedup(odd_docs.repartition(7).withColumn("copies", odd_docs.n_chars)).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = by[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(own))
    assert sum(r.kept for r in got) == len(groups)


def test_empty_table(no_docs):
    assert exact.dedup(no_docs).count() == 0


def test_large_groups_meet_their_entry_by_broadcast(spark):
    rows = [(i, " same  text " if i % 3 else "same text") for i in range(2600)] + [(None, "sametext"), (5000, "other"), (5001, "oth er")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(11)).collect()}
    assert got == {(i, 1, 2601, i == 1) for i in [*range(2600), None]} | {(5000, 5001, 2, False), (5001, 5001, 2, True)}


def test_levels_are_sorted_runs(spark, monkeypatch):
    levels = []
    level = exact._level
    monkeypatch.setattr(exact, "_level", lambda runs, n: levels.append(level(runs, n)) or levels[-1])
    rows = [(i, f"text {i % 40}") for i in range(400)]
    out = exact.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(20)).collect()
    assert len(levels) == 3 and [x.select("run").distinct().count() for x in levels] == [20, 3, 1]  # 20 runs, then eight into one
    assert sum(r.kept for r in out) == 40 and levels[-1].count() == 40
    for x in levels:
        for part in x.select("run", *exact._KEYS).rdd.glom().collect():
            assert [tuple(r) for r in part] == sorted(tuple(r) for r in part)

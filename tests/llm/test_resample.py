import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import resample

DOCS = "doc_id long, text string"


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def brute(rows, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[0]), Counter(bucket(f) for x in target for f in features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        own, n = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(best[: percent * len(best) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcXYZ09 .,\n'")), max_size=200), min_size=1, max_size=4))
def test_checksums_of_features(texts):
    texts = [*texts, "a " + "b" * 70 + " c", "x" * 64 + " " + "y" * 64 + "z " + "w" * 63]
    for _, data, offsets in resample.textvec.slices(pa.array(texts)):
        crc, bounds, n = resample.features(data, offsets)
        for i, text in enumerate(texts):
            own, words = features(text)
            assert crc[bounds[i] : bounds[i + 1]].tolist() == [zlib.crc32(f.encode()) for f in own] and n[i] == words


@pytest.mark.parametrize("percent", [25, 100])
def test_against_brute_force(spark, odd_docs, percent):
    target = ["The quick brown fox, of the and was to", None, "", "no id here"]
    more = spark.createDataFrame([(i, f"{'of the and was to ' * 5}word{i % 3}") for i in range(300, 340)], DOCS)
    docs = odd_docs.select("doc_id", "text").union(more).repartition(3)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([tuple(r) for r in docs.collect()], target, percent)


def test_many_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(resample, "noise", lambda doc_id, seed: resample.F.lit(5))  # equal scores: ranks go by id
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('same words here ', 9), concat(repeat('own words ', 12), id)) as text").repartition(5)
    got = resample.resample(docs, docs.limit(0))
    by = {}
    for r in got.collect():
        by.setdefault(r.score, []).append(r)
    drawn = sorted((r.rank, -r.score, r.doc_id) for rows in by.values() for r in rows if r["rank"])
    assert [d[0] for d in drawn] == list(range(1, 751)) and [d[1:] for d in drawn] == sorted(d[1:] for d in drawn)
    assert len({r.weight for r in by[max(by)]}) == 1


def test_empty_tables(spark, no_docs):
    assert resample.resample(no_docs, no_docs).count() == 0
    one = spark.createDataFrame([(1, "a b")], DOCS)
    assert [tuple(r) for r in resample.resample(one, no_docs).collect()] == brute([(1, "a b")], [])


def test_buckets_fit_two_bytes(spark, no_docs):
    with pytest.raises(ValueError):
        resample.resample(no_docs, no_docs, buckets=1 << 17)
    assert np.array([9999], "<u2")[0] == 9999

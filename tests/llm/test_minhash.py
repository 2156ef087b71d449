import random

import numpy as np
import pytest
from test_ngram_join import brute

from quillspark.llm import minhash, ngram_join

DOCS = "doc_id long, text string"


def one_by_one(tokens, slots):
    """SuperMinHash as published: one element after the other, each with a permutation of its own."""
    h = [2**64 - 1] * slots
    for t in tokens:
        p = list(range(slots))
        for j in range(slots):
            drawn = minhash.textvec.mix(np.array([t], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            k = j + (((int(minhash.textvec.mix(drawn)[0]) >> 32) * (slots - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            h[p[j]] = min(h[p[j]], j << 56 | int(drawn[0]) >> 8)
    return h


def test_signatures_equal_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 0, 7, 60, 400, 3)]
    got = minhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 32)
    for g, s in zip(got, sets):
        assert g.tolist() == one_by_one(s.tolist(), 32)


def test_agreement_estimates_similarity_with_less_variance():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(150):  # two sets of 60 with 45 in common: similarity 0.6
        x = rng.integers(0, 2**64, 75, dtype=np.uint64)
        a, b = minhash.signatures(np.concatenate([x[:60], x[15:]]), np.array([0, 60, 120]), 96)
        errors.append((a == b).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.75 * 0.6 * 0.4 / 96


def near(rng, docs, odd):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, common = [], [word() for _ in range(30)]
    for size, changes in ((2, 2), (5, 3), (60, 3), (40, 4)):  # copies with a few words changed, some near the limit
        base = [word() for _ in range(150)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, changes)):
                copy[rng.randrange(150)] = word()
            rows.append(copy[: rng.randint(120, 149)] if rng.random() < 0.2 else copy)
    chain = [word() for _ in range(200)]
    rows += [chain[i : i + 100] for i in range(0, 100, 5)]  # each linked with the next ones only
    rows += [[word() for _ in range(25)] + common for _ in range(40)] + [["a", "b"], ["A", "b"], ["a"], [], ["a", "b", "c", "d", "e"]]
    return docs([(i, " ".join(r)) for i, r in enumerate(rows)], DOCS).repartition(3).union(odd.select("doc_id", "text"))


@pytest.mark.parametrize("hubs, few", [(minhash.HUBS, minhash.BROADCAST_ROWS), (0, 0)])
def test_against_brute_force(spark, odd_docs, monkeypatch, hubs, few):
    monkeypatch.setattr(minhash, "HUBS", hubs)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", few)
    docs = near(random.Random(11 + hubs), spark.createDataFrame, odd_docs)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(docs.collect(), 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_copies_edited_each_in_its_own_way(spark, monkeypatch):
    """Hardly any is linked with the hub; pairs of them are, and so are two with the same edits."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(160)], []
    for i in range(80):
        copy = list(base)
        for _ in range(rng.choice([2, 3, 4, 5, 6])):
            copy[rng.randrange(160)] = word()
        rows.append(copy)
        if i % 5 == 0:  # another near it, by some more edits
            rows.append([word() if rng.random() < 0.015 else w for w in copy])
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], DOCS)
    want = brute(docs.collect(), 85)
    assert 5 < len({w[2] for w in want}) < 90
    met = []
    by_difference = minhash._by_difference
    monkeypatch.setattr(minhash, "_by_difference", lambda *a: met.append(by_difference(*a)) or met[-1])
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert met[0].count() < 400  # of 4,560 pairs


def test_empty_table_and_no_links(spark, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (None, "h i")], DOCS)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=repr) == sorted([(1, 3, 1, True), (2, 0, 2, True), (None, 1, None, True)], key=repr)


def thue_morse(n, first):
    at = lambda i: (bin(i).count("1") + first) % 2
    return "".join("ab"[at(i)] for i in range(n))


@pytest.mark.parametrize("find", [ngram_join.join, minhash.near_duplicates])
def test_words_that_collide_under_polynomial_hashes(spark, find):
    docs = spark.createDataFrame([(i, thue_morse(n, i % 2)) for i, n in enumerate((1024, 1024, 4096, 4096))], DOCS)
    assert {(r.doc_id, r.component_id) for r in find(docs).collect()} == {(i, i) for i in range(4)}

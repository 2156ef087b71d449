import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import passages


def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.Generator(np.random.PCG64(1))
    tokens = rng.integers(0, 1 << 60, 700, dtype=np.uint64)
    bounds = np.array([0, 45, 45, 91, 391, 700])
    got = set(zip(*(x.tolist() for x in passages.windows(tokens, bounds, 2)[:4])))
    h, want = passages.textvec.mix(tokens ^ passages._SEEDS[2]), set()
    for d in range(5):
        stack = [(bounds[d], bounds[d + 1] - 1)]
        while stack:
            l, r = stack.pop()
            if r - l + 1 >= passages.TOKENS:
                c = l + int(h[l : r + 1].argmin())
                want.add((d, max(l, c - passages.TOKENS + 1), c, min(r, c + passages.TOKENS - 1)))
                stack += [(l, c - 1), (c + 1, r)]
    assert got == {tuple(map(int, w)) for w in want}


def test_planted_passages_and_clean_documents(spark, odd_docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    docs, planted = {}, defaultdict(list)
    for p in range(12):  # exact passages, in 2 to 40 documents
        passage = some(rng.randint(51, 90))
        for k in range(rng.choice([2, 3, 40])):
            before = some(rng.randint(0, 80))
            planted[20000 + p * 100 + k].append((len(before), len(before) + len(passage)))
            docs[20000 + p * 100 + k] = before + passage + some(rng.randint(0, 80))
    base = some(200)
    for k in range(3):  # near copies: a word in 60 changed
        docs[5000 + k] = [word() if i % 60 == 17 * k % 60 else w for i, w in enumerate(base)]
    clean = {9000 + k: some(rng.randint(1, 200)) for k in range(30)}
    for k in (9000, 9001):
        clean[k] = some(30) + base[:40] + some(30)  # too short to count
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in (docs | clean).items()], "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    rows = passages.find(table.union(odd_docs.select("doc_id", "text"))).collect()
    for r in rows:
        got[r.doc_id].append((r.start_word, r.end_word))
        assert r.match_doc_id != r.doc_id or r.doc_id == 1
    assert not set(got) & set(clean)
    for i, own in planted.items():
        for a, b in own:
            assert any(s <= a + 5 and e >= b - 5 for s, e in got[i]), (i, a, b, got[i])
            assert all(s >= a - 8 and e <= b + 8 for s, e in got[i]), (i, a, b, got[i])
    assert all(sum(e - s for s, e in got[5000 + k]) >= 150 for k in range(3))
    copies = [r for r in odd_docs.collect() if 100 <= (r.doc_id or 0) < 130]
    if len(copies[0].text.split()) >= 50:
        assert all(got[r.doc_id] == [(0, len(r.text.split()))] for r in copies)


def test_empty_table(no_docs):
    assert passages.find(no_docs).count() == 0


def test_a_hub_that_shares_a_fragment_hides_no_repeat(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    pieces = [some(44) for _ in range(5)]
    docs = [some(30) + p + some(30) for p in pieces for _ in range(40)]  # boilerplate
    pairs = []
    for p in pieces:
        for _ in range(4):
            passage = p + some(10)
            pairs.append((len(docs), len(docs) + 1))
            docs += [some(25) + passage + some(25) for _ in range(2)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.match_doc_id) for r in passages.find(table).collect()}
    assert got == {p for a, b in pairs for p in ((a, b), (b, a))}


def test_one_edit_anywhere_hides_no_repeat(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    docs = []
    for k in range(40):
        passage = some(51)
        at = 20 + k % 12
        edited = passage[:at] + [[word()], [], [word(), passage[at]]][k % 3] + passage[at + 1 :]
        docs += [some(30) + passage + some(30), some(40) + edited + some(20)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.match_doc_id) for r in passages.find(table).collect()}
    assert got == {(i, i ^ 1) for i in range(len(docs))}


def test_every_partner_of_a_text_has_a_row(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    p = [some(70) for _ in range(5)]
    docs = [p[0] + p[1], p[0] + some(9), some(9) + p[1]]  # adjoining passages
    docs += [some(9) + p[2] + some(9), some(9) + p[2] + some(20)] + [p[3]] * 2 + [some(9) + p[3]]  # exact copies with a partial passage
    docs += [p[4], p[4] + some(60)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.match_doc_id) for r in passages.find(table).collect()}
    assert {(0, 1), (0, 2), (1, 0), (2, 0), (3, 4), (4, 3), (5, 6), (6, 5), (5, 7), (6, 7), (7, 5), (8, 9), (9, 8)} <= got


def test_recall_and_precision_against_brute_force(spark):
    """Passages of 50 to 80 words with up to two edits, some handed on to other copies: every pair of texts compared whole."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + 1] = [[word()], [], [word(), words[at]]][kind]
        return words

    docs = []
    for _ in range(60):
        versions = [some(rng.randint(50, 80))]
        for _ in range(rng.randint(1, 4)):
            versions.append(edited(rng.choice(versions), rng.randint(0, 2)))
        docs += [some(rng.randint(0, 40)) + v + some(rng.randint(0, 40)) for v in versions]
    docs += [some(rng.randint(1, 150)) for _ in range(40)] + [["the"] * rng.randint(60, 90) + some(30) for _ in range(10)]
    texts = pa.array([" ".join(d) for d in docs])
    tokens = []
    for _, data, offsets in passages.textvec.slices(texts):
        own, bounds = passages.textvec.Words(data, offsets).shingles(passages.WIDTH)
        tokens += [own[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    near = {(a, b) for a in range(len(docs)) for b in range(len(docs)) if a != b and len(passages.spans(tokens[a], tokens[b]))}
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.match_doc_id) for r in passages.find(table).collect()}
    assert got <= near and len(near) > 200
    assert len({a for a, _ in got}) >= 0.98 * len({a for a, _ in near})

    def classes(pairs):
        least = list(range(len(docs)))
        for _ in range(10):
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    assert sum(x == y for x, y in zip(classes(got), classes(near))) >= 0.97 * len(docs)


def test_hashes_of_many_texts_are_those_of_each():
    rng = np.random.Generator(np.random.PCG64(3))
    tokens, bounds = rng.integers(0, 1 << 63, 400, dtype=np.uint64), np.array([0, 0, 46, 130, 130, 400])
    each = [passages.text_hash(tokens[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    assert passages.text_hashes(tokens, bounds).tolist() == each and len(set(each)) == 4


def test_no_stretch_is_lost_to_hubs(spark):
    """Near copies that share more with each other than with a hub, against comparing all pairs."""
    ids = [2, 56, 547, 1451, 1537, 1700, 2059, 4074, 5084, 5302, 5657, 5892, 6020, 6605, 6681, 9082, 9388]
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(F.col("doc_id").isin(ids)).select("doc_id", "text")
    tokens = {}
    for r in table.collect():
        _, data, offsets = next(passages.textvec.slices(pa.array([r.text])))
        tokens[r.doc_id] = passages.textvec.Words(data, offsets).shingles(passages.WIDTH)[0]
    held, want = defaultdict(set), defaultdict(set)
    for r in passages.find(table).collect():
        held[r.doc_id] |= set(range(r.start_word, r.end_word))
    for a in tokens:
        for b in tokens:
            for first, last in passages.spans(tokens[a], tokens[b]) if a != b else []:
                want[a] |= set(range(first, last + passages.WIDTH - 1))
    missed = sum(len(want[a] - held[a]) for a in tokens)
    assert missed < 0.01 * sum(map(len, want.values())), missed


def test_rows_of_a_group_grow_with_its_texts(spark, monkeypatch):
    """A passage that every text goes on from in its own way, with much that other texts hold: two rows a text or so, not one for each pair."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    passage, compared, turn = some(60), [], passages._turn
    docs = []
    for _ in range(60):
        tail = some(45)
        docs += [some(5) + passage + tail, some(60) + tail + some(60)]
    monkeypatch.setattr(passages, "_turn", lambda pairs, shared: compared.append(pairs.count()) or turn(pairs, shared))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = passages.find(table).collect()
    assert {r.doc_id for r in got if r.end_word - r.start_word >= 58} == set(range(0, 120, 2))
    assert len(got) <= 6 * 60 and sum(compared) <= 60 * 3 * 45, (len(got), compared)

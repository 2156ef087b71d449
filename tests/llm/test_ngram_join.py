import random
import re
from collections import defaultdict

from quillspark.llm import ngram_join

DOCS = "doc_id long, text string"


def brute(rows, percent=80):
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [shingles(r.text) for r in rows]
    by, at = defaultdict(set), list(range(len(rows)))
    for i, x in enumerate(s):
        for g in x:
            by[g].add(i)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, x in enumerate(s):
        for j in {j for g in x for j in by[g] if j > i}:
            if 100 * len(x & s[j]) >= percent * len(x | s[j]):
                at[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        k = root(i)
        ids = [v for v in (least.get(k), r.doc_id) if v is not None]
        least[k] = min(ids) if ids else None
    return sorted(((r.doc_id, len(s[i]), least[root(i)]) for i, r in enumerate(rows)), key=repr)


def run(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()), key=repr)


def test_near_copies_of_every_kind(spark, odd_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, common = [], [word() for _ in range(30)]
    for size in (2, 5, 60):  # clusters: each copy with a few words changed, some near the limit
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                copy[rng.randrange(120)] = word()
            if rng.random() < 0.2:
                copy = copy[: rng.randint(90, 119)]
            rows.append(copy)
    rows += [[word() for _ in range(25)] + common for _ in range(40)]  # a passage in many documents
    rows += [common + [word()] for _ in range(10)] + [["a", "b"], ["A", "b"], ["a"], [], ["a", "b", "c", "d", "e"]]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], DOCS).repartition(3)
    docs = docs.union(odd_docs.select("doc_id", "text"))
    assert run(docs) == brute(docs.collect())


def test_empty_table(no_docs):
    assert ngram_join.join(no_docs).count() == 0

"""Near dedup against brute force: a whole table, a family of near copies, and how the pairs to confirm grow with it."""

from collections import Counter, defaultdict

import numpy as np
from convan.llm import near_dedup


def components(texts):
    """The smallest id that each id reaches, over all pairs that share a shingle."""
    sets = {i: set(near_dedup.shingle_set(t).tolist()) for i, t in texts}
    holds = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holds[x].append(i)
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holds[x] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: (root(i), len(s)) for i, s in sets.items()}


def family(n, words=200, edits=(1, 6), seed=5):
    """Copies of one text, each with a few words changed: many lie below the threshold to each other, and some to all."""
    rng = np.random.default_rng(seed)
    base = [f"t{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for i in range(n):
        mine = list(base)
        for at in rng.choice(words, rng.integers(*edits), replace=False):
            mine[at] = f"n{rng.integers(0, 10**9)}"
        out.append((i, " ".join(mine)))
    return out


def found(df):
    return {r.doc_id: (r.component_id, r.n_shingles) for r in df.collect()}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = near_dedup.near_dedup(docs).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_family(spark):
    texts = family(300, edits=(1, 8))
    want = components(texts)
    assert len({c for c, _ in want.values()}) > 1  # some have no link
    assert found(near_dedup.near_dedup(spark.createDataFrame(texts, "doc_id long, text string"))) == want


def test_large_sets(spark):
    """Sets beyond the sketch that counts differences, at 0.76 and at 0.74."""
    rng = np.random.default_rng(1)
    texts = []
    for i, share in enumerate((0.76, 0.74)):
        base = [f"{i}w{x}" for x in rng.integers(0, 10**6, 9000)]
        own = round(9000 * (1 - share) / (1 + share))
        texts += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: 9000 - own] + [f"{i}o{x}" for x in range(own)]))]
    got = found(near_dedup.near_dedup(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == components(texts) and [got[i][0] for i in range(4)] == [0, 0, 2, 3]


def test_repeated_ids(spark):
    """An id with two texts: each is searched for itself."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a.replace("a30", "x")), (3, b.replace("b30", "x")), (4, c), (4, c), (5, a.replace("a10", "y"))]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 1)]


def test_pairs_grow_with_rows(spark, monkeypatch):
    confirm, counts = near_dedup._confirm, []

    def counted(pairs, *rest):
        counts[-1] += pairs.count()
        return confirm(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_confirm", counted)
    for n in (500, 1000):
        counts.append(0)
        assert near_dedup.near_dedup(spark.createDataFrame(family(n), "doc_id long, text string")).count() == n
    assert counts[1] <= 2.4 * counts[0], counts

"""Importance resampling: against plain counting, and defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from convan.llm import queries, resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, sizes):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), [b" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)]


def brute(docs, target, sizes=(1,), percent=10, least=20):
    bucket = lambda x: zlib.crc32(x) % 10_000
    s, t = (Counter(bucket(g) for _, text in rows for g in grams(text, sizes)[1]) for rows in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out, long_enough = [], []
    for k, (doc, text) in enumerate(docs):
        n, own = grams(text, sizes)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in map(bucket, own)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            long_enough.append(k)
    for rank, k in enumerate(sorted(long_enough, key=lambda k: (-out[k][3], out[k][0] is None, out[k][0], out[k][2], out[k][1]))[: percent * len(long_enough) // 100], 1):
        out[k][4] = rank
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("sizes", [range(1, 2), range(1, 4), range(2, 3)])
def test_equals_plain_counting(spark, sizes):
    import duckdb

    docs, target = (duckdb.sql(f"SELECT {i}, text FROM '/root/testdata/sf0.001/{t}.parquet'").fetchall() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "item_id long, text string"), sizes=sizes)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(docs, target, sizes)


@pytest.mark.parametrize("name", ["op13_resample"])
def test_matches_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.select(", ".join(got.columns)).fetchall())) and set(dict(got.dtypes).values()) == {"bigint"}


def test_defined_cases(spark):
    """Null, empty and very long texts, null and repeated ids, ties, letters beyond ASCII, clashing columns, an empty table and target."""
    rows = [(1, None), (2, ""), (3, "ÄB c'D_e  ÉF1\n2"), (4, "w " * 50_000), (4, "w " * 50_000), (None, "x y z " * 10), (5, "x" * 300_000), *((i, "some words " * 12) for i in range(6, 30))]
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, rank int, features string").repartition(3)
    target = [(1, "x y z w"), (2, None)]
    for goal in (target, []):
        got = resampling.resample(docs, spark.createDataFrame(goal, "item_id long, text string"))
        assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows, goal)
    assert resampling.resample(docs.limit(0), docs).count() == 0


def test_spans_overlap():
    form = resampling.one_form("It's  a-B\tc".encode())
    assert form == b"it s a b c" and [form[a:b] for a, b in resampling.spans(form, 3)] == [b"it s a", b"s a b", b"a b c"] and list(resampling.spans(b"", 1)) == []

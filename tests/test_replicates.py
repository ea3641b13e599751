"""Bootstrap and sign-flip statistics against plain numpy over items, and defined cases."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from convan.functions.tails import binomial_tail
from convan.operators import replicates as R


def base(keys, seed):
    return np.array([int(hashlib.md5(f"{k}:{seed}".encode()).hexdigest()[:8], 16) for k in keys], np.uint32)


def test_bits_equal_duckdb_and_are_uniform():
    got = R.draws(base(range(40), 5), 50)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT range AS k FROM range(40)")
    want = con.sql(f"WITH {R.sql_draws('t', 'k', 5, 50)} SELECT h, w FROM w5 ORDER BY k, rep").fetchall()
    assert got.ravel().tolist() == [h for h, _ in want] and R.weights(got).ravel().tolist() == [w for _, w in want]
    many = R.draws(base(range(2000), 1), 500)
    w = R.weights(many)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01 and abs(R.signs(many).mean()) < 0.01
    assert np.abs(np.corrcoef(w[:60].astype(float)) - np.eye(60)).max() < 0.25  # items are drawn apart from each other


def test_binomial_tail():
    from math import comb

    for n in (0, 1, 2, 7, 40, 301):
        for k in range(n // 2 + 1):
            assert abs(binomial_tail(k, n) - (min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0)) < 1e-9
    assert abs(binomial_tail(10**8 // 2 - 9800, 10**8) - 0.05) < 1e-3  # 1.96 standard deviations of 5,000


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), bool(x), bool(y), bool(h), bool(p), bool(q)) for i, (x, y, h, p, q) in enumerate(rng.random((300, 5)) < (0.6, 0.72, 0.3, 0.4, 0.4))]
    return rows, spark.createDataFrame(rows, "k long, x boolean, y boolean, h boolean, p boolean, q boolean").repartition(3)


def test_paired_difference(judged, spark):
    """Interval, p and verdict on either measure; b isn't better where it misses more."""
    rows, df = judged
    measures = {"right": (F.col("x"), F.col("y")), "route": (F.col("p") == F.col("h"), F.col("q") == F.col("h"))}
    got = {r.measure: r for r in R.paired_difference(df, "k", measures, F.col("h"), (F.col("p"), F.col("q")), reps=400).collect()}
    k, x, y, h, p, q = map(np.array, zip(*rows, strict=True))
    w = R.weights(R.draws(base(k, 17), 400)).astype(float)
    for name, d in (("right", y.astype(int) - x), ("route", (q == h).astype(int) - (p == h))):
        r, low_high = got[name], np.percentile((w * d[:, None]).sum(0) / w.sum(0), [2.5, 97.5])
        assert np.allclose([r.difference, r.low, r.high], [d.mean(), *low_high], atol=1e-6) and (r.fixes, r.breaks) == ((d > 0).sum(), (d < 0).sum())
        assert abs(r.p - binomial_tail(int(min(r.fixes, r.breaks)), int(r.fixes + r.breaks))) < 1e-6 and (r.missed_a, r.missed_b) == ((h & ~p).sum(), (h & ~q).sum())
    assert got["right"].low > 0
    verdict = lambda b: R.paired_difference(df, "k", {"right": measures["right"]}, F.col("h"), (F.lit(True), b), reps=200).first().verdict
    assert verdict(F.lit(True)) == "better" and verdict(F.lit(False)) == "inconclusive"
    swapped = {"right": measures["right"][::-1]}
    assert R.paired_difference(df, "k", swapped, F.col("h"), (F.lit(True), F.lit(True)), reps=200).first().verdict == "not better"
    none = R.paired_difference(df.limit(0), "k", measures, F.col("h"), (F.col("p"), F.col("q")), reps=20).collect()
    assert [(r.measure, r.n, r.difference, r.low, r.p, r.verdict) for r in none] == [(m, 0, None, None, 1.0, "inconclusive") for m in ("right", "route")]


def test_nulls_are_wrong_and_do_not_escalate(spark):
    df = spark.createDataFrame([(1, None, True, True, None), (2, True, None, None, True), (None, True, True, True, True)], "k long, x boolean, y boolean, h boolean, e boolean")
    r = R.paired_difference(df, "k", {"m": (F.col("x"), F.col("y"))}, F.col("h"), (F.col("e"), F.lit(True)), reps=50).first()
    assert (r.n, r.fixes, r.breaks, r.missed_a, r.missed_b) == (3, 1, 1, 1, 0)


def test_paired_deltas(spark):
    """Means by item first, items of both sides alone, every metric; intervals and sign flips as over a matrix of items and draws."""
    rng = np.random.default_rng(1)
    rows = [(int(i), c, float(v), float(z)) for i in range(80) for c in ("a", "b") for v, z in rng.integers(1, 6, (rng.integers(0 if i % 9 == 0 else 1, 4), 2)) + (0.4 * (c == "b"), 0)]
    df = spark.createDataFrame(rows, "item long, side string, m double, z double").repartition(2)
    got = {r.metric: r for r in R.paired_deltas(df, "item", F.col("side") == "a", F.col("side") == "b", ["m", "z"], reps=500).collect()}
    for name, at in (("m", 2), ("z", 3)):
        mean = {(i, c): np.mean([r[at] for r in rows if r[:2] == (i, c)]) for i, c in {r[:2] for r in rows}}
        items = [i for i in range(80) if (i, "a") in mean and (i, "b") in mean]
        d = np.array([mean[i, "b"] - mean[i, "a"] for i in items])
        w, s = R.weights(R.draws(base(items, 19), 500)).astype(float), R.signs(R.draws(base(items, 20), 500))
        r, sd = got[name], d.std(ddof=1)
        assert r.n == len(items) and np.allclose([r.difference, r.low, r.high], [d.mean(), *np.percentile((w * d[:, None]).sum(0) / w.sum(0), [2.5, 97.5])], atol=1e-6)
        assert abs(r.p - (np.abs((s * d[:, None]).sum(0)) >= abs(d.sum()) - 1e-9).mean()) < 1e-6 and r.star == (r.low > 0 or r.high < 0)
        assert [r.need_1, r.need_2, r.need_3, r.need_5] == [np.ceil((2.8 * sd / e) ** 2) for e in (0.1, 0.2, 0.3, 0.5)]
    none = R.paired_deltas(df.limit(0), "item", F.col("side") == "a", F.col("side") == "b", ["m"], reps=10).first()
    assert (none.metric, none.n, none.difference, none.low, none.p) == ("m", 0, None, None, None)


@pytest.mark.parametrize("values, parts", [(5, 4), (1, 3), (1000, 4), (40, 1)])
def test_auroc_interval(spark, values, parts):
    """Scores that a few, all or no rows share, over several ranges, against ranks in every draw."""
    rng = np.random.default_rng(values)
    rows = [(int(i), bool(y), float(rng.integers(0, values) + 0.5 * y)) for i, y in enumerate(rng.random(400) < 0.3)] + [(1000 + i, bool(i % 2), 2.0) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    r = R.auroc_interval(spark.createDataFrame([*rows, (7000, None, 1.0), (7001, True, None)], "k long, y boolean, s double"), "k", "y", "s", reps=60).first()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    k, y, s = map(np.array, zip(*rows, strict=True))
    w = R.weights(R.draws(base(k, 23), 60)).astype(float)
    above = (s[y][:, None] > s[~y][None]) + 0.5 * (s[y][:, None] == s[~y][None])
    areas = np.einsum("pr,pq,qr->r", w[y], above, w[~y]) / (w[y].sum(0) * w[~y].sum(0))
    assert np.allclose([r.auroc, r.low, r.high], [above.mean(), *np.percentile(areas, [2.5, 97.5])], atol=1e-6) and (r.positives, r.negatives) == (y.sum(), (~y).sum())


def test_auroc_of_one_class_or_none(spark):
    for rows in ([], [(1, True, 0.5), (2, True, 0.7)]):
        r = R.auroc_interval(spark.createDataFrame(rows, "k long, y boolean, s double"), "k", "y", "s", reps=20).first()
        assert (r.auroc, r.low, r.high) == (None, None, None)


def test_noise_floor_draws_once(spark, monkeypatch):
    """As paired_deltas of each pair by itself, with items that a pair lacks, in one pass of draws."""
    rows = [(i, s, float((i * 7 + j) % 5)) for i in range(40) for j, s in enumerate("abc") if (i + j) % 6] + [(None, "a", 1.0), (50, "a", None)]
    df = spark.createDataFrame(rows, "item long, side string, m double")
    sides = {"x": (F.col("side") == "a", F.col("side") == "b"), "y": (F.col("side") == "a", F.col("side") == "c"), "none": (F.col("side") == "a", F.col("side") == "z")}
    want = [(n, *r) for n, (a, b) in sides.items() for r in R.paired_deltas(df, "item", a, b, ["m"], 200).select("metric", "n", "difference", "low", "high", "star").collect()]
    calls, sums = [], R.replicate_sums
    monkeypatch.setattr(R, "replicate_sums", lambda *a, **k: calls.append(1) or sums(*a, **k))
    got = R.noise_floor(df, "item", sides, ["m"], 200)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(calls) == 1

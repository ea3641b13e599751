"""Bootstrap intervals and sign-flip tests over items, by replicate vectors.

Every item has, for each of `reps` draws, 32 bits of its own: its seeded hash moved on by the draw's number and mixed. From them
comes its weight in that draw (Poisson with mean 1, for the bootstrap) or its sign. A task adds up weight times value for all
draws of its items as one matrix product, so what leaves it is a vector of `reps` numbers a value; Spark adds these vectors up by draw.
No item is grouped with others, nothing is exploded, and the work is items x draws over all tasks."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convan.functions.scratch import saved
from convan.functions.tails import mcnemar_p
from convan.operators.judging import _EV, _evals
from convan.operators.review import auroc
from convan.plans import bindings as B

REPS = 10_000
LEAST_GAIN = 0.03  # a difference that would matter
STEP, MIX = 2654435769, (2246822507, 3266489909)  # of the golden ratio, and of a 32-bit finaliser
CHUNK = 64  # items whose draws are held at once


def poisson_bounds() -> list[int]:
    """The 32-bit numbers from which on a Poisson variable with mean 1 is more than 0, 1, 2, ...; the last is as far as 32 bits tell."""
    below, term, out = Fraction(0), Fraction(math.exp(-1)), []
    while True:
        below += term / math.factorial(len(out))
        bound = math.ceil(below * 2**32)
        if bound >= 2**32:
            return out
        out.append(bound)


POISSON = poisson_bounds()


def draws(base: np.ndarray, reps: int) -> np.ndarray:
    """32 bits for each item (its 32-bit hash) and each draw 1 to reps."""
    x = base.astype(np.uint32)[:, None] + (np.arange(1, reps + 1, dtype=np.uint64) * STEP).astype(np.uint32)[None, :]
    for shift, factor in ((16, MIX[0]), (13, MIX[1]), (16, None)):
        x ^= x >> np.uint32(shift)
        if factor:
            x *= np.uint32(factor)
    return x


def weights(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(bits.shape, np.uint8)
    for bound in POISSON:
        out += bits >= np.uint32(bound)
    return out


def signs(bits: np.ndarray) -> np.ndarray:
    return 1.0 - 2.0 * (bits >> np.uint32(31))


def replicate_sums(df: DataFrame, key: str, values: list[str], reps: int, seed: int, by=weights) -> DataFrame:
    """rep, n and values: for each draw the sums of the items' weights, and of weights times values; null values count as 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((reps, 1 + len(values)))
        for batch in batches:
            base, v = batch["_base"].to_numpy(np.uint32), np.column_stack([np.ones(len(batch)), *(batch[c].fillna(0) for c in values)])
            for at in range(0, len(batch), CHUNK):
                total += by(draws(base[at : at + CHUNK], reps)).astype(np.float64).T @ v[at : at + CHUNK]
        yield pd.DataFrame(total, columns=["n", *values]).assign(rep=np.arange(1, reps + 1))

    source = df.select(B.uniform(key, seed).alias("_base"), *(F.col(c).cast("double").alias(c) for c in values)).where("_base is not null")
    sums = source.mapInPandas(run, ", ".join(f"{c} double" for c in ["n", *values]) + ", rep int")
    return sums.groupBy("rep").agg(*(F.sum(c).alias(c) for c in ["n", *values]))


def ends(sums: DataFrame, names: list[str]) -> DataFrame:
    """One row: low_ and high_ of each name, the 2.5 and 97.5 percentiles of its weighted means over draws; draws without weight don't count."""
    return sums.agg(*(F.round(F.percentile(F.col(c) / F.nullif(F.col("n"), F.lit(0.0)), p), 6).alias(f"{side}_{c}") for c in names for side, p in (("low", 0.025), ("high", 0.975))))


def paired_difference(df: DataFrame, key: str, measures: dict[str, tuple[Column, Column]], truth: Column, escalated: tuple[Column, Column], reps: int = REPS, seed: int = 17) -> DataFrame:
    """For each measure (whether version a and version b are right) the share of b less that of a, with bootstrap interval over
    items, fixes, breaks and exact McNemar p; escalations that each version misses; and the verdict.

    Better: the interval is above 0 and b misses no more than a. Not better: it rules out a gain of LEAST_GAIN. A null counts
    as wrong, or as not escalated. Rows with a null key have no part in the intervals. Without rows there is a row for each measure, with nulls."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    d = {m: yes(y).cast("int") - yes(x).cast("int") for m, (x, y) in measures.items()}
    rows = df.select(F.col(key), *(c.alias(f"d_{m}") for m, c in d.items()), *((yes(truth) & ~yes(e)).cast("int").alias(f"miss_{v}") for v, e in zip("ab", escalated, strict=True)))
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("miss_a"), F.lit(0)).alias("missed_a"), F.coalesce(F.sum("miss_b"), F.lit(0)).alias("missed_b"), *(f(F.col(f"d_{m}")).alias(f"{name}_{m}") for m in measures for name, f in (("fixes", lambda c: F.count_if(c > 0)), ("breaks", lambda c: F.count_if(c < 0)))))
    both = facts.crossJoin(F.broadcast(ends(replicate_sums(rows, key, [f"d_{m}" for m in measures], reps, seed), [f"d_{m}" for m in measures])))  # one row each
    long = both.select("n", "missed_a", "missed_b", F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"fixes_{m}").alias("fixes"), F.col(f"breaks_{m}").alias("breaks"), F.col(f"low_d_{m}").alias("low"), F.col(f"high_d_{m}").alias("high")) for m in measures))))
    verdict = F.when((F.col("low") > 0) & (F.col("missed_b") <= F.col("missed_a")), "better").when(F.col("high") < LEAST_GAIN, "not better").otherwise("inconclusive")
    return long.select("measure", "n", F.round((F.col("fixes") - F.col("breaks")) / F.nullif(F.col("n"), F.lit(0)), 6).alias("difference"), "low", "high", "fixes", "breaks", F.round(mcnemar_p("fixes", "breaks"), 6).alias("p"), "missed_a", "missed_b", verdict.alias("verdict"))


def paired_deltas(df: DataFrame, item: str, a: Column, b: Column, metrics: list[str], reps: int = REPS, seed: int = 19) -> DataFrame:
    """For each metric the mean over items of side b less side a, the rows of a side averaged by item first, with bootstrap
    interval, p of a sign-flip test, a star if 0 is outside, and items needed to show 0.1, 0.2, 0.3 or 0.5 at 80 % power.

    Items count if both sides have all metrics. Without such items there are rows with nulls."""
    side = lambda c, m: F.avg(F.when(c, F.col(m).cast("double")))
    d = df.where(a | b).groupBy(item).agg(*((side(b, m) - side(a, m)).alias(m) for m in metrics)).dropna()
    facts = d.agg(F.count("*").alias("n"), *(f(m).alias(f"{name}_{m}") for m in metrics for name, f in (("sum", F.sum), ("sd", F.stddev_samp))))
    interval = ends(replicate_sums(d, item, metrics, reps, seed), metrics)
    flips = replicate_sums(d, item, metrics, reps, seed + 1, signs).crossJoin(F.broadcast(facts))  # one row
    p = flips.agg(*(F.round(F.avg((F.abs(F.col(m)) >= F.abs(F.col(f"sum_{m}")) - 1e-9).cast("double")), 6).alias(f"p_{m}") for m in metrics))
    both = facts.crossJoin(F.broadcast(interval)).crossJoin(F.broadcast(p))  # one row each
    long = both.select("n", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"sum_{m}").alias("sum"), F.col(f"sd_{m}").alias("sd"), F.col(f"low_{m}").alias("low"), F.col(f"high_{m}").alias("high"), F.col(f"p_{m}").alias("p")) for m in metrics))))
    need = [F.ceil(F.round((2.8 * F.col("sd") / e) ** 2, 6)).alias(f"need_{int(e * 10)}") for e in (0.1, 0.2, 0.3, 0.5)]
    return long.select("metric", "n", F.round(F.col("sum") / F.nullif(F.col("n"), F.lit(0)), 6).alias("difference"), "low", "high", "p", ((F.col("low") > 0) | (F.col("high") < 0)).alias("star"), *need)


def noise_floor(df: DataFrame, item: str, sides: dict[str, tuple[Column, Column]], metrics: list[str], reps: int = REPS, seed: int = 19) -> DataFrame:
    """What paired_deltas says of several pairs of sides, beside each other: a change to be judged, and runs that differ by chance alone.

    Items' differences of all pairs are taken and written once, and all intervals come from one pass of draws; an item that a
    pair lacks has no weight in that pair's means."""
    side = lambda c, m: F.avg(F.when(c, F.col(m).cast("double")))
    names = [f"p{i}" for i in range(len(sides))]
    d = df.where(F.col(item).isNotNull()).groupBy(item).agg(*((side(b, m) - side(a, m)).alias(f"{p}_{m}") for p, (a, b) in zip(names, sides.values(), strict=True) for m in metrics))
    has = {p: functools.reduce(Column.__and__, (F.col(f"{p}_{m}").isNotNull() for m in metrics)) for p in names}
    held = saved(d.select(item, *(has[p].cast("int").alias(p) for p in names), *(F.when(has[p], F.col(f"{p}_{m}")).alias(f"{p}_{m}") for p in names for m in metrics)), "deltas")
    facts = held.agg(*(F.coalesce(F.sum(p), F.lit(0)).alias(f"n_{p}") for p in names), *(F.sum(f"{p}_{m}").alias(f"sum_{p}_{m}") for p in names for m in metrics))
    dealt = held.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, item)  # few bytes an item, but many draws
    sums = replicate_sums(dealt, item, [*names, *(f"{p}_{m}" for p in names for m in metrics)], reps, seed)
    mean = lambda p, m: F.col(f"{p}_{m}") / F.nullif(F.col(p), F.lit(0.0))
    interval = sums.agg(*(F.round(F.percentile(mean(p, m), x), 6).alias(f"{end}_{p}_{m}") for p in names for m in metrics for end, x in (("low", 0.025), ("high", 0.975))))
    rows = F.array(*(F.struct(F.lit(name).alias("pair"), F.lit(m).alias("metric"), F.col(f"n_{p}").alias("n"), F.col(f"sum_{p}_{m}").alias("sum"), F.col(f"low_{p}_{m}").alias("low"), F.col(f"high_{p}_{m}").alias("high")) for p, name in zip(names, sides, strict=True) for m in metrics))
    long = facts.crossJoin(F.broadcast(interval)).select(F.inline(rows))  # one row each
    return long.select("pair", "metric", "n", F.round(F.col("sum") / F.nullif(F.col("n"), F.lit(0)), 6).alias("difference"), "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("star"))


def auroc_interval(df: DataFrame, key: str, truth: str, score: str, reps: int = 2_000, seed: int = 23) -> DataFrame:
    """Area under the ROC curve (ties count half) with its bootstrap interval over items; nulls with one class.

    Rows are dealt by ranges of the score. A range gives, per draw, weights of both classes and its own rank sum; ranges are
    put together in their order, with the weights of the negatives below. A range's first and last score may be its
    neighbours' too: these are kept apart and added up by score, so a score that many rows share is split over many tasks.
    Rows with a null truth, score or key don't count; draws with one class neither."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"_base": [], "y": [], "s": []}), *batches])
        if held.empty:
            return
        held = held.sort_values("s")
        s, y, base = held["s"].to_numpy(), held["y"].to_numpy(bool), held["_base"].to_numpy(np.uint32)
        edge = (s == s[0]) | (s == s[-1])
        for low, tie, rows in [(x, True, np.flatnonzero(s == x)) for x in {s[0], s[-1]}] + ([(s[~edge][0], False, np.flatnonzero(~edge))] if not edge.all() else []):
            p, q, u = np.zeros(reps), np.zeros(reps), np.zeros(reps)
            for at in range(0, len(rows), CHUNK):
                part = rows[at : at + CHUNK]
                w = weights(draws(base[part], reps)).astype(np.float64)
                if tie:
                    p, q = p + w[y[part]].sum(0), q + w[~y[part]].sum(0)
                    continue
                first = np.flatnonzero(np.diff(s[part], prepend=np.nan) != 0)
                wp, wq = (np.add.reduceat(w * side[:, None], first, axis=0) for side in (y[part], ~y[part]))
                if at and s[part[0]] == s[rows[at - 1]]:  # goes on with the score of the chunk before: its halves across the chunks
                    u += (wp[0] * last[1] + wq[0] * last[0]) / 2 - wp[0] * last[1]
                    now = (last[0] + wp[0], last[1] + wq[0])
                else:
                    now = (wp[0], wq[0])
                below = q + np.cumsum(wq, axis=0) - wq
                u += (wp * (below + wq / 2)).sum(0)
                p, q = p + wp.sum(0), q + wq.sum(0)
                last = now if len(first) == 1 else (wp[-1], wq[-1])
            yield pd.DataFrame({"low": low, "tie": tie, "rep": np.arange(1, reps + 1), "p": p, "q": q, "u": u})

    rows = df.select(B.uniform(key, seed).alias("_base"), F.col(truth).cast("boolean").alias("y"), F.col(score).cast("double").alias("s")).dropna()
    parts = rows.repartitionByRange(F.col("s"), F.col("_base")).mapInPandas(run, "low double, tie boolean, rep int, p double, q double, u double")
    pieces = parts.groupBy("rep", "low", "tie").agg(*(F.sum(c).alias(c) for c in "pqu")).withColumn("u", F.when(F.col("tie"), F.col("p") * F.col("q") / 2).otherwise(F.col("u")))
    before = F.sum("q").over(Window.partitionBy("rep").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("q")
    per = pieces.withColumn("u", F.col("u") + F.col("p") * before).groupBy("rep").agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("area"))
    interval = per.agg(*(F.round(F.percentile("area", x), 6).alias(n) for n, x in (("low", 0.025), ("high", 0.975))))
    point = auroc(df.where(F.col(key).isNotNull()), truth, score)
    one = F.col("auroc").isNull()
    return point.crossJoin(F.broadcast(interval)).select("positives", "negatives", "auroc", *(F.when(~one, F.col(c)).alias(c) for c in ("low", "high")))  # one row each


def _routed(s, d):
    """Versions a and b of the labels, each escalated by its own rule, and the truth."""
    p, g = B.preds(s, d), B.gold(s, d).select(F.col("doc_id").alias("item"), (F.col("toxic") == 1).alias("human"), "n_chars")
    return p.join(g.hint("merge"), "item").withColumn("esc_a", (F.col("a") == "de") | (F.col("n_chars") > 4000)).withColumn("esc_b", (F.col("b") == "de") | (F.col("n_chars") > 2500))


def _difference(s, d):
    right = {"correctness": (F.col("a") == F.col("gold"), F.col("b") == F.col("gold")), "routing": (F.col("esc_a") == F.col("human"), F.col("esc_b") == F.col("human"))}
    return paired_difference(_routed(s, d), "item", right, F.col("human"), (F.col("esc_a"), F.col("esc_b")))


def _is(**values):
    return functools.reduce(Column.__and__, (F.col(k) == v for k, v in values.items()))


METRICS = ["overall", "deflects"]
QUERIES = {
    "paired_difference": _difference,
    "paired_metrics": lambda s, d: paired_deltas(_evals(s, d), "item", _is(config="m:one"), _is(config="h:two"), METRICS),
    "noise_floor": lambda s, d: noise_floor(_evals(s, d), "item", {"configs": (_is(config="m:one"), _is(config="h:two")), "runs": (_is(config="m:one", judge="m/x"), _is(config="m:one", judge="h/y"))}, METRICS),
    "auroc_interval": lambda s, d: auroc_interval(B.route_in(s, d), "item", "escalate", "confidence"),
}


def sql_bits(base: str, rep: str) -> str:
    """draws() in DuckDB; base and rep are unsigned numbers."""
    x = f"(({base})::UBIGINT + {rep}::UBIGINT * {STEP}) & 4294967295"
    for shift, factor in ((16, MIX[0]), (13, MIX[1])):
        x = f"(xor({x}, ({x}) >> {shift}) * {factor}) & 4294967295"
    return x


def sql_draws(source: str, key: str, seed: int, reps: int) -> str:
    """CTEs x: source and its 32 bits for each draw, mixed step by step; w: with the Poisson weight."""
    names, last = [], f"x{seed}_0"
    out = f"{last} AS (SELECT s.*, rep, (({B.sql_uniform(key, seed)})::UBIGINT + rep::UBIGINT * {STEP}) & 4294967295 AS h FROM {source} s, range(1, {reps + 1}) t(rep))"
    for k, (shift, factor) in enumerate(((16, MIX[0]), (13, MIX[1]), (16, 1)), 1):
        names.append(f"x{seed}_{k}")
        out += f", {names[-1]} AS (SELECT * REPLACE ((xor(h, h >> {shift}) * {factor}) & 4294967295 AS h) FROM {last})"
        last = names[-1]
    return f"{out}, w{seed} AS (SELECT *, {' + '.join(f'(h >= {p})::INT' for p in POISSON)} AS w FROM {last})"


def _sql_deltas(tag: str, a: str, b: str, reps: int = REPS, seed: int = 19) -> str:
    """CTE {tag}: paired_deltas of METRICS in DuckDB."""
    d = ", ".join(f"avg({m}::DOUBLE) FILTER ({b}) - avg({m}::DOUBLE) FILTER ({a}) AS {m}" for m in METRICS)
    own = lambda sql: sql.replace(f"x{seed}_", f"{tag}x").replace(f"w{seed}", f"{tag}w").replace(f"x{seed + 1}_", f"{tag}y").replace(f"w{seed + 1}", f"{tag}v")
    one = lambda m: f"""SELECT '{m}' AS metric, n, round(sum_{m} / nullif(n, 0), 6) AS difference, low, high, p, low > 0 OR high < 0 AS star, {", ".join(f"CAST(ceil(round(pow(2.8 * sd_{m} / {e}, 2), 6)) AS BIGINT) AS need_{int(e * 10)}" for e in (0.1, 0.2, 0.3, 0.5))}
        FROM {tag}f, (SELECT round(quantile_cont({m} / nullif(n, 0), 0.025), 6) AS low, round(quantile_cont({m} / nullif(n, 0), 0.975), 6) AS high FROM {tag}r), (SELECT round(avg((abs({m}) >= abs(sum_{m}) - 1e-9)::INT), 6) AS p FROM {tag}s, {tag}f)"""  # noqa: E731
    sums = lambda w: ", ".join(f"sum({w} * {m}) AS {m}" for m in METRICS)
    return f"""{tag}d AS (SELECT * FROM (SELECT item, {d} FROM evals WHERE ({a}) OR ({b}) GROUP BY item) WHERE {" AND ".join(f"{m} IS NOT NULL" for m in METRICS)}),
        {own(sql_draws(f"{tag}d", "item", seed, reps))}, {own(sql_draws(f"{tag}d", "item", seed + 1, reps))},
        {tag}f AS (SELECT count(*) AS n, {", ".join(f"sum({m}) AS sum_{m}, stddev_samp({m}) AS sd_{m}" for m in METRICS)} FROM {tag}d),
        {tag}r AS (SELECT rep, sum(w)::DOUBLE AS n, {sums("w")} FROM {tag}w GROUP BY rep), {tag}s AS (SELECT rep, {sums("(1 - 2 * (h >> 31)::INT)")} FROM {tag}y3 GROUP BY rep),
        {tag} AS ({" UNION ALL ".join(map(one, METRICS))})"""


_RIGHT = {"correctness": ("a = gold", "b = gold"), "routing": ("esc_a = human", "esc_b = human")}
_d = ", ".join(f"coalesce(({y})::INT, 0) - coalesce(({x})::INT, 0) AS d_{m}" for m, (x, y) in _RIGHT.items())
_tail = "CASE WHEN fixes + breaks = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(fixes + breaks + 1) - lgamma(i + 1) - lgamma(fixes + breaks - i + 1) - (fixes + breaks) * ln(2.0))) FROM range(0, 100000) g(i) WHERE i <= least(fixes, breaks))) END"
ORACLE_SQL = {
    "paired_difference": f"""WITH {B.SQL_PREDS}, {B.SQL_GOLD}, routed AS (SELECT p.*, g.toxic = 1 AS human, p.a = 'de' OR g.n_chars > 4000 AS esc_a, p.b = 'de' OR g.n_chars > 2500 AS esc_b FROM preds p JOIN gold g ON g.doc_id = p.item),
        v AS (SELECT item, human AND NOT esc_a AS miss_a, human AND NOT esc_b AS miss_b, {_d} FROM routed), {sql_draws("v", "item", 17, REPS)},
        r AS (SELECT rep, sum(w)::DOUBLE AS n, {", ".join(f"sum(w * d_{m}) AS d_{m}" for m in _RIGHT)} FROM w17 GROUP BY rep), f AS (SELECT count(*) AS n, count(*) FILTER (miss_a) AS missed_a, count(*) FILTER (miss_b) AS missed_b FROM v),
        m AS ({" UNION ALL ".join(f"SELECT '{m}' AS measure, (SELECT count(*) FILTER (d_{m} > 0) FROM v) AS fixes, (SELECT count(*) FILTER (d_{m} < 0) FROM v) AS breaks, round(quantile_cont(d_{m} / nullif(n, 0), 0.025), 6) AS low, round(quantile_cont(d_{m} / nullif(n, 0), 0.975), 6) AS high FROM r" for m in _RIGHT)})
        SELECT measure, n, round((fixes - breaks) / nullif(n, 0)::DOUBLE, 6) AS difference, low, high, fixes, breaks, round({_tail}, 6) AS p, missed_a, missed_b, CASE WHEN low > 0 AND missed_b <= missed_a THEN 'better' WHEN high < {LEAST_GAIN} THEN 'not better' ELSE 'inconclusive' END AS verdict FROM m, f""",
    "paired_metrics": f"WITH {_EV}, {_sql_deltas('t', 'config = ' + chr(39) + 'm:one' + chr(39), 'config = ' + chr(39) + 'h:two' + chr(39))} SELECT * FROM t",
    "noise_floor": f"""WITH {_EV}, {_sql_deltas("t", "config = 'm:one'", "config = 'h:two'")}, {_sql_deltas("z", "config = 'm:one' AND judge = 'm/x'", "config = 'm:one' AND judge = 'h/y'")}
        SELECT 'configs' AS pair, metric, n, difference, low, high, star FROM t UNION ALL SELECT 'runs', metric, n, difference, low, high, star FROM z""",
    "auroc_interval": f"""WITH {B.SQL_ROUTE}, v AS (SELECT item, escalate AS y, confidence AS s FROM route_in), {sql_draws("v", "item", 23, 2_000)},
        c AS (SELECT rep, s, sum(w) FILTER (y) AS p, sum(w) FILTER (NOT y) AS q FROM w23 GROUP BY rep, s), k AS (SELECT rep, coalesce(p, 0) AS p, coalesce(q, 0) AS q, sum(coalesce(q, 0)) OVER (PARTITION BY rep ORDER BY s) - coalesce(q, 0) AS below FROM c),
        a AS (SELECT rep, sum(p * (below + q / 2.0))::DOUBLE / nullif(sum(p) * sum(q), 0)::DOUBLE AS area FROM k GROUP BY rep), e AS (SELECT round(quantile_cont(area, 0.025), 6) AS low, round(quantile_cont(area, 0.975), 6) AS high FROM a),
        f AS (SELECT s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k, y FROM v), t AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q, sum(k) FILTER (y) AS u FROM f)
        SELECT p AS positives, q AS negatives, round((u - p * (p + 1) / 2.0) / nullif(p * q, 0), 6) AS auroc, CASE WHEN p * q > 0 THEN low END AS low, CASE WHEN p * q > 0 THEN high END AS high FROM t, e""",
}

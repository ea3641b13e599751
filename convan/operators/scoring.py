"""Incremental scoring with any scorer, baselines side by side, and chunks of an order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convan.functions.scratch import ranked
from convan.plans import bindings as B

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_incremental(df: DataFrame, log: DataFrame, key: str, namespace: str, scorer: Scorer, result: str) -> DataFrame:
    """Results of all rows under a namespace: those in the log, and the scorer's for the rest only.

    The scorer takes batches of df's columns and gives key and label; rows that it leaves out stay without a result, and
    the next run tries them again. Rows with a null key are not scored."""
    cached = log.where(F.col("namespace") == namespace).select(key, "label", F.lit(True).alias("cached"))
    rest = df.where(F.col(key).isNotNull()).join(cached.select(key).distinct().hint("merge"), key, "left_anti")
    fresh = rest.mapInPandas(scorer, result).withColumn("cached", F.lit(False))
    return cached.join(df.select(key).distinct().hint("merge"), key, "left_semi").unionByName(fresh)


def baseline_table(df: DataFrame, gold: str, approaches: dict[str, str], simple: str | None = None) -> DataFrame:
    """Accuracy of each approach and of always saying the commonest class; what each gains over the latter, and over the simple approach, in points.

    One pass counts (gold, said) cells; the rest works on as many rows as there are approaches. Without a simple approach its lift is null."""
    long = df.select(F.col(gold).alias("g"), F.explode(F.array(*(F.struct(F.lit(n).alias("approach"), F.col(c).alias("said")) for n, c in approaches.items()))).alias("x"))
    hits = long.groupBy("x.approach").agg(F.count("*").alias("n"), F.count_if(F.col("x.said") == F.col("g")).alias("right"))
    top = df.groupBy(F.col(gold).alias("g")).agg(F.count("*").alias("k")).agg(F.sum("k").alias("n"), F.max(F.when(F.col("g").isNotNull(), F.col("k"))).alias("right"))
    share = F.col("right") / F.nullif(F.col("n"), F.lit(0))
    rows = hits.unionByName(top.withColumn("approach", F.lit("majority"))).withColumn("_x", share)
    ends = rows.agg(F.max(F.when(F.col("approach") == "majority", F.col("_x"))).alias("_t"), F.max(F.when(F.col("approach") == F.lit(simple), F.col("_x"))).alias("_s"))  # one row
    lift = lambda c: F.round(100 * (F.col("_x") - F.col(c)), 4)
    return rows.crossJoin(F.broadcast(ends)).select("approach", "n", F.round("_x", 6).alias("accuracy"), lift("_t").alias("lift"), lift("_s").alias("lift_over_simple"))


def chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """The number of the chunk, from 0, that each row falls into by its key's order; keys are unique."""
    return ranked(df.select(key), [F.col(key)]).select(key, F.floor((F.col("rank") - 1) / size).alias("chunk"))


def _rule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A scorer by rule: the gold label in upper case; it fails on Spanish."""
    for b in batches:
        b = b[b["gold"] != "es"]
        yield pd.DataFrame({"item": b["item"], "label": b["gold"].str.upper()})


def _scored(s, d):
    p = B.preds(s, d)
    log = p.where("a = gold").select(F.when(F.col("b") == "en", "v1").otherwise("v2").alias("namespace"), "item", F.col("a").alias("label"))
    return score_incremental(p.select("item", "gold"), log, "item", "v1", _rule, "item long, label string")


QUERIES = {
    "score_incremental": _scored,
    "baseline_table": lambda s, d: baseline_table(B.preds(s, d), "gold", {"simple": "b", "full": "a"}, "simple"),
    "chunks": lambda s, d: chunks(B.table(s, d, "documents"), "doc_id", 64),
}
ORACLE_SQL = {
    "score_incremental": f"WITH {B.SQL_PREDS} SELECT item, CASE WHEN a = gold AND b = 'en' THEN a ELSE upper(gold) END AS label, a = gold AND b = 'en' AS cached FROM preds WHERE (a = gold AND b = 'en') OR gold <> 'es'",
    "baseline_table": f"WITH {B.SQL_PREDS}, n AS (SELECT count(*) AS n, avg((a = gold)::INT) AS a, avg((b = gold)::INT) AS b FROM preds), m AS (SELECT max(k) AS k FROM (SELECT count(*) AS k FROM preds GROUP BY gold)), r AS (SELECT 'full' AS approach, n, a AS x, k / n::DOUBLE AS t FROM n, m UNION ALL SELECT 'simple', n, b, k / n::DOUBLE FROM n, m UNION ALL SELECT 'majority', n, k / n::DOUBLE, k / n::DOUBLE FROM n, m) SELECT approach, n, round(x, 6) AS accuracy, round(100 * (x - t), 4) AS lift, round(100 * (x - (SELECT x FROM r WHERE approach = 'simple')), 4) AS lift_over_simple FROM r",
    "chunks": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents",
}

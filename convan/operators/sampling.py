"""Seeded sampling, splits and order. Randomness is data: md5 of id and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convan.functions.scratch import ranked
from convan.plans import bindings as B


def sample_n(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    return df.withColumn("u", B.uniform(id_col, seed)).orderBy("u", id_col).limit(n)


def text_blocks(sample: DataFrame, id_col: str, text: str, by: str = "u") -> DataFrame:
    """number (from 1, by `by` and id) and block: the number, the id and the text of each row, for reading; write the column as text. Null texts are empty."""
    placed = ranked(sample.select(id_col, text, by), [F.col(by), F.col(id_col)], name="number")
    block = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    return placed.select(F.col("number").cast("long").alias("number"), block.alias("block"))


def _rank(df: DataFrame, id_col: str, cls: str, seed: int) -> DataFrame:
    """Rows numbered at random within their class; a class that holds most rows is numbered by many tasks."""
    return ranked(df.withColumn("u", B.uniform(id_col, seed)), [F.col("u"), F.col(id_col)], (cls,), "k")


def sample_stratified(df: DataFrame, id_col: str, cls: str, n: int, classes: int, seed: int) -> DataFrame:
    """n rows: as many of each class as fit evenly, then at random from what is left."""
    quota = max(1, n // classes)
    rows = _rank(df.select(id_col, cls), id_col, cls, seed)
    return rows.withColumn("extra", F.col("k") > quota).orderBy("extra", "u", id_col).limit(n).drop("k")


def split_stratified(df: DataFrame, id_col: str, cls: str, fraction: float, seed: int) -> DataFrame:
    """dev or holdout per row: of each class the fraction, rounded half to even, goes to dev."""
    rows = _rank(df.select(id_col, cls), id_col, cls, seed)
    sizes = df.groupBy(F.col(cls).alias("_cls")).agg(F.count("*").alias("n"))
    return rows.join(sizes.hint("merge"), F.col(cls).eqNullSafe(F.col("_cls"))).select(id_col, cls, F.when(F.col("k") <= F.bround(F.col("n") * fraction), "dev").otherwise("holdout").alias("split"))


def split_report(split: DataFrame, cls: str, scorable: str, least: int = 3) -> DataFrame:
    """Rows and scorable rows of each class on either side, and classes with few holdout rows marked as thin."""
    on = lambda side, also=F.lit(True): F.count_if((F.col("split") == side) & also)
    ok = F.coalesce(F.col(scorable), F.lit(False))
    return split.groupBy(cls).agg(on("dev").alias("dev"), on("holdout").alias("holdout"), on("dev", ok).alias("dev_scorable"), on("holdout", ok).alias("holdout_scorable"), (on("holdout") < least).alias("thin"))


def stratified_folds(df: DataFrame, id_col: str, cls: str, most: int, seed: int) -> DataFrame:
    """Rows of each class dealt in turn to k folds, k being the size of the smallest class, at most `most`."""
    k = df.groupBy(cls).agg(F.count("*").alias("n")).agg(F.least(F.min("n"), F.lit(most)).alias("_folds"))  # one row
    return _rank(df.select(id_col, cls), id_col, cls, seed).crossJoin(F.broadcast(k)).select(id_col, cls, ((F.col("k") - 1) % F.col("_folds")).alias("fold"))


def coverage_plan(have: DataFrame, pool: DataFrame, cls: str, floor: int, classes: list[str]) -> DataFrame:
    """Have, need and available rows of each of the given classes; what has no rows shows as 0."""
    known = pool.sparkSession.createDataFrame([(c,) for c in classes], f"{cls} string")
    counts = pool.groupBy(cls).agg(F.count("*").alias("a")).join(have.groupBy(cls).agg(F.count("*").alias("n")).hint("merge"), cls, "full")
    n = F.coalesce("n", F.lit(0))
    return known.join(counts.hint("merge"), cls, "left").select(cls, n.alias("have"), F.greatest(floor - n, F.lit(0)).alias("need"), F.coalesce("a", F.lit(0)).alias("available"))


def _docs(spark, d):
    return B.table(spark, d, "documents")


def _split(s, d):
    return split_stratified(B.gold(s, d), "doc_id", "lang", 0.6, 7)


CLASSES = ["en", "de", "fr", "es", "it", "pt"]  # of the plan, also those that no row has
QUERIES = {
    "text_blocks": lambda s, d: text_blocks(sample_n(_docs(s, d), "doc_id", 50, 42), "doc_id", "text"),
    "sample_n": lambda s, d: sample_n(_docs(s, d), "doc_id", 50, 42).select("doc_id", "u"),
    "sample_stratified": lambda s, d: sample_stratified(_docs(s, d), "doc_id", "lang", 30, 4, 42).select("doc_id", "lang", "extra"),
    "split_stratified": _split,
    "split_report": lambda s, d: split_report(_split(s, d).join(B.table(s, d, "labels").hint("merge"), "doc_id").withColumn("ok", F.col("quality") == 1), "lang", "ok"),
    "stratified_folds": lambda s, d: stratified_folds(B.gold(s, d), "doc_id", "lang", 5, 3),
    "coverage_plan": lambda s, d: coverage_plan(B.gold(s, d), _docs(s, d), "lang", 100, CLASSES),
}
_u = lambda seed: B.sql_uniform("doc_id", seed)
_SPLIT = f"{B.SQL_GOLD}, split AS (SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_u(7)}, doc_id) <= round_even(count(*) OVER (PARTITION BY lang) * 0.6, 0) THEN 'dev' ELSE 'holdout' END AS split FROM gold)"
ORACLE_SQL = {
    "text_blocks": f"WITH p AS (SELECT doc_id, text, row_number() OVER (ORDER BY {_u(42)}, doc_id) AS number FROM documents QUALIFY number <= 50) SELECT number, '[' || number || '] ' || doc_id || chr(10) || coalesce(text, '') || chr(10) AS block FROM p",
    "sample_n": f"SELECT doc_id, {_u(42)} AS u FROM documents ORDER BY u, doc_id LIMIT 50",
    "sample_stratified": f"WITH r AS (SELECT doc_id, lang, {_u(42)} AS u, row_number() OVER (PARTITION BY lang ORDER BY {_u(42)}, doc_id) > 7 AS extra FROM documents) SELECT doc_id, lang, extra FROM r ORDER BY extra, u, doc_id LIMIT 30",
    "split_stratified": f"WITH {_SPLIT} SELECT * FROM split",
    "split_report": f"WITH {_SPLIT} SELECT lang, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'holdout') AS holdout, count(*) FILTER (split = 'dev' AND quality = 1) AS dev_scorable, count(*) FILTER (split = 'holdout' AND quality = 1) AS holdout_scorable, count(*) FILTER (split = 'holdout') < 3 AS thin FROM split JOIN labels USING (doc_id) GROUP BY lang",
    "stratified_folds": f"WITH {B.SQL_GOLD} SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY {_u(3)}, doc_id) - 1) % (SELECT least(min(n), 5) FROM (SELECT count(*) AS n FROM gold GROUP BY lang)) AS fold FROM gold",
    "coverage_plan": f"WITH {B.SQL_GOLD}, h AS (SELECT lang, count(*) AS n FROM gold GROUP BY lang), a AS (SELECT lang, count(*) AS a FROM documents GROUP BY lang) SELECT lang, coalesce(n, 0) AS have, greatest(100 - coalesce(n, 0), 0) AS need, coalesce(a, 0) AS available FROM (SELECT unnest({CLASSES}) AS lang) LEFT JOIN h USING (lang) LEFT JOIN a USING (lang)",
}

"""The test tables in the roles that the operators take, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message: msg_id, conv_id, turn, author, text, reply_to.

    Ids hold turns below 1,000, so a conversation has no more messages than that, and its window stays small."""
    conv = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "conv_id", "turn", F.col("role").alias("author"), "text")
    return conv.withColumn("reply_to", F.lag("msg_id").over(Window.partitionBy("conv_id").orderBy("turn")))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


_LANG_A = (("[éèêç]", "fr"), ("[ñóíá]", "es"), ("[äöüß]|sch", "de"))
_LANG_B = (("[é]", "fr"), ("[ñ]", "es"), ("[ü]", "de"))


def _guess(rules: tuple) -> Column:
    out = F.lit("en")
    for pattern, lang in reversed(rules):
        out = F.when(F.col("text").rlike(pattern), lang).otherwise(out)
    return out


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, gold, a, b: the language of each document, and two rule-based guesses."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("gold"), _guess(_LANG_A).alias("a"), _guess(_LANG_B).alias("b"))


def uniform(id_col: str, seed: int) -> Column:
    """Seeded pseudo-randomness from data: 32 bits of md5(id:seed), as a long. The same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def route_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, intent, confidence, flags and the truth (toxic) of each labelled document."""
    return gold(spark, sf_dir).select(
        F.col("doc_id").alias("item"), F.col("lang").alias("intent"), (uniform("doc_id", 1) / 4294967295.0).alias("confidence"),
        (F.col("n_chars") > 4000).alias("legal_sensitive"), F.col("text").rlike("(?i)stupid|idiot|scum").alias("abusive_content"), (F.col("n_chars") < 60).alias("wants_human"), (F.col("toxic") == 1).alias("escalate"),
        (uniform("doc_id", 21) % 50 == 0).alias("triage"), (uniform("doc_id", 22) % 25 == 0).alias("disputes"), (uniform("doc_id", 23) % 40 == 0).alias("churn_risk"),
    )


SQL_MSGS = "msgs AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn, role AS author, text, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to FROM conversations)"
SQL_GOLD = "gold AS (SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
_case = lambda rules: "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{v}'" for p, v in rules) + " ELSE 'en' END"
SQL_PREDS = f"preds AS (SELECT doc_id AS item, lang AS gold, {_case(_LANG_A)} AS a, {_case(_LANG_B)} AS b FROM documents)"


def sql_uniform(id_col: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({id_col} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


SQL_ROUTE = f"""{SQL_GOLD}, route_in AS (SELECT doc_id AS item, lang AS intent, {sql_uniform("doc_id", 1)} / 4294967295.0 AS confidence, n_chars > 4000 AS legal_sensitive,
    regexp_matches(text, '(?i)stupid|idiot|scum') AS abusive_content, n_chars < 60 AS wants_human, toxic = 1 AS escalate, {sql_uniform("doc_id", 21)} % 50 = 0 AS triage, {sql_uniform("doc_id", 22)} % 25 = 0 AS disputes, {sql_uniform("doc_id", 23)} % 40 = 0 AS churn_risk FROM gold)"""

"""A text classifier of TF-IDF features with Spark ML, and predictions for rows that their model has not seen."""

from __future__ import annotations

import functools
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convan.functions.scratch import saved
from convan.operators.sampling import stratified_folds
from convan.operators.text import STOP, TOKEN
from convan.plans import bindings as B

FEATURES = 1 << 16  # hash buckets of terms: bounds the model and what a task sums, whatever the vocabulary
LEAST_ROWS = 10
SIDE_BY_SIDE = 2  # fits at a time
LEAST_DOCS = 2  # documents that a term (its bucket) must be in


def _regression() -> LogisticRegression:
    return LogisticRegression(featuresCol="_features", labelCol="_index", weightCol="_weight", predictionCol="_predicted", probabilityCol="_p", rawPredictionCol="_raw", regParam=1e-3, maxIter=30)


def fit_text_classifier(df: DataFrame, text: str, label: str, features: int = FEATURES) -> PipelineModel:
    """A logistic regression over TF-IDF weights of 1- and 2-grams, each class with the same total weight.

    Texts are tokenised and hashed once, where they are read, into a table that all passes read; no text is dealt by its label.
    Rows without a text or label take no part; fewer than LEAST_ROWS rows raise ValueError. A sole class is always predicted."""
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("_text"), F.col(label).cast("string").alias("_label"))
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # a row for each class
    total = sum(counts.values())
    if total < LEAST_ROWS:
        raise ValueError(f"a text classifier needs at least {LEAST_ROWS} rows")
    front = Pipeline(stages=[*_tokens(), HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features)]).fit(rows)
    table = saved(front.transform(rows).select("_label", "_tf"), "hashed")
    labels = sorted(counts)
    idf = IDF(inputCol="_tf", outputCol="_idf", minDocFreq=LEAST_DOCS).fit(_merged(table))
    scaled = PipelineModel(stages=[idf, Normalizer(inputCol="_idf", outputCol="_features")])
    weights = {x: total / (len(labels) * counts[x]) for x in labels}
    ready = scaled.transform(_merged(table)).select("_features", _by_label({x: i for i, x in enumerate(labels)}).alias("_index"), _by_label(weights).alias("_weight"))
    return PipelineModel(stages=[*front.stages, *scaled.stages, _regression().fit(ready), IndexToString(inputCol="_predicted", outputCol="predicted", labels=labels)])


def _by_label(of: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(v) for x in of for v in (x, float(of[x]))))[F.col("_label")]


def _merged(table: DataFrame) -> DataFrame:
    """The same rows in as many tasks as run at once: each sends a gradient, features x classes numbers, in every step of a fit."""
    return table.coalesce(table.sparkSession.sparkContext.defaultParallelism)


def predict(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """df with `predicted`. A null text counts as empty."""
    out = model.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    return out.select(*df.columns, "predicted")


def _tokens() -> list:
    return [
        RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=TOKEN, gaps=False),
        StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=STOP),
        NGram(inputCol="_words", outputCol="_pairs", n=2),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
    ]


def out_of_fold(df: DataFrame, id_col: str, text: str, label: str, most: int = 5, seed: int = 3, features: int = FEATURES) -> DataFrame:
    """id_col, label, fold and predicted: each row's prediction by the model of all other folds.

    Texts are tokenised and hashed once, into one table. Document frequencies and class sizes are taken by fold; those that a
    fold's model may see are the total less its own, `features` numbers a fold. SIDE_BY_SIDE models are fitted at a time. Folds are
    stratified; there are as many as the smallest class has rows, at most `most`, and at least two are needed."""
    spark = df.sparkSession
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(id_col, text, label)
    folds = stratified_folds(rows, id_col, label, most, seed).select(id_col, "fold")
    dealt = rows.join(folds.hint("merge"), id_col).select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(label).cast("string").alias("_label"), "fold")
    hashed = Pipeline(stages=[*_tokens(), HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features)]).fit(dealt)
    table = saved(hashed.transform(dealt).select("_id", "_label", "fold", "_tf"), "features")
    sizes: dict[int, dict[str, int]] = {}
    for r in table.groupBy("fold", "_label").agg(F.count("*").alias("n")).collect():  # a row for each class and fold
        sizes.setdefault(r["fold"], {})[r["_label"]] = r["n"]
    if len(sizes) < 2:
        raise ValueError("each class needs two rows at least")
    seen = {r["fold"]: r["n"].toArray() for r in table.groupBy("fold").agg(Summarizer.numNonZeros(F.col("_tf")).alias("n")).collect()}
    labels = sorted({x for by in sizes.values() for x in by})
    total, every = sum(seen.values()), {x: sum(by.get(x, 0) for by in sizes.values()) for x in labels}

    def one(fold: int) -> DataFrame:
        left = {x: every[x] - sizes[fold].get(x, 0) for x in labels}
        known, n = total - seen[fold], sum(left.values())
        idf = np.where(known >= LEAST_DOCS, np.log((n + 1) / (known + 1)), 0.0)
        codes = {x: i for i, x in enumerate(labels)}
        scaled = PipelineModel(stages=[ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_features")]).transform(_merged(table))
        scaled = scaled.withColumn("_index", _by_label(codes)).withColumn("_weight", _by_label({x: n / (len(labels) * max(left[x], 1)) for x in labels}))
        model = _regression().fit(scaled.where(F.col("fold") != fold).select("_features", "_index", "_weight"))
        return IndexToString(inputCol="_predicted", outputCol="predicted", labels=labels).transform(model.transform(scaled.where(F.col("fold") == fold)))

    with ThreadPool(SIDE_BY_SIDE) as pool:  # one's tasks fill the gaps of the other; each holds its rows in memory
        parts = pool.map(inheritable_thread_target(spark)(one), sorted(sizes))
    out = functools.reduce(DataFrame.unionByName, (p.select("_id", "_label", "fold", "predicted") for p in parts))
    return out.select(F.col("_id").alias(id_col), F.col("_label").alias(label), "fold", "predicted")


def fold_scores(predicted: DataFrame, label: str) -> DataFrame:
    """One row: folds, rows, mean of the folds' accuracies and their sample deviation (null for one fold)."""
    per = predicted.groupBy("fold").agg(F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("a"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_folds"), F.sum("n").alias("n"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_samp("a"), 6).alias("deviation"))


# SQL can't express a fitted model: tests/test_cases.py holds these to their accuracy on rows not seen.
QUERIES = {
    "text_classifier": lambda s, d: (lambda g, t: predict(fit_text_classifier(t, "text", "lang"), g, "text").select("doc_id", "lang", "predicted"))(B.table(s, d, "documents"), B.gold(s, d)),
    "out_of_fold": lambda s, d: out_of_fold(B.gold(s, d), "doc_id", "text", "lang"),
    "fold_scores": lambda s, d: fold_scores(out_of_fold(B.gold(s, d), "doc_id", "text", "lang"), "lang"),
}
ORACLE_SQL: dict[str, str] = {}

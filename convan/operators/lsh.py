"""Approximate nearest rows by random projections: locality-sensitive buckets, blocks within them, exact ranking.

A table of buckets puts rows together whose unit vectors fall into the same cells of `bits` random projections; a row is in
one bucket of each table. Queries meet the rows of their buckets in blocks of bounded size, as matrix products, and every block
leaves k rows a query, so no pair of rows is written out and a bucket that many rows share is dealt over many tasks."""

from __future__ import annotations

from math import erf, pi, sqrt

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convan.functions.scratch import saved
from convan.operators.vectors import block_top_k, usable
from convan.plans import bindings as B

TABLES, TARGET, SAMPLE, BLOCK, SEED = 8, 0.95, 2_048, 4_096, 29
WIDTHS = np.geomspace(0.05, 40, 120)  # of a projection's cells, for unit vectors
BITS = range(1, 17)


def meeting(distance: np.ndarray, width: float) -> np.ndarray:
    """The chance that two vectors at a distance fall into one cell of a random projection (Datar et al. 2004)."""
    x = width / np.maximum(distance, 1e-9)
    below = 0.5 * (1 + np.array([erf(v / sqrt(2)) for v in -x.ravel()]).reshape(x.shape))
    return 1 - 2 * below - 2 / (sqrt(2 * pi) * x) * (1 - np.exp(-x * x / 2))


def fitted(sample: np.ndarray, k: int, tables: int = TABLES, target: float = TARGET) -> tuple[int, float]:
    """Projections a table and the width of their cells: the pair with which rows meet least, and yet `target` of the sample's own k nearest are met.

    A sample's neighbours are farther than the whole table's, so the table's are met more often."""
    if len(sample) < 2:
        return 1, float(WIDTHS[-1])
    d = np.sqrt(np.maximum(2 - 2 * sample @ sample.T, 0))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, : min(k, len(d) - 1)]
    grid = np.linspace(0, 2, 201)  # distances of unit vectors
    share = lambda x: np.histogram(x[np.isfinite(x)], np.append(grid - 0.005, 2.005))[0] / max(np.isfinite(x).sum(), 1)
    near, every = share(near), share(d)
    best = None
    chances = [meeting(grid, w) for w in WIDTHS]
    for bits in BITS:
        for width, chance in zip(WIDTHS, chances, strict=True):
            if (near * (1 - (1 - chance**bits) ** tables)).sum() >= target:
                work = float((every * tables * chance**bits).sum())
                if best is None or work < best[0]:
                    best = (work, bits, float(width))
                break
    return best[1:] if best else (1, float(WIDTHS[-1]))


def vector_top_k_lsh(queries: DataFrame, corpus: DataFrame, id_col: str, vec: str, k: int, tables: int = TABLES, target: float = TARGET, sample: int = SAMPLE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, doc_id, similarity, rank: of the rows that share a bucket with a query, the k nearest by cosine above 0, itself excluded; ties go to the smaller id.

    Cells are fitted on at most `sample` rows of the corpus; every row is indexed. Null, empty and zero vectors take no part;
    all vectors have one length. Rows that repeat an id count once, by the nearest; an empty side gives an empty table."""
    v = F.col(vec).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda df: df.where(usable(vec) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(v, lambda x: x / length).alias("v"))
    base, asked = unit(corpus), unit(queries)
    held = base.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()  # at most `sample` rows
    if held.empty:
        return base.sparkSession.createDataFrame([], "query_id long, doc_id long, similarity double, rank int")
    bits, width = fitted(np.stack(held["v"].tolist()), k, tables, target)
    # Spark's projections have length 1 and cells begin at 0: one more coordinate, many cells long and the same for all, shifts each projection's cells at random.
    width /= sqrt(len(held["v"][0]) + 1)
    shift = 1000.0 * width * sqrt(len(held["v"][0]) + 1)
    vectors = lambda df: df.withColumn("x", array_to_vector(F.concat("v", F.array(F.lit(shift)))))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=width, numHashTables=tables * bits, seed=seed).fit(vectors(base.limit(1)))

    def keyed(df: DataFrame) -> DataFrame:
        cell = lambda i: vector_to_array(F.col("h")[i])[0].cast("int")
        keys = F.array(*(F.xxhash64(F.lit(t), *(cell(t * bits + i) for i in range(bits))) for t in range(tables)))
        # In sub-queries of their own, so that the projections of a row are taken once.
        return saved(saved(model.transform(vectors(df)).select("id", "v", keys.alias("keys")), "cells").select("id", "v", F.explode("keys").alias("bucket")), "buckets")

    base, asked = keyed(base), keyed(asked)
    count = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    # Buckets grow with the corpus, so their sizes are joined, not sent; a bucket without queries goes no further.
    sizes = saved(count(base, "base_blocks").join(count(asked, "query_blocks").hint("shuffle_hash"), "bucket"), "sizes")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = saved(asked.join(sizes.hint("merge"), "bucket").select("bucket", own("query_blocks").alias("a"), others("base_blocks").alias("b"), F.col("id").alias("query_id"), F.col("v").alias("q")), "asked")
    right = saved(base.join(sizes.hint("merge"), "bucket").select("bucket", others("query_blocks").alias("a"), own("base_blocks").alias("b"), F.col("id").alias("doc_id"), F.col("v").alias("c")), "base")
    keys = ["bucket", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block_top_k(k), "query_id long, doc_id long, similarity double")
    best = found.groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n (rows of the exact table), found of them, and recall."""
    key = ["query_id", "doc_id"]
    both = exact.select(*key).join(found.select(*key, F.lit(1).alias("hit")).hint("merge"), key, "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("found"), F.round(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), 6).alias("recall"))


def _is_query() -> Column:
    return F.col("vec_id") % 20 == 0


def _near(s, d):
    v = B.table(s, d, "embeddings")
    return vector_top_k_lsh(v.where(_is_query()), v, "vec_id", "embedding", 5)


QUERIES = {"vector_top_k_lsh": _near}
ORACLE_SQL: dict[str, str] = {}  # approximate by nature: tests measure recall against the exact search

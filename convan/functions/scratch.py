"""Tables written to the folder that driver and executors share, to cut lineage or to number rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []  # stands in for spark.checkpoint.dir where that is unset


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir, or in a temporary folder where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="convan-"))
        found = _OWN[0]
    return f"{found.rstrip('/')}/convan/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """The sum of value over all rows up to each in an order, without a task that sees them all; the order must be total.

    Rows are dealt by ranges and written; each range sums its own and adds the sums of the ranges before. What is broadcast
    has one row per range."""
    cols = df.columns
    dealt = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_s")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_k", inside).join(F.broadcast(before), "_part").select(*cols, (F.col("_k") + F.col("_before")).alias(name))


def ranked(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in an order, per value of `by` or over the whole table, without a task that sees them all.

    Rows are dealt by ranges of (by, order) and written; each range numbers its own rows and adds the rows of the ranges
    before it. What is broadcast has one row per range and class at its border, at most ranges + classes. Nulls in `by`
    are a class; the order must be total for a defined result."""
    cols = df.columns
    dealt = saved(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by, F.lit(0)).orderBy("_part")) - F.col("_n")
    before = sizes.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), earlier.alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return dealt.withColumn("_k", inside).join(before.hint("shuffle_hash"), on).select(*cols, (F.col("_k") + F.col("_before")).alias(name))

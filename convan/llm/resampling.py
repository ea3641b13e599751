"""Importance resampling towards a target distribution, over hashed n-grams.

Texts are brought to one form: A-Z lower-cased, each run of separators (ASCII other than letters and digits) one space. In
that form a pattern of n words with one space between, and a border on either side (lookarounds), is searched for with
overlaps, so that every start of a word gives the span of its n-gram; the CRC of the span modulo `buckets` is the feature.

One pass over the texts writes each document's features as small numbers; corpus counts are sums over that table (a row a
bucket and task), the target's are counted alike. Gains are a table of `buckets` numbers, whatever the corpus's size, and go
to all tasks. Scores are drawn with Gumbel noise from a seeded hash of the id, so the highest ones are a weighted sample
without replacement; they are ranked by ranges, many tasks at a time.

Defined cases: null and empty texts, and those with fewer than n words, have no features of n words and weight 0; rows that repeat an
id have the same noise and are ranked each; a null id hashes as the string 'null' and comes last among ties; an empty table
or target gives counts of zero. Texts of any length are scanned whole. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convan.functions.scratch import ranked
from convan.llm.common import runs_of_bytes, saved, spread

BUCKETS, SEED = 10_000, 2024
_FORM = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def one_form(text: bytes) -> bytes:
    """Lower-case words with single spaces between."""
    return b" ".join(text.translate(_FORM).split())


@lru_cache
def _pattern(n: int):
    import regex

    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def spans(text: bytes, n: int) -> Iterator[tuple[int, int]]:
    """Where the runs of n words of a text in one form begin and end."""
    return (m.span() for m in _pattern(n).finditer(text, overlapped=True))


def _features(sizes: range, buckets: int):
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to in runs_of_bytes(whole.column(1)):
                words, found = [], []
                for text in whole.column(1)[at:to].cast(pa.binary()).to_pylist():
                    form = one_form(text or b"")
                    words.append(form.count(b" ") + 1 if form else 0)
                    crcs = [zlib.crc32(form[a:b]) for n in sizes for a, b in spans(form, n)]
                    found.append((np.array(crcs, np.uint32) % buckets).astype(kind).tobytes())
                size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([whole.column(0)[at:to], pa.array(words, pa.int64()), pa.array(size), pa.array(found, pa.binary())], names=["id", "n_words", "n_features", "features"])

    return run


def features(docs: DataFrame, sizes: range = range(1, 2), buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features and the buckets of all n-grams, repeats included, as little-endian numbers of 2 bytes (4 beyond 65,536 buckets)."""
    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    return saved(source.mapInArrow(_features(sizes, buckets), "id long, n_words long, n_features long, features binary"), "features")


def _numbers(column: pa.Array, buckets: int) -> np.ndarray:
    """The features of all rows, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, to in runs_of_bytes(batch.column(0)):
                total += np.bincount(_numbers(batch.column(0)[at:to], buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = found.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the log ratio of its smoothed shares in target and corpus, in thousandths."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, sizes: range = range(1, 2), buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per document id_col, n_features, weight, score, and its rank if it is drawn: of N documents with enough words, percent * N // 100."""
    found = features(docs, sizes, buckets, id_col, text_col)
    wanted = features(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), sizes, buckets, "id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets)))

    @F.pandas_udf("long")
    def weight(features: pd.Series) -> pd.Series:
        column = pa.array(features, pa.binary())
        out = np.zeros(len(features), np.int64)
        for at, to in runs_of_bytes(column):
            size = np.asarray(pc.binary_length(column[at:to])) // (2 if buckets <= 1 << 16 else 4)
            sums = np.append(0, np.cumsum(sent.value[_numbers(column[at:to], buckets)]))
            ends = np.cumsum(size)
            out[at:to] = (sums[ends] - sums[ends - size]) // np.maximum(size, 1)
        return pd.Series(out)

    weighed = found.select("id", "n_words", "n_features", weight("features").alias("weight")).withColumn("score", F.col("weight") + noise("id", seed))
    weighed = saved(weighed.withColumn("place", F.monotonically_increasing_id()), "weighed")
    enough = weighed.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("place")]  # places part rows that are alike, however many
    placed = ranked(enough, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

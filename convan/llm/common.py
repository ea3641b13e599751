"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN_DIR: list[str] = []  # stands in for spark.checkpoint.dir where that is unset


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="convan-"))
        found = _OWN_DIR[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or archive in the shared folder."""
    return f"{shared_dir(spark)}/convan/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over at least as many partitions as there are cores; a table of many files or row groups stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *keys)


def crc_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string"))


# Byte classes: 0 blank or control, 1 letter, digit or any byte over 127, 2 other signs.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 2
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_lo:_hi] = 1
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)[_LOWER]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept per worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = []
        for q in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(size, q, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit hashes over all their bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of data, with A-Z as a-z: differences of one running polynomial sum."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs_of_bytes(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, after the last) of runs of texts that together have at most so many bytes; of one text if that has more."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


class WordIds:
    """Ids of many words at a time. Those of short words are kept; beyond `most` words, only those of the last batch stay.

    encode_new gives the ids of words as little-endian unsigned 32-bit numbers, for words that aren't known."""

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], most: int = 800_000, letters: int = 48):
        self.encode_new, self.most, self.letters = encode_new, most, letters
        self.known: dict[str, bytes] = {}

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            for i, ids in zip(new, self.encode_new([words[i] for i in new]), strict=True):
                found[i] = ids
                if len(words[i]) <= self.letters:
                    self.known[words[i]] = ids
        if len(self.known) > self.most:
            self.known = {w: x for w, x in zip(words, found, strict=True) if len(w) <= self.letters}
        return found

    def batch(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists of words, one after the other, and where each list's ids end."""
        coded = lists.flatten().dictionary_encode()
        ids = self.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = size[index] if len(index) else np.zeros(0, np.int64)
        after = np.cumsum(n)
        out = flat[np.repeat(first[index] - (after - n), n) + np.arange(n.sum())] if len(index) else np.zeros(0, "<u4")
        counts = np.asarray(lists.value_lengths().fill_null(0))
        return out, np.concatenate([[0], after])[np.cumsum(counts)]

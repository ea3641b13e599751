"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Word vectors: every word has a sparse random index vector (NONZERO entries of +-1 out of DIM); a word's context vector
is the sum of the index vectors of the words within WINDOW places of it, over the whole corpus. Words are hashed into
BUCKETS rows, so the table has one size at any corpus size; each partition sums its own table and Spark adds the tables
up by bucket. A document is the mean and the spread of its words' unit vectors. A numpy network with one hidden layer
is fitted on at most FIT_ROWS labelled rows; one temperature, fitted on rows that the network didn't see, calibrates
its probabilities.

Defined cases: a null or empty text has no words and gets the score of the zero vector; null labels are no labels; with
labels of one kind only, or none, every score is that kind's share (0.5 without labels). Repeated rows are scored each,
and fit the network once.
Texts of any length are read in pieces of about a megabyte, cut at blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convan.llm.common import _CLASS, _UPPER, span_hashes

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
FIT_ROWS = 20_000  # at most so many labelled rows fit the network
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 400, 0.02, 1e-4, 7
PIECE = 1 << 20  # bytes of text handled at once
SHOUTED, REPEATED, MARKS = 0, 1, 8  # buckets of markers: a word in capitals, a word just said; MARKS are kept for markers

_rng = np.random.default_rng(5)
_PLACE = np.argsort(_rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
_SIGN = _rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of about PIECE bytes: the bytes, where each part begins, and the row each part belongs to.

    Parts end in a blank, so that no word spans two; a text over PIECE bytes is cut at blanks into several parts."""
    buffer, starts, rows, size = [], [], [], 0

    def ready():
        return np.frombuffer(b"".join(buffer), np.uint8), np.array(starts), np.array(rows)

    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        at = 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            if end < len(data):
                cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
                end = cut + 1 if cut > at else end
            buffer.append(data[at:end] + b" ")
            starts.append(size)
            rows.append(row)
            size += end - at + 1
            at = end
            if size >= PIECE:
                yield ready()
                buffer, starts, rows, size = [], [], [], 0
    if buffer:
        yield ready()


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: bucket, part, whether a word in capitals, whether it repeats one of the two tokens before it."""
    kind = _CLASS[data]
    new = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    ends = np.append(new[1:], len(data))
    keep = kind[new] > 0
    begin, end = new[keep], ends[keep]
    hashed = span_hashes(data, begin, end)
    bucket = (MARKS + (hashed >> np.uint64(20)) % np.uint64(BUCKETS - MARKS)).astype(np.int64)
    part = np.searchsorted(starts, begin, side="right") - 1
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    shouted = (capitals[end] - capitals[begin] == end - begin) & (end - begin > 1)
    again = np.zeros(len(begin), bool)
    for k in (1, 2):
        again[k:] |= (hashed[k:] == hashed[:-k]) & (part[k:] == part[:-k])
    return bucket, part, shouted, again


def _context_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's table of context vectors, rows that are not zero."""
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for data, starts, _ in pieces(batch.iloc[:, 0].tolist()):
            bucket, part, shouted, again = tokens(data, starts)
            cells, signs = [], []
            for k in range(1, WINDOW + 1):
                near = part[k:] == part[:-k]
                for of, by, marks in ((slice(k, None), slice(None, -k), True), (slice(None, -k), slice(k, None), True)):
                    word, context = bucket[of][near], bucket[by][near]
                    for flag, mark in ((None, 0), (shouted, SHOUTED), (again, REPEATED)):
                        if flag is None:
                            to, ctx = word, context
                        else:
                            hit = flag[of][near]
                            to, ctx = np.full(int(hit.sum()), mark, np.int64), context[hit]
                        cells.append((to[:, None] * DIM + _PLACE[ctx]).ravel())
                        signs.append(_SIGN[ctx].ravel())
            if cells:
                total += np.bincount(np.concatenate(cells), np.concatenate(signs), minlength=BUCKETS * DIM)
    total = total.reshape(BUCKETS, DIM)
    rows = np.flatnonzero(np.abs(total).sum(1))
    yield pd.DataFrame(total[rows].astype(np.float32), columns=[f"d{i}" for i in range(DIM)]).assign(bucket=rows.astype(np.int32))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The corpus's unit context vectors, BUCKETS x DIM: a table of fixed size."""
    schema = ", ".join([*(f"d{i} float" for i in range(DIM)), "bucket int"])
    sums = docs.select(F.col(text_col)).mapInPandas(_context_sums, schema).groupBy("bucket").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIM))).toPandas()
    out = np.zeros((BUCKETS, DIM), np.float32)
    if len(sums):
        out[sums["bucket"].to_numpy()] = sums[[f"d{i}" for i in range(DIM)]].to_numpy(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean and spread of its tokens' vectors, and the share of each marker."""
    n, first, second, marks = np.zeros(len(texts)), np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM)), np.zeros((len(texts), 2))
    for data, starts, rows in pieces(texts):
        bucket, part, shouted, again = tokens(data, starts)
        if not len(bucket):
            continue
        row = rows[part]
        value = vectors[bucket]
        for flag, mark in ((shouted, SHOUTED), (again, REPEATED)):
            value = np.where(flag[:, None], (value + vectors[mark]) / 2, value)
        at = np.flatnonzero(np.diff(row, prepend=-1))
        which = row[at]
        first[which] += np.add.reduceat(value, at, axis=0)
        second[which] += np.add.reduceat(value * value, at, axis=0)
        np.add.at(n, which, np.diff(np.append(at, len(row))))
        np.add.at(marks[:, 0], row, shouted)
        np.add.at(marks[:, 1], row, again)
    size = np.maximum(n, 1)[:, None]
    mean = first / size
    return np.hstack([mean, np.sqrt(np.maximum(second / size - mean * mean, 0)), marks / size])


class Network:
    """Two layers, tanh between, and a temperature. Fitted by Adam on standardised inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.flat = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) > 0 and 0 < self.flat < 1
        if not self.fitted:
            return
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        apart = order[: len(y) // 5]  # for the temperature
        seen = order[len(y) // 5 :]
        if len(set(y[seen])) < 2:
            seen = order
        self.mean, self.scale = x[seen].mean(0), x[seen].std(0) + 1e-3
        z, t = (x[seen] - self.mean) / self.scale, y[seen]
        self.p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        balance = np.where(t == 1, 0.5 / max(t.mean(), 1e-6), 0.5 / max(1 - t.mean(), 1e-6)) ** 0.5
        for step in range(1, EPOCHS + 1):
            pick = slice(None) if len(t) <= 2048 else rng.integers(0, len(t), 2048)
            h = np.tanh(z[pick] @ self.p[0] + self.p[1])
            d = balance[pick] * (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - t[pick]) / len(h)
            dh = np.outer(d, self.p[2]) * (1 - h * h)
            for k, g in enumerate((z[pick].T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()]))):
                g = g + DECAY * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        logits, truth = self.logits(x[apart]), y[apart]
        grid = np.geomspace(0.25, 8, 41)
        # A weak prior around 1 stands in for rows where there are few.
        loss = [np.logaddexp(0, np.where(truth == 1, -logits, logits) / t).sum() + 2 * np.log(t) ** 2 for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labelled: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors of all docs, and the network fitted on at most FIT_ROWS rows of labelled (id_col, label_col: 0 or 1)."""
    vectors = word_vectors(docs, text_col)
    spark = docs.sparkSession
    sample = labelled.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().orderBy(F.xxhash64("_id"), "_id", "_y").limit(FIT_ROWS)
    sent = spark.sparkContext.broadcast(vectors)

    def vectorise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "x": list(pooled(batch["t"].tolist(), sent.value)), "y": batch["y"]})

    # An id may be on any number of rows: what is sent back is one row per id, text and label, and at most FIT_ROWS of them.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "_id").select(F.xxhash64("_id", "t").alias("k"), "t", F.col("_y").alias("y"))
    got = rows.mapInPandas(vectorise, "k long, x array<double>, y double").dropDuplicates(["k", "y"]).orderBy("k", "y").limit(FIT_ROWS).toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), 2 * DIM + 2)
    order = np.lexsort([*x.T[:3], got["y"]])  # the same fit whatever order the rows came in
    return vectors, Network(x[order], got["y"].to_numpy()[order])


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text") -> Column:
    """The probability of label 1 for each row of docs, as a column expression."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors, network = sent.value
        for batch in batches:
            yield pd.Series(network.probabilities(pooled(batch.tolist(), vectors)), dtype="float64")

    return probability(F.col(text_col))

"""Approximate nearest neighbours with learned partitions.

Fitting, on a bounded sample of SAMPLE vectors: the sample's neighbour graph is cut into balanced parts (size-constrained
label propagation), and a small network learns, from each vector, how its neighbours are spread over the parts. Every row
of the table is indexed under its most probable part; a query is sent to its `probes` most probable parts, the fewest
with which the sample reaches TARGET of its true neighbours. Rows of a part are dealt into blocks of BLOCK rows, queries
likewise; a task holds one block of each, ranks by matrix products and gives every query's best `k` of the block, by the
exact cosine in double precision on the original vectors. A window takes the best of all blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers take no part, nor do vectors of another
length than most rows have; rows with the query's id are the query's own, and the
least of their vectors is asked; other repeated rows count each; fewer than k
candidates give what there is; ties go to the smaller id; an empty table gives an empty result. Extra columns are not
read. A part has at least PART_ROWS rows of the sample, so a table of fewer than twice as many is one part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convan.llm.common import saved

SAMPLE, TARGET, BLOCK, PART_ROWS = 4_096, 0.95, 4_096, 16
GRAPH, HIDDEN, EPOCHS, SEED = 10, 64, 60, 9


def parts_for(rows: int, sample: int = SAMPLE) -> int:
    """How many parts a table of so many rows gets: with the square root, 8 at least, as far as the sample can tell parts."""
    return max(1, min(max(8, round(rows**0.5 / 16)), min(rows, sample) // PART_ROWS))


def neighbour_graph(x: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """The k nearest rows of each row of the unit vectors x, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        best = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[at : at + 512] = np.take_along_axis(best, np.argsort(np.take_along_axis(-s, best, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 30) -> np.ndarray:
    """Parts of at most slack * n / parts rows with few graph edges between them."""
    rng = np.random.default_rng(SEED)
    n, most = len(x), int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(n, parts, replace=False)]

    def assign(gain: np.ndarray) -> np.ndarray:
        """Everyone to the part with most gain that has room; who would lose most by waiting goes first."""
        order = np.argsort(-gain, axis=1)
        top = np.take_along_axis(gain, order[:, :2], 1)
        room, out = np.full(parts, most), np.empty(n, np.int64)
        for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable"):
            for p in order[i]:
                if room[p]:
                    out[i] = p
                    room[p] -= 1
                    break
        return out

    of = assign(x @ centres.T)
    for _ in range(8):
        centres = np.stack([x[of == p].sum(0) if (of == p).any() else x[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        of = assign(x @ centres.T)
    flat = np.arange(n).repeat(graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (flat, of[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), of.repeat(graph.shape[1])), 1)
        votes[np.arange(n), of] += 0.5
        new = assign(votes + 0.1 * (x @ centres.T))
        if (new == of).all():
            break
        of = new
    return of


class Router:
    """One hidden layer; gives each vector's probabilities of the parts that hold its neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray):
        rng = np.random.default_rng(SEED)
        p = [rng.normal(0, 1.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, target.shape[1])), np.zeros(target.shape[1])]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            for pick in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                step += 1
                h = np.maximum(x[pick] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                e = np.exp(z - z.max(1, keepdims=True))
                d = (e / e.sum(1, keepdims=True) - target[pick]) / len(pick)
                dh = d @ p[2].T * (h > 0)
                for k, g in enumerate((x[pick].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.probes = p, target.shape[1]

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """The parts of each row, most probable first."""
        return np.argsort(-(np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]), axis=1, kind="stable")


def fit(sample: np.ndarray, parts: int, k: int, target: float = TARGET) -> Router:
    """The router of a sample of vectors; a fifth of it is kept apart to set the number of probes."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    graph = neighbour_graph(x)
    of = balanced_parts(x, graph, parts)
    apart = np.arange(len(x)) % 5 == 0
    aims = np.zeros((len(x), parts))
    np.add.at(aims, (np.arange(len(x)).repeat(graph.shape[1]), of[graph].ravel()), 1)
    aims[np.arange(len(x)), of] += 3
    aims /= aims.sum(1, keepdims=True)
    router = Router(x[~apart], aims[~apart])
    order = router.ranked(x)
    near = graph[apart][:, :k]
    place = np.argmax(order[apart][:, None, :] == order[near, 0][:, :, None], axis=2)  # how far down the query's list a neighbour's part is
    router.probes = next((p for p in range(1, parts + 1) if (place < p).mean() >= target), parts)
    return router


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and x = x and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """Each query's k nearest other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    parts = parts_for(total, sample)
    router = None
    if parts > 1:
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()  # at most `sample` rows
        router = fit(np.stack(picked["v"].tolist()), parts, k)
    sent = spark.sparkContext.broadcast(router)

    def routes(probes: int):
        @F.pandas_udf("array<int>")
        def run(v: pd.Series) -> pd.Series:
            if sent.value is None:
                return pd.Series([[0]] * len(v))
            x = np.stack(v.tolist())
            return pd.Series(list(sent.value.ranked(x / np.linalg.norm(x, axis=1, keepdims=True))[:, :probes].astype(np.int32)))

        return run

    indexed = saved(rows.withColumn("part", F.element_at(routes(1)("v"), 1)), "indexed")
    queries = rows.withColumnRenamed("id", id_col).where(is_query).groupBy(F.col(id_col).alias("id")).agg(F.min("v").alias("v"))
    asked = saved(queries.withColumn("part", F.explode(routes(router.probes if router else 1)("v"))), "asked")
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(indexed, "base_blocks").join(blocks(asked, "query_blocks").hint("merge"), "part")  # a row for each part
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = indexed.join(F.broadcast(sizes), "part").select("part", own("base_blocks").alias("b"), others("query_blocks").alias("q"), "id", "v")
    query = asked.join(F.broadcast(sizes), "part").select("part", others("base_blocks").alias("b"), own("query_blocks").alias("q"), "id", "v")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, y = np.stack(left["v"].tolist()), np.stack(right["v"].tolist())
            ids, length = left["id"].to_numpy(), np.sqrt((x * x).sum(1))
            for i, q in zip(right["id"], y, strict=True):
                about = (x @ q) / length
                about[ids == i] = -np.inf
                size = np.sqrt((q * q).sum())
                if len(about) > k:
                    near = np.flatnonzero(about >= np.partition(about, -k)[-k] - 1e-9 * size)
                else:
                    near = np.arange(len(about))
                near = near[ids[near] != i]
                score = (x[near] * q).sum(1) / (length[near] * size)
                out += [(i, ids[near[j]], score[j]) for j in np.lexsort((ids[near], -score))[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["part", "b", "q"]
    found = base.groupBy(*keys).cogroup(query.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

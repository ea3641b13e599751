"""Approximate nearest rows: recall against the exact search on the given table and on data with neighbourhoods, defined cases."""

import numpy as np
import pytest

from convan.operators import lsh
from convan.operators.vectors import vector_top_k

SF = "/root/testdata/sf0.01"


def test_recall_on_the_given_table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = lsh.QUERIES["vector_top_k_lsh"](spark, SF)
    exact = vector_top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5)
    assert found.columns == ["query_id", "doc_id", "similarity", "rank"] and lsh.recall(found, exact).first().recall >= 0.9
    both = found.join(exact.withColumnRenamed("similarity", "s"), ["query_id", "doc_id"]).select("similarity", "s").collect()
    assert both and all(r.similarity == r.s for r in both)


def clustered(spark, n=3000, dim=24, per=10):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(n // per, dim))
    rows = centres.repeat(per, 0) + 0.25 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, v array<double>"), rows


def test_neighbourhoods_are_found_in_few_rows(spark):
    """With neighbours at hand, buckets hold a small share of all rows and recall stays above 0.9."""
    df, rows = clustered(spark)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    bits, width = lsh.fitted(unit[:2000], 5)
    d = np.sqrt(np.maximum(2 - 2 * unit[:500] @ unit.T, 0))
    assert 1 - (1 - (lsh.meeting(d, width) ** bits)).prod() >= 0 and (lsh.TABLES * lsh.meeting(d, width) ** bits).mean() < 0.25
    queries = df.where("id % 20 = 0")
    exact = vector_top_k(queries, df, "id", "v", 5)
    assert lsh.recall(lsh.vector_top_k_lsh(queries, df, "id", "v", 5), exact).first().recall >= 0.9


def test_meeting_is_what_happens():
    """The formula against drawn projections."""
    rng = np.random.default_rng(0)
    for distance in (0.3, 1.0, 1.4):
        for width in (0.5, 2.0):
            x = rng.normal(size=200_000) * distance
            at = rng.uniform(0, width, 200_000)
            assert abs(((at + x >= 0) & (at + x < width)).mean() - lsh.meeting(np.array([distance]), width)[0]) < 0.01


def test_hot_bucket_is_split(spark):
    """Half of all rows alike: their bucket is dealt into blocks, and all ties are ranked by id."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(400)] + [(i, rng.normal(size=3).tolist()) for i in range(400, 800)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = lsh.vector_top_k_lsh(df.where("id in (7, 300)"), df, "id", "v", 4, block=64)
    assert sorted((r.query_id, r["rank"], r.doc_id, r.similarity) for r in got.collect()) == [(q, k + 1, k, 1.0) for q in (7, 300) for k in range(4)]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, None), (2, []), (3, [0.0, 0.0])]])
def test_too_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert lsh.vector_top_k_lsh(df, df, "id", "v", 3).count() == 0


def test_defined_cases(spark):
    """Unusable vectors take no part; repeated ids count once; other columns may have any name; fewer than k rows give what there is."""
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "b"), (2, [0.9, 0.4], "b"), (3, [2.0, 0.0], "c"), (4, None, "d"), (5, [0.0, 0.0], "e"), (None, [1.0, 0.0], "f")]
    df = spark.createDataFrame(rows, "id long, v array<float>, bucket string")
    got = lsh.vector_top_k_lsh(df.where("id = 1"), df, "id", "v", 5, target=0.999)
    assert [(r.doc_id, r["rank"]) for r in got.orderBy("rank").collect()] == [(3, 1), (2, 2)]


def test_a_block_is_met_in_strips():
    """Similarities of a whole block of queries are never held at once; a strip's border changes nothing."""
    import tracemalloc

    import pandas as pd

    from convan.operators.vectors import block_top_k

    rng = np.random.default_rng(6)
    rows = rng.normal(size=(2000, 8))
    left, right = pd.DataFrame({"query_id": range(2000), "q": list(rows)}), pd.DataFrame({"doc_id": range(2000), "c": list(rows)})
    tracemalloc.start()
    got = block_top_k(2)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 2000 * 8
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    sims = unit @ unit.T - 3 * np.eye(2000)
    assert len(got) == 4000 and (got["doc_id"].to_numpy().reshape(-1, 2)[:, 0] == sims.argmax(1)).all()

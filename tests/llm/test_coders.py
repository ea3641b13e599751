"""Piece encoding and packing against the libraries, over a whole table; classifiers' and sharding's defined cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from convan.llm import binpack, packing, pieces, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def test_pieces_equal_library_on_a_whole_table(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_ids, r.ids_crc32, r.round_trip) for r in queries.op2_pieces(spark, SF).collect()}
    ids = {i: np.array(model.encode(t), "<u4") for i, t in texts.items()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes()), True) for i, x in ids.items()}


def test_pair_tests_equal_merging():
    """A pair of pieces fits exactly if merging its letters gives it back."""
    coder = pieces.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    ids = np.array(list(coder.id_of.values()))
    pairs = [(-1, int(b)) for b in rng.choice(ids, 500)] + [(int(a), int(b)) for a, b in rng.choice(ids, (6000, 2))]
    short = [i for i in ids.tolist() if len(coder.text[i]) <= 2]
    pairs += [(int(a), int(b)) for a, b in rng.choice(short, (6000, 2))] + [(i, i) for i in short]
    got = coder.fits(np.array([(a + 1) * (1 << 32) + b for a, b in pairs]))
    want = [coder._merge(list("".join(coder.text[x] for x in p if x >= 0)), 1) == [coder.text[x] for x in p if x >= 0] for p in pairs]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_packing_equals_library_on_a_whole_table(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = {}
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k): (4096 * k, len(x := ids[4096 * k : 4096 * (k + 1)]), zlib.crc32(x.tobytes())) for k in range(-(-len(ids) // 4096))}
    got = queries.op10_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want) and any(k for _, k in want)


def test_packing_of_exact_lengths(spark):
    """4,095 words and the end fill a sequence; one more is cut; repeated rows are packed each."""
    rows = [(1, "the " * 4095), (2, "the " * 4096), (3, "the"), (3, "the"), (None, None)]
    got = sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect())
    assert got == [(0, 0, 0, 1), (1, 0, 0, 4096), (2, 0, 0, 4096), (2, 1, 4096, 1), (3, 0, 0, 2), (3, 0, 0, 2)]


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_take_any_labels(spark, operator, label):
    """Null and empty texts, repeated rows, an empty table, no labels, and labels of one kind: every row has a score of 0 to 1."""
    docs = spark.createDataFrame([(1, "some words here", 5), (1, "some words here", 5), (2, None, 6), (3, "", 7), (None, "x", 8)], "doc_id long, text string, score int")
    for labels in ([], [(1, 1), (2, 1)], [(1, None)], [(9, 0), (1, 1), (2, 0)]):
        given = spark.createDataFrame(labels, f"doc_id long, {label} int")
        model = operator.fit(docs, given)
        got = docs.select("doc_id", operator.score(docs, model).alias("s")).collect()
        assert len(got) == 5 and all(0 <= r.s <= 1 for r in got) and got[0].s == got[1].s
    assert docs.limit(0).select(operator.score(docs, model).alias("s")).count() == 0


def test_sharding_contract(spark, texts):
    got = queries.op5_shards(spark, SF).toPandas()
    size = {i: len(t.encode()) + 8 for i, t in texts.items()}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size and set(got.shard) == set(range(24)) and len(got) == len(size)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= 0.05 * loads.mean()
    assert all(zlib.crc32(texts[i].encode()) == c for i, c in zip(got.doc_id, got.text_crc32, strict=True))
    assert (got.assign(t=got.doc_id.map(texts)).groupby("t").shard.nunique() == 1).all()


def test_sharding_of_a_group_larger_than_a_shard(spark):
    """Two thirds of the bytes in copies of one text, and null ids: the group is dealt over shards, loads stay even."""
    rows = [(i, "same text again") for i in range(200)] + [(None, f"text {i:05d} of it") for i in range(100)]
    got = binpack.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(got) == 300 and len(loads) == 4 and loads.max() <= 1.15 * loads.mean()

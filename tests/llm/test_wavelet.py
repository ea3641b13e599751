"""Token files: against the library over a whole table, against plain scans, and defined cases."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from convan.llm import byte_tokens, queries, wavelet
from convan.llm.common import new_path

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts, plain=False):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = plain
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("plain", [False, True])
def test_parts_encode_as_whole_texts(plain):
    rng = np.random.default_rng(3)
    signs = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "Foo", "é", "É", "ö", "×", "÷", "'s", "'", "'ll", "!", "—", ",", "1", "23", "<|endoftext|>", "\xa0", " ", "　", "\x00", "\x1c", "\x85", "🙂", "漢字", "​", "_", "ª", "́"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 15))) for _ in range(20_000)] + ["", None, "x" * 100_000, " " * 100_000]
    ids, ends = byte_tokens.ByteCoder(PATH, plain).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == library(texts, plain)


def test_lookups_equal_scans():
    rng = np.random.default_rng(0)
    many = np.minimum(rng.pareto(0.6, 300_000) * 20, 50_000).astype("<u4")
    for tokens in (many, np.zeros(0, "<u4"), np.array([7], "<u4"), np.array([7, 7, 9], "<u4"), rng.integers(0, 3, wavelet.BLOCK + 1).astype("<u4")):
        blob = wavelet.build(tokens, [5, None], np.array([len(tokens), 0]))
        shard = wavelet.Shard(blob)
        assert shard.tokens().tolist() == tokens.tolist() and shard.documents() == [5, None] and shard.lengths.tolist() == [len(tokens), 0]
        assert all(shard.token(int(i)) == tokens[i] for i in rng.integers(0, max(len(tokens), 1), min(len(tokens), 200)))
        a, b = len(tokens) // 5, len(tokens) * 4 // 5
        for t in (0, 1, 7, 40, 50_000, 99_999):
            assert shard.find(t).tolist() == np.flatnonzero(tokens == t).tolist()
            assert shard.find(t, a, b).tolist() == (a + np.flatnonzero(tokens[a:b] == t)).tolist() and shard.count(t, a, b) == (tokens[a:b] == t).sum()
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else")


def test_blocks_of_any_size():
    """Blocks that compression leaves as long as they were are read as they are."""
    rng = np.random.default_rng(1)
    for n in range(1, 1500):
        tokens = rng.integers(0, rng.integers(1, 40), n).astype("<u4")
        assert (wavelet.Shard(wavelet.build(tokens, [1], np.array([n]))).tokens() == tokens).all()


def test_whole_table_equals_library(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    want, start = [], 0
    for (doc, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        data = np.array([*ids, 0], "<u4")
        want.append((doc, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    got = queries.op11_token_files(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, got.collect())) == want


def test_defined_cases(spark):
    """Null and empty texts, null and repeated ids, a text beyond a shard, other columns by clashing names; small shards; lookups in files."""
    rows = [(3, "a b a", 1), (1, None, 2), (3, "a b a", 3), (2, "", 4), (None, "c", 5), (4, "a " * 300, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3, "place")
    path = new_path(spark, "test-files")
    wavelet.write(docs, path, PATH, most=16)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens) for r in wavelet.read(spark, path).collect())
    assert got == [((False, 0), 0, 2), ((True, 1), 2, 1), ((True, 2), 3, 1), ((True, 3), 4, 4), ((True, 3), 8, 4), ((True, 4), 12, got[-1][2])]
    texts = dict((t, [*x, 0]) for (_, t, _), x in zip(rows, library([t for _, t, _ in rows]), strict=True))
    back = [np.frombuffer(r.ids, "<u4").tolist() for r in wavelet.read(spark, path, ids=True).orderBy("start").collect()]
    assert back == [texts[t] for t in ("c", None, "", "a b a", "a b a", "a " * 300)]
    flat = [(i, at, t) for i, ids in zip((None, 1, 2, 3, 3, 4), back, strict=True) for at, t in enumerate(ids)]
    token = texts["a b a"][2]
    assert sorted(map(repr, ((r.doc_id, r["at"]) for r in wavelet.occurrences(spark, path, token).collect()))) == sorted(repr((i, at)) for i, at, t in flat if t == token)
    assert {r.token: r.n for r in wavelet.count(spark, path, [token, 0, 49_999]).collect()} == {x: sum(t == x for _, _, t in flat) for x in (token, 0, 49_999)}


def test_empty_table(spark):
    path = new_path(spark, "test-files")
    wavelet.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert wavelet.read(spark, path).count() == 0

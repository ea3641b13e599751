"""Alignment of two tokenizers: against a plain scan of byte ranges with the libraries' own ids, and defined cases."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers

from convan.llm import alignment, queries
from convan.llm.alignment import overlaps
from convan.llm.byte_tokens import byte_alphabet

SF = "/root/testdata/sf0.01"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """{row number: (doc_id, ...)} by the libraries and by comparing byte ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, byte_of = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True
    size_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    size_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc, text in rows:
        links, groups, x, y = [], [], [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta, tb = [size_a(i) for i in x], [size_b(i) for i in y]
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                ends_a, ends_b = np.cumsum(list(map(len, ta))).tolist(), np.cumsum(list(map(len, tb))).tolist()
                j = 0
                for i, end in enumerate(ends_a):
                    start = end - len(ta[i])
                    while ends_b[j] <= start:
                        j += 1
                    k = j
                    while k < len(y) and ends_b[k] - len(tb[k]) < end:
                        links.append((x[i], y[k]))
                        k += 1
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append(f"{','.join(map(str, x[i:p]))}|{','.join(map(str, y[j:q]))}")
                    i, j = p, q
            else:
                x, y = [], []
        counts.update(set(links))
        found.append((doc, x, y, groups, links))
    top = {}
    for (one, _), n in counts.items():
        top[one] = max(top.get(one, 0), n)
    return [(doc, len(x), len(y), len(g), len(e), sum(counts[p] == top[p[0]] for p in e), sum(counts[p] for p in e), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for doc, x, y, g, e in found]


def test_overlaps_equal_a_scan_of_ranges():
    """Random ends, and pieces of the merge down to one end each."""
    rng = np.random.default_rng(0)
    for step in (1, 2, 3, 7, 1000):
        for _ in range(200):
            n = int(rng.integers(1, 60))
            a, b = (np.array(sorted({*rng.integers(1, n + 1, rng.integers(0, n + 1)).tolist(), n})) for _ in range(2))
            i, j, common = overlaps(a, b, step)
            begin_a, begin_b = np.append(0, a), np.append(0, b)
            want = [(p, q) for p in range(len(a)) for q in range(len(b)) if max(begin_a[p], begin_b[q]) < min(a[p], b[q])]
            assert list(zip(i.tolist(), j.tolist(), strict=True)) == want and common.tolist() == np.isin(a, b).tolist()
    assert [len(x) for x in overlaps(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


def test_pieces_have_equal_work():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 10**6, 70_000)), np.unique(rng.integers(0, 10**4, 5_000))
    at_a, at_b = alignment.diagonals(a, b, 1000)
    assert set(np.diff(at_a + at_b)[:-1].tolist()) == {1000} and (at_a[-1], at_b[-1]) == (len(a), len(b))
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    assert all(sum(k == 0 for _, k in merged[: i + j]) == i for i, j in list(zip(at_a.tolist(), at_b.tolist(), strict=True))[::8])


def test_whole_table_equals_brute_force(spark):
    import duckdb

    want = brute(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = queries.op12_alignment(spark, SF)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted(map(tuple, got.collect())) == sorted(want)


CASES = [(1, "plain words, twice: plain words"), (1, "plain words, twice: plain words"), (2, None), (3, ""), (4, "a▁b is no space"), (5, "<|endoftext|> and </s> <0x41> are text"), (None, " leading  runs \n\n of\tblanks "), (6, "\x00\x07 🙂漢字 é é"), (7, "antidisestablishmentarianism" * 3000), (8, " ")]


def test_defined_cases(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", 1) for r in CASES], "doc_id long, text string, block string, n_a int")
    for parts in (1, 3):
        got = alignment.align(docs.repartition(parts), A, B).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(CASES)))
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_groups(spark):
    """Groups put together give a text's ids and digest; their links are those of the byte ranges."""
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    want = {r[0]: r for r in brute(CASES)}
    rows = alignment.groups(docs.where("doc_id <> 1"), A, B).orderBy("doc_id", "group").collect()
    for doc in {r.doc_id for r in rows}:
        own = [r for r in rows if r.doc_id == doc]
        assert [r.group for r in own] == list(range(want[doc][3])) and sum(len(r.links) for r in own) == want[doc][4]
        assert hashlib.sha256(";".join(f"{','.join(map(str, r.a_ids))}|{','.join(map(str, r.b_ids))}" for r in own).encode()).hexdigest() == want[doc][7]
        assert all({x.a for x in r.links} == set(range(len(r.a_ids))) and {x.b for x in r.links} == set(range(len(r.b_ids))) for r in own)


def test_blocks_without_tokens(spark):
    rows = [(1, None), (2, ""), (3, "▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(docs, A, B).collect())) == brute(rows) and alignment.groups(docs, A, B).count() == 0

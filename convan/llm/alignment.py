"""Alignment of two tokenizers' tokens by merge-path partitioning, with corpus-wide counts of linked ids.

A text's tokens of either kind end at rising byte offsets; so do those of all texts of a block laid one after the other. The
two lists of ends are merged, and every distinct end closes a stretch of bytes that lies in one A and one B token: an
overlap. Merge path cuts the merge: on diagonal d, a binary search finds how many of its first d entries come from A (all
diagonals at a time), so pieces between neighbouring diagonals have the same number of ends and are merged on their own.
Pieces emit overlaps and common ends; where an A end closes a piece and the same B end opens the next, the piece that opens
with it has emitted an overlap too many, which stitching takes away before it cuts groups at common ends.

Counts: a block (about BLOCK bytes of texts, or one that is longer) writes each id pair that it links once, with the number of its documents
that link it, and per document references to these pairs. Pairs are summed by Spark over blocks, meet their A id's highest
count, go back to the blocks that asked for them, and each block adds up its documents. So what is shuffled are the distinct
pairs of blocks, not the links of documents, and a pair or an A id that nearly all documents hold has a row a block at most.

Defined cases: null and empty texts, and those whose tokens' bytes aren't a space and the text, have no tokens: zeros and an
empty digest; rows that repeat an id are documents of their own; texts of any length are aligned whole; an empty table gives
an empty one. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convan.llm import byte_tokens, pieces
from convan.llm.common import WordIds, runs_of_bytes, saved, spread

BLOCK = 4 << 20  # bytes of texts handled together
STEP = 1 << 16  # ends of a piece of the merge
CACHE_PARTS = 200_000  # parts with their ids that a worker keeps, of either tokenizer
PAIR_ROWS = 1 << 16  # id pairs of a block in one row
_WORKER: dict = {}


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many entries of a and of b the merge has taken at every step-th place, and at its end; equal entries of a come first."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        right = a[mid] <= b[d[open_] - mid - 1]
        low[open_[right]], high[open_[~right]] = mid[right] + 1, mid[~right]
    return low, d - low


def merged_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, ...]:
    """A piece's overlaps as (A token, B token): those closed by ends of A, then those closed by ends of B alone; and which of its A and B ends meet within it."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    below = np.searchsorted(own_b, own_a)  # B ends before each A end
    meet = np.flatnonzero(below < len(own_b))
    meet = meet[own_b[below[meet]] == own_a[meet]]
    alone = np.ones(len(own_b), bool)
    alone[below[meet]] = False
    lone = np.flatnonzero(alone)
    return i0 + np.arange(len(own_a)), j0 + below, i0 + np.searchsorted(own_a, own_b[lone]), j0 + lone, i0 + meet


def overlaps(a: np.ndarray, b: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps (A token, B token) of two lists of rising ends, in the order of the merge, and which A ends are ends of B too."""
    at_a, at_b = diagonals(a, b, step)
    found = [merged_piece(a, b, *at) for at in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:], strict=True)]
    common = np.zeros(len(a), bool)
    for k, (_, _, i, j, meet) in enumerate(found):
        common[meet] = True
        first = int(at_a[k]) - 1
        if first >= 0 and len(j) and j[0] == at_b[k] and a[first] == b[j[0]]:  # the end that closed the piece before
            common[first] = True
            found[k] = (*found[k][:2], i[1:], j[1:], meet)
    one = np.concatenate([x for f in found for x in (f[0], f[2])] or [np.zeros(0, np.int64)])
    two = np.concatenate([x for f in found for x in (f[1], f[3])] or [np.zeros(0, np.int64)])
    before = np.cumsum(common) - common  # groups closed before each A token
    order = np.empty(len(one), np.int64)
    order[one + two - (before[one] if len(a) else 0)] = np.arange(len(one))
    return one[order], two[order], common


@dataclass
class Aligned:
    """A block's texts that have tokens (`rows`), their tokens one after the other, and how these overlap."""

    rows: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    link_a: np.ndarray  # A token and B token of each overlap, numbered over the block
    link_b: np.ndarray
    common: np.ndarray  # which A tokens end a group


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_tokens.ByteCoder(path_a, plain=True, cache=CACHE_PARTS), pieces.PieceCoder(path_b)
        self.b.words = WordIds(self.b._new, CACHE_PARTS)
        bytes_a = self.a.token_bytes()
        bytes_b = [bytes([self.b.byte_of[i]]) if i in self.b.byte_of else t.replace(pieces.BLANK, " ").encode() for i, t in enumerate(self.b.text)]
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.size_a, self.size_b = (np.array(list(map(len, x))) for x in (bytes_a, bytes_b))
        # Ids in decimal, with what may follow them: inside a group, and at its end.
        self.shown = pa.array([f"{i}{after}" for n, ends in ((len(bytes_a), ",|"), (len(bytes_b), ",;")) for i in range(n) for after in ends], pa.large_string())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and how many each text has, the same of B."""
        ids_a, ends_a = self.a.encode(pc.binary_join_element_wise(" ", texts, ""))
        coded = self.b.encode(texts)
        return ids_a.astype(np.int64), np.diff(ends_a, prepend=0), np.frombuffer(b"".join(coded), "<u4").astype(np.int64), np.fromiter(map(len, coded), np.int64, len(coded)) // 4

    def align(self, texts: pa.Array) -> Aligned:
        rows = np.flatnonzero(np.asarray(pc.fill_null(pc.binary_length(texts), 0)) > 0)
        texts = texts.take(pa.array(rows))
        ids_a, n_a, ids_b, n_b = self.encode(texts)
        want, want_ends = self._joined(pc.cast(pc.binary_join_element_wise(" ", texts, ""), pa.large_binary()), np.arange(1, len(texts) + 1))
        same = np.ones(len(texts), bool)
        for ids, n, known in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            got, ends = self._joined(known.take(pa.array(ids)), np.cumsum(n))
            if got != want or not np.array_equal(ends, want_ends):
                same &= [got[a:b] == want[c:d] for a, b, c, d in zip([0, *ends], ends, [0, *want_ends], want_ends, strict=False)]
        if not same.all():
            rows, ids_a, ids_b, n_a, n_b = rows[same], ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)], n_a[same], n_b[same]
        return Aligned(rows, ids_a, ids_b, n_a, n_b, *overlaps(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])))

    @staticmethod
    def _joined(parts: pa.LargeBinaryArray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
        """The bytes of all parts, and where those of each run of parts end."""
        offsets = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1) if len(parts) else np.zeros(1, np.int64)
        return memoryview(parts.buffers()[2] or b"")[offsets[0] : offsets[-1]], (offsets[ends] - offsets[0]).tolist()

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each text's groups: ids of A, a bar, ids of B; groups are parted by semicolons."""
        last_a, group_a = x.common, np.cumsum(x.common) - x.common
        sizes_a = np.bincount(group_a, minlength=int(x.common.sum()))
        last_b = np.zeros(len(x.ids_b), bool)
        last_b[x.link_b[np.flatnonzero(np.append(x.link_a[1:] != x.link_a[:-1], True) & x.common[x.link_a])]] = True
        group_b = np.cumsum(last_b) - last_b
        sizes_b = np.bincount(group_b, minlength=len(sizes_a))
        out = np.empty(len(x.ids_a) + len(x.ids_b), np.int64)
        out[np.arange(len(x.ids_a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = 2 * x.ids_a + last_a
        out[np.arange(len(x.ids_b)) + np.cumsum(sizes_a)[group_b]] = 2 * (len(self.bytes_a) + x.ids_b) + last_b
        data, ends = self._joined(self.shown.take(pa.array(out)), np.cumsum(x.n_a + x.n_b))
        return [hashlib.sha256(data[a : b - 1]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _WORKER:
        _WORKER[path_a, path_b] = Aligner(path_a, path_b)
    return _WORKER[path_a, path_b]


def packed(values: np.ndarray) -> bytes:
    """Small unsigned numbers, compressed by byte planes."""
    x = values.astype("<u4")
    return pa.Codec("zstd", compression_level=1).compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data, 4 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_BLOCKS = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, n_refs array<long>, refs binary, times binary, first long, keys array<long>, in_docs array<long>"


def _blocks(path_a: str, path_b: str):
    """A row per block with its documents, and rows with the id pairs that they link: key (A id times B ids, plus B id) and documents."""
    schema = pa.schema([(c, {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[t]) for c, t in (x.rsplit(" ", 1) for x in _BLOCKS.split(", "))])

    def row(**given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([given.get(f.name)], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, k = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        n_b = len(own.bytes_b)
        for whole in batches:
            for at, to in runs_of_bytes(whole.column(1), BLOCK):
                x = own.align(whole.column(1)[at:to])
                docs = len(x.rows)
                of_a = np.repeat(np.arange(docs), x.n_a)
                pair = x.ids_a[x.link_a] * n_b + x.ids_b[x.link_b]
                top = len(own.bytes_a) * n_b
                linked = np.sort(of_a[x.link_a] * top + pair)  # documents number fewer than 2^31, pairs too
                new = np.flatnonzero(np.diff(linked, prepend=-1) != 0)
                times = np.diff(new, append=len(linked))
                doc, pair = np.divmod(linked[new], top)
                keys, refs, in_docs = np.unique(pair, return_inverse=True, return_counts=True)
                n_refs = np.bincount(doc, minlength=docs)
                # References rise within a document: differences are small.
                step = np.diff(refs, prepend=0)
                heads = (np.cumsum(n_refs) - n_refs)[n_refs > 0]
                step[heads] = refs[heads]
                full = np.zeros((5, to - at), np.int64)
                full[:, x.rows] = x.n_a, x.n_b, np.bincount(of_a[x.common], minlength=docs), np.bincount(of_a[x.link_a], minlength=docs), n_refs
                digests = [""] * (to - at)
                for r, digest in zip(x.rows.tolist(), own.digests(x), strict=True):
                    digests[r] = digest
                yield row(block=number + k, ids=whole.column(0)[at:to].to_pylist(), n_a=full[0], n_b=full[1], n_groups=full[2], n_links=full[3], digests=digests, n_refs=full[4], refs=packed(step), times=packed(times))
                for a in range(0, len(keys), PAIR_ROWS):
                    yield row(block=number + k, first=a, keys=keys[a : a + PAIR_ROWS], in_docs=in_docs[a : a + PAIR_ROWS])
                k += 1

    return run


def _summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A block's documents with the counts of their links; right has a row for each pair of the block."""
    out = []
    place = right["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = right["n"].to_numpy(), right["best"].to_numpy()
    for x in left.itertuples(index=False):
        n = np.asarray(x.n_refs)
        steps, times = unpacked(x.refs, n.sum()).astype(np.int64), unpacked(x.times, n.sum()).astype(np.int64)
        heads = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(n)), n)
        total = np.cumsum(steps)
        refs = total - (np.append(0, total)[heads])[doc] if len(steps) else steps
        sums = [np.append(0, np.cumsum(v[refs] * times)) for v in (best, count)]
        out.append(pd.DataFrame({"doc_id": pd.array(x.ids, "Int64"), "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links, **{name: s[heads + n] - s[heads] for name, s in zip(("n_best", "count_sum"), sums, strict=True)}, "groups_sha256": x.digests}))
    return pd.concat(out)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    blocks = saved(source.mapInArrow(_blocks(path_a, path_b), _BLOCKS), "blocks")
    asked = blocks.where("keys is not null").select("block", "first", F.posexplode(F.arrays_zip("keys", "in_docs")).alias("k", "p")).select("block", (F.col("first") + F.col("k")).alias("place"), F.col("p.keys").alias("pair"), F.col("p.in_docs").alias("n"))
    sums = asked.groupBy("pair").agg(F.sum("n").alias("n"))
    per_b = _pieces_of(path_b)
    # An A id links with at most all B ids, so its rows are bounded.
    highest = sums.groupBy(F.expr(f"pair div {per_b}").alias("a")).agg(F.max("n").alias("top"))
    counts = sums.withColumn("a", F.expr(f"pair div {per_b}")).join(highest.hint("shuffle_hash"), "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))
    back = saved(asked.drop("n").join(counts.hint("merge"), "pair").select("block", "place", "n", "best"), "pairs")
    lists = blocks.where("keys is null").drop("first", "keys", "in_docs")
    return lists.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _pieces_of(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with tokens and group: doc_id, group (from 0), a_ids, b_ids and the overlaps as places (a, b) in these lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for whole in batches:
            for at, to in runs_of_bytes(whole.column(1), BLOCK):
                x = own.align(whole.column(1)[at:to])
                cut = np.flatnonzero(x.common)  # every text ends a group
                of_link = np.searchsorted(cut, x.link_a)
                first_link = np.append(np.flatnonzero(np.diff(of_link, prepend=-1) != 0), len(of_link))
                ends_a, ends_b = cut + 1, x.link_b[first_link[1:] - 1] + 1
                starts_a, starts_b = np.append(0, ends_a)[:-1], np.append(0, ends_b)[:-1]
                doc = np.searchsorted(np.cumsum(x.n_a), cut, side="right")
                number = np.arange(len(cut)) - np.searchsorted(doc, doc)
                lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))
                links = pa.StructArray.from_arrays([pa.array(x.link_a - starts_a[of_link]), pa.array(x.link_b - starts_b[of_link])], names=["a", "b"])
                yield pa.RecordBatch.from_arrays([whole.column(0)[at:to].take(pa.array(x.rows[doc])), pa.array(number), lists(x.ids_a, ends_a), lists(x.ids_b, ends_b), lists(links, first_link[1:])], names=["doc_id", "group", "a_ids", "b_ids", "links"])

    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    return source.mapInArrow(run, "doc_id long, group long, a_ids array<long>, b_ids array<long>, links array<struct<a: long, b: long>>")

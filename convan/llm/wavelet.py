"""Token files: a wavelet matrix per shard, which gives token access, counting and occurrence lookup from one compressed file.

A shard's tokens are numbered by falling frequency (its own alphabet), so the upper bit-planes are nearly empty. Plane l holds
bit l of every token, most significant first, in the order that the planes above have left: tokens with a 0 there, then those
with a 1, each side in its old order. Planes are cut into blocks of BLOCK bits; a directory holds the number of ones before
each block (rank), and is searched for select. Blocks are compressed one by one, so a lookup opens a block a plane.

    file = MAGIC, 7 numbers (tokens, documents, symbols, levels, partition, place in the partition, length of the tables),
           tables (symbols, their counts, document ids, which of these are null, document lengths, zeros of each plane, ones before
           each block, length of each block), then the blocks

Documents are dealt by ranges of their id, so that the files' order is the documents' order; a task encodes its range and cuts it into
shards of at most SHARD tokens, or of one document that is longer. Spark's text sink commits each shard as a file of its
own, so a lost executor leaves none behind, and any file system that Spark writes can hold them.

Defined cases: null and empty texts are documents of the end id alone; rows with the same id follow each other in the
order in which the table is read; null ids come first; an empty table has no shard and reads back as an empty table; texts of any length are encoded whole.
Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convan.functions.scratch import running_sum
from convan.llm import byte_tokens
from convan.llm.common import runs_of_bytes, saved

MAGIC = b"CVWAVE1\n"
SHARD = 1 << 21  # tokens of a shard, unless one document has more
BLOCK = 1 << 16  # bits of a block
RANGE_BYTES = 64 << 20  # text of a range of documents, about
_HEAD = struct.Struct("<7Q")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_TABLES = (("symbols", "<u4"), ("counts", "<u8"), ("ids", "<i8"), ("nulls", "u1"), ("lengths", "<u8"), ("zeros", "<u8"), ("before", "<u8"), ("sizes", "<u4"))


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def build(tokens: np.ndarray, ids: list[int | None], lengths: np.ndarray, place: tuple[int, int] = (0, 0)) -> bytes:
    """The file of a shard: its tokens, and the ids and lengths of its documents in order."""
    table = np.bincount(tokens)  # as long as the vocabulary
    symbols = np.flatnonzero(table)
    symbols = symbols[np.lexsort((symbols, -table[symbols]))]
    kind = np.uint16 if len(symbols) <= 1 << 16 else np.uint32
    number = np.zeros(len(table), kind)
    number[symbols] = np.arange(len(symbols))
    codes = number[tokens]
    levels = max(1, int(max(len(symbols) - 1, 1)).bit_length()) if len(tokens) else 0
    codec, zeros, before, blocks = _codec(), [], [], []
    for level in range(levels):
        one = (codes & kind(1 << (levels - 1 - level))) != 0
        plane = np.packbits(one, bitorder="little")
        parts = [plane[a : a + BLOCK // 8] for a in range(0, len(plane), BLOCK // 8)]
        ones = [int(_ONES[p].sum()) for p in parts]
        before.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u8"))
        blocks += [min(raw, codec.compress(raw, asbytes=True), key=len) for raw in (p.tobytes() for p in parts)]
        zeros.append(len(codes) - int(one.sum()))
        codes = codes[np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])]
    null = np.array([i is None for i in ids], "u1")
    values = (symbols, table[symbols], np.array([i or 0 for i in ids], "<i8"), null, lengths, np.array(zeros), np.concatenate(before or [np.zeros(0)]), np.array([len(b) for b in blocks]))
    raw = b"".join(np.asarray(v).astype(t).tobytes() for v, (_, t) in zip(values, _TABLES, strict=True))
    tables = codec.compress(raw, asbytes=True)
    return b"".join([MAGIC, _HEAD.pack(len(tokens), len(ids), len(symbols), levels, *place, len(tables)), tables, *blocks])


class Shard:
    """A shard's file. `data` is its bytes, or a memory map of it: only the blocks that a lookup needs are read."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n, docs, symbols, self.levels, *self.place, size = _HEAD.unpack(view[8 : 8 + _HEAD.size])
        at = 8 + _HEAD.size
        self._per = -(-self.n // BLOCK)  # blocks of a plane
        counts = {"symbols": symbols, "counts": symbols, "ids": docs, "nulls": docs, "lengths": docs, "zeros": self.levels, "before": self.levels * (self._per + 1), "sizes": self.levels * self._per}
        raw = _codec().decompress(view[at : at + size], sum(np.dtype(t).itemsize * counts[k] for k, t in _TABLES), asbytes=True)
        offset = 0
        for name, kind in _TABLES:
            setattr(self, name, np.frombuffer(raw, kind, counts[name], offset))
            offset += np.dtype(kind).itemsize * counts[name]
        self.before = self.before.reshape(self.levels, self._per + 1).astype(np.int64)
        self._starts = at + size + np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self._view, self._blocks = view, lru_cache(256)(self._open)
        self._code = {int(s): k for k, s in enumerate(self.symbols)}
        self.ends = np.cumsum(self.lengths, dtype=np.int64)  # where each document's tokens end

    def _open(self, level: int, block: int) -> np.ndarray:
        k = level * self._per + block
        raw = self._view[self._starts[k] : self._starts[k + 1]]
        size = -(-min(BLOCK, self.n - block * BLOCK) // 8)
        return np.frombuffer(raw if len(raw) == size else _codec().decompress(raw, size, asbytes=True), np.uint8)

    def _bits(self, level: int, block: int) -> np.ndarray:
        return np.unpackbits(self._blocks(level, block), count=min(BLOCK, self.n - block * BLOCK), bitorder="little")

    def _bit(self, level: int, i: int) -> int:
        block, at = divmod(i, BLOCK)
        return int(self._blocks(level, block)[at >> 3] >> (at & 7)) & 1

    def _rank(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        block, at = divmod(i, BLOCK)
        if at == 0:
            return int(self.before[level, block])
        data = self._blocks(level, block)
        ones = int(_ONES[data[: at >> 3]].sum()) + (int(_ONES[data[at >> 3] & ((1 << (at & 7)) - 1)]) if at & 7 else 0)
        return int(self.before[level, block]) + ones

    def _select(self, level: int, bit: int, which: np.ndarray) -> np.ndarray:
        """The places of the ones (or zeros) number `which`, rising, of a plane."""
        before = self.before[level] if bit else np.minimum(np.arange(self._per + 1) * BLOCK, self.n) - self.before[level]
        block = np.searchsorted(before, which, side="right") - 1
        out = np.empty(len(which), np.int64)
        for b in np.unique(block).tolist():
            here = block == b
            out[here] = b * BLOCK + np.flatnonzero(self._bits(level, b) == bit)[which[here] - before[b]]
        return out

    def token(self, i: int) -> int:
        """The token at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            code = 2 * code + bit
        return int(self.symbols[code])

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token between two places lie below the last plane."""
        code = self._code.get(token)
        if code is None:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank(level, start), self._rank(level, end)
            one = (code >> (self.levels - 1 - level)) & 1
            start, end = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token occurs between two places."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def find(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """The places of a token between two places, rising."""
        a, b = self._range(token, start, self.n if end is None else end)
        at = np.arange(a, b)
        for level in reversed(range(self.levels) if b > a else ()):
            one = (self._code[token] >> (self.levels - 1 - level)) & 1
            at = self._select(level, one, at - int(self.zeros[level]) if one else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens: the planes are undone from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        codes = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            one = np.concatenate([self._bits(level, b) for b in range(self._per)]).astype(bool)
            back = np.empty_like(codes)
            zeros = int(self.zeros[level])
            back[np.flatnonzero(~one)], back[np.flatnonzero(one)] = codes[:zeros], codes[zeros:] | kind(1 << (self.levels - 1 - level))
            codes = back
        return self.symbols[codes] if self.n else np.zeros(0, "<u4")

    def documents(self) -> list[int | None]:
        return [None if null else i for i, null in zip(self.ids.tolist(), self.nulls.tolist(), strict=True)]


def _encoded_shards(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, coder = [TaskContext.get().partitionId(), 0], byte_tokens.coder(path)
        held, ids, lengths, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            blob = build(np.concatenate(held), ids, np.array(lengths), tuple(own))
            own[1] += 1
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["file"])

        for whole in batches:
            for a, b in runs_of_bytes(whole.column(1)):
                tokens, ends = coder.encode(whole.column(1)[a:b])
                tokens = np.insert(tokens, ends, end_id).astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                names, at = whole.column(0)[a:b].to_pylist(), 0
                while at < len(ends):  # as many documents as the shard still takes
                    begin = int(ends[at - 1]) if at else 0
                    to = int(np.searchsorted(ends, begin + most - size, side="right"))
                    if to <= at and size:
                        yield shard()
                        held, ids, lengths, size = [], [], [], 0
                        continue
                    to = max(to, at + 1)
                    held.append(tokens[begin : ends[to - 1]])
                    ids += names[at:to]
                    lengths += np.diff(ends[at:to], prepend=begin).tolist()
                    size += int(ends[to - 1]) - begin
                    at = to
        if size:
            yield shard()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", most: int = SHARD) -> None:
    """Token files of docs under path, in ascending order of their id."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    # The place in the table parts rows of one id, however many they are.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(ranges, "id", "place").sortWithinPartitions("id", "place").select("id", "text")
    files = dealt.mapInArrow(_encoded_shards(tokenizer_path, end_id, most), "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)  # bytes go through as they are


def _of_files(spark: SparkSession, path: str, run, schema: str) -> DataFrame:
    """What run(shard) gives as columns, for every file under path."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                if content.as_buffer() and len(content.as_buffer()):
                    yield pa.RecordBatch.from_arrays(run(Shard(content.as_buffer())), names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(each, schema)


def _place(shard: Shard, n: int) -> list[pa.Array]:
    return [pa.array(np.full(n, x, np.int64)) for x in shard.place]


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids as little-endian unsigned 32-bit numbers."""

    def run(shard: Shard) -> list[pa.Array]:
        data = memoryview(shard.tokens().astype("<u4").tobytes())
        bounds = list(zip((4 * (shard.ends - shard.lengths.astype(np.int64))).tolist(), (4 * shard.ends).tolist(), strict=True))
        out = [pa.array(shard.documents(), pa.int64()), pa.array(shard.ends - shard.lengths.astype(np.int64)), pa.array(shard.lengths.astype(np.int64)), pa.array([zlib.crc32(data[a:b]) for a, b in bounds], pa.int64())]
        return [*_place(shard, len(bounds)), *out, *([pa.array([data[a:b].tobytes() for a, b in bounds], pa.binary())] if ids else [])]

    found = saved(_of_files(spark, path, run, "range long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * ids), "token-files")
    sums = found.groupBy("range", "shard").agg(F.sum("n_tokens").alias("n"))
    # Files grow with the corpus, so their offsets are neither summed in one task nor broadcast. A shard's documents are at most its tokens.
    before = running_sum(sums, [F.col("range"), F.col("shard")], "n", "to").select("range", "shard", (F.col("to") - F.col("n")).alias("before"))
    return found.join(before.hint("shuffle_hash"), ["range", "shard"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def count(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the tokens occurs in all files, by ranks alone."""
    run = lambda shard: [pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())]
    return _of_files(spark, path, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, at (place in the document) of every occurrence of a token, by selects alone."""

    def run(shard: Shard) -> list[pa.Array]:
        at = shard.find(token)
        doc = np.searchsorted(shard.ends, at, side="right")
        names = pa.array(shard.documents(), pa.int64())
        return [names.take(pa.array(doc)), pa.array(at - (shard.ends - shard.lengths.astype(np.int64))[doc], pa.int64())]

    return _of_files(spark, path, run, "doc_id long, at long")

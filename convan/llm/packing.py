"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents are tokenised in the tasks and cut only if they are longer than a sequence. Items of one length can stand for
each other, so the packing itself needs only how many items have each length (at most `size` numbers): the driver runs
best-fit decreasing over that histogram. Sequences that look alike are kept as intervals of sequence numbers by what is
left in them; a segment tree over the `size` + 1 capacities finds the tightest open one in logarithmic time, and all
items of a length that go to an interval are placed at once, k = left // length in each sequence, just as one by one.
The outcome is a list of rules "items number x to y of length L go to sequences from s on, k in each, at offset o", which
follows the lengths, not the documents. Items get their number within their length in two steps (within a cell, plus the
cell's offset), so no task gets a whole length; a binary search finds their rule.

Defined cases: null and empty texts are documents without tokens, which still end in the end id; rows that repeat an id
are packed each; texts of any length are tokenised whole; an empty table packs into none. Only id and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convan.llm.common import runs_of_bytes, saved, spread

SIZE, END_ID = 4096, 1
CELL_ROWS = 100_000
_NO_BLANKS = re.compile("[\x1c-\x1f]")  # blanks for Arrow, not for the tokenizer
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Letters that one code point stands for in either case, then signs other than those of contractions and special tokens.
_PLAIN = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<signs>[!-&(-/:;=-@\[-`{-~]*)$"
CACHE_PARTS = 400_000  # words without their signs, and signs, whose ids a worker keeps
_WORKER: dict = {}


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins words across blanks, word by word.

    A plain word is its letters in lower case and the signs after them, which the tokenizer keeps apart too: two parts.
    Any other word is a part of its own. Each distinct part is encoded once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads that wait for work burn it
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_word_each(self, parts: list[str], group: int = 256) -> list[bytes]:
        """The ids of parts that are one word to the tokenizer: many are encoded as one text, and cut after each word's last token."""
        out = []
        for i in range(0, len(parts), group):
            own = parts[i : i + group]
            ids = np.array(self._encoded([" ".join(own)])[0], "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            whole = len(cuts) == len(own) + 1 and cuts[-1] == len(data)
            out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if whole else [np.array(x, "<u4").tobytes() for x in self._encoded(own)]
        return out

    def _of(self, parts: list[str], odd: np.ndarray) -> list[bytes]:
        """The ids of distinct parts; odd: whether one may be several words to the tokenizer."""
        found = list(map(self.known.get, parts))
        new = np.fromiter((x is None for x in found), bool, len(found))
        for at in (np.flatnonzero(new & ~odd).tolist(), np.flatnonzero(new & odd).tolist()):
            words = [parts[i] for i in at]
            ids = [np.array(x, "<u4").tobytes() for x in self._encoded(words)] if words and odd[at[0]] else self._one_word_each(words)
            for i, x in zip(at, ids, strict=True):
                found[i] = x
            self.known |= {w: x for w, x in zip(words, ids, strict=True) if len(w) <= 48}
        if len(self.known) > CACHE_PARTS:  # those in use now are likely to come again
            self.known = {"": b""} | {w: x for w, x in zip(parts, found, strict=True) if len(w) <= 48}
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end. Nulls have none."""
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
            lists = pa.array([_BLANKS.split(t) if _NO_BLANKS.search(t) else t.split() for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        plain = pc.extract_regex(coded.dictionary, _PLAIN)
        other = pc.is_null(plain)
        letters = pc.if_else(other, coded.dictionary, pc.utf8_lower(pc.struct_field(plain, "letters")))
        signs = pc.fill_null(pc.struct_field(plain, "signs"), "")
        both = pa.concat_arrays([letters, signs]).dictionary_encode()
        part = both.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T  # letters and signs of each distinct word
        odd = np.zeros(len(both.dictionary), bool)
        odd[part[other.to_numpy(zero_copy_only=False), 0]] = True
        ids = self._of(both.dictionary.to_numpy(zero_copy_only=False).tolist(), odd)
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        index = part[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        n = size[index]
        after = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(first[index] - after[:-1], n) + np.arange(after[-1])]
        return out, after[2 * np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = WordTokenizer(path)
        for whole in batches:
            for at, to in runs_of_bytes(whole.column(1)):
                batch = whole.slice(at, to - at)
                ids, ends = _WORKER[path].encode(batch.column(1))
                ids = np.insert(ids, ends, end_id).astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                n = np.diff(ends, prepend=0)
                count = -(-n // size)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(n[row] - start, size)
                begin = (ends - n)[row] + start
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


class OpenCapacities:
    """A segment tree over the capacities 0 to size: which of them have open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.open[i] += by
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least that many."""
        i = least + self.leaves
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:  # the right neighbour's side has one
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_rules(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length, first item, items a sequence, first sequence, offset), sorted, of best-fit decreasing."""
    tree, left = OpenCapacities(size), defaultdict(list)
    rules, sequences = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            left[capacity].append((first, n))
            tree.add(capacity, 1)

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        item, count = 0, histogram[length]
        while item < count:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, (first, n) = size, (sequences, -(-(count - item) // (size // length)))
                sequences += n
            else:
                first, n = left[capacity].pop()
                tree.add(capacity, -1)
            k = capacity // length
            whole = min(n, (count - item) // k)
            if whole:
                rules.append((length, item, k, first, size - capacity))
                put(capacity - k * length, first, whole)
                item += whole * k
            if whole < n and item < count:  # the last of this length, fewer than k
                rules.append((length, item, count - item, first + whole, size - capacity))
                put(capacity - (count - item) * length, first + whole, 1)
                whole += 1
                item = count
            put(capacity, first + whole, n - whole)
    return np.array(rules, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
    pieces = saved(source.mapInArrow(_pieces(tokenizer_path, size, end_id), "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    total = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most `size` rows
    rules = best_fit_rules(dict(zip(total["length"].tolist(), total["n"].tolist(), strict=True)), size)
    cells = max(16, round(total["n"].sum() / CELL_ROWS))
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    counts = pieces.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = pieces.withColumn("k", F.row_number().over(Window.partitionBy("length", "cell").orderBy("id", "piece", "ids_crc32"))).join(offsets.hint("merge"), ["length", "cell"])
    sent = spark.sparkContext.broadcast(rules)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        rules = sent.value
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        at = np.searchsorted(rules[:, 0] * -(1 << 40) + rules[:, 1], length * -(1 << 40) + number, side="right") - 1
        _, first, k, sequence, offset = rules[at].T
        return pd.DataFrame({"sequence_id": sequence + (number - first) // k, "offset": offset + (number - first) % k * length})

    out = numbered.withColumn("at", placed("length", F.col("before") + F.col("k") - 1))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")

"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch (a run of blanks and what follows it; no piece spans two) are concatenated, each once, and indexed
by a suffix array: suffixes are sorted by their letters, as many as the longest piece has. Every piece is looked up by binary search, all pieces
at a time, which gives the range of suffixes that begin with it, hence an edge (start, end, piece) for each occurrence.
The edges are sorted by their end and relaxed from left to right, all words of the batch at a time.

The model is a BPE model, so the best path is not the one with the largest sum of scores but the one that merging by score
would leave. That path can be relaxed too: the encoding of a prefix is unique, and a piece extends it exactly if merging
the two last pieces' letters again gives these two pieces, which undoing their merges tells, all pairs at a time. A word whose
path breaks (none is known) is merged directly. Letters that are no piece become byte pieces.

Defined cases: null texts have null ids; empty texts have none; repeated rows are encoded each; a text's blanks are kept
(the model doesn't normalise); the sign that the model uses for a blank decodes to a blank. Texts of any length are
encoded whole. Only the text is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from convan.llm.common import WordIds, runs_of_bytes

BLANK = "▁"
CACHE_WORDS = 400_000  # words with their ids that a worker keeps
LONG = 20_000  # letters of a word beyond which it is merged directly: the relaxation has a step for each letter of the longest word
LETTERS = 500_000  # of new words, indexed at once
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_WORKER: dict = {}


def packed_letters(ranks: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """For each position the `depth` letters from there on, 62 // bits of them a number: rows of numbers that compare as they do."""
    per = 62 // bits
    padded = np.concatenate([ranks, np.zeros(depth + per, np.int64)])
    out = np.zeros((-(-depth // per), len(ranks)), np.int64)
    for j in range(depth):
        out[j // per] |= padded[j : j + len(ranks)] << (bits * (per - 1 - j % per))
    return out


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Positions, ordered by the letters that begin there."""
    return np.lexsort(keys[::-1]).astype(np.int32)


def occurrences(keys: np.ndarray, order: np.ndarray, pieces: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (its packed letters, and which bits of them count) the range of the suffix array that begins with it."""

    def bound(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(pieces.shape[1], np.int64), np.full(pieces.shape[1], len(order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for key, piece, mask in zip(keys, pieces, masks, strict=True):
                found = key[at] & mask
                less |= equal & (found < piece)
                equal &= found == piece
            right = open_ & (less | (equal & after_equal))
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low

    return bound(False), bound(True)


class PieceCoder:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:  # a vocabulary file, installed on every machine
            model.ParseFromString(f.read())
        self.text = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
        self.id_of = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: model.pieces[i].score for i in normal}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type in (2, 3)}
        self.shown = ["" if i in self.hidden else t for i, t in enumerate(self.text)]
        self.is_byte = np.zeros(len(self.text), bool)
        self.is_byte[list(self.byte_of)] = True
        self.ids = np.array(normal, np.int64)
        self.sizes = np.array([len(self.text[i]) for i in normal])
        self.longest = int(self.sizes.max())
        self.codes = np.zeros((len(normal), self.longest), np.int64)
        for row, i in enumerate(normal):
            self.codes[row, : self.sizes[row]] = [ord(c) + 1 for c in self.text[i]]
        self.base = len(self.text)  # base + code point: a letter that is no piece
        self.words = WordIds(self._new, CACHE_WORDS)
        self._learn_splits()

    def _learn_splits(self) -> None:
        """Of which two pieces each piece is the merge, and in which order merges are taken."""
        n = len(self.text)
        self.rank = np.zeros(n + 1, np.int64)  # 0: letters, the last is any letter that is no piece
        merges = sorted((i for i in self.id_of.values() if len(self.text[i]) > 1), key=lambda i: -self.score[self.text[i]])
        self.rank[merges] = np.arange(1, len(merges) + 1)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.reached = np.ones(n + 1, bool)
        for i in merges:
            parts = self._merge(list(self.text[i]), 2)
            self.reached[i] = len(parts) == 2 and all(p in self.id_of for p in parts)
            if self.reached[i]:
                self.left[i], self.right[i] = (self.id_of[p] for p in parts)
        joins = {}
        for i in merges:
            t = self.text[i]
            for k in range(1, len(t)):
                if t[:k] in self.id_of and t[k:] in self.id_of:
                    joins[self.id_of[t[:k]] * (n + 1) + self.id_of[t[k:]]] = self.rank[i]
        self.join_key = np.array(sorted(joins), np.int64)
        self.join_rank = np.array([joins[x] for x in self.join_key.tolist()], np.int64)

    def _merge(self, parts: list[str], until: int) -> list[str]:
        """Merges the best adjacent pair, leftmost first, until none is a piece or so many parts are left."""
        while len(parts) > until:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging the letters of two tokens gives these tokens; pairs: first + 1 times 2^32, plus second; first -1 for none.

        The last merges on either side of the border are undone, latest first; the tokens stay if no two that meet at the
        border on the way would have been merged earlier than what was undone there."""
        n = len(self.text)
        a, b = (pairs >> 32) - 1, pairs & 0xFFFFFFFF
        ok = self.reached[np.minimum(b, n)]
        at = np.flatnonzero(ok & (a >= 0))
        one, two = np.minimum(a[at], n), np.minimum(b[at], n)
        limit = np.full(len(at), 1 << 40)
        while len(at):
            key = one * (n + 1) + two
            place = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            bad = (self.join_key[place] == key) & (self.join_rank[place] < limit)
            ok[at[bad]] = False
            first = self.rank[one] > self.rank[two]  # of equal pieces the right one was merged later
            go = ~bad & ((self.rank[one] > 0) | (self.rank[two] > 0))
            limit = np.where(first, self.rank[one], self.rank[two] + 1)
            one, two = np.where(first, self.right[one], one), np.where(first, two, self.left[two])
            at, one, two, limit = at[go], one[go], two[go], limit[go]
        return ok

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all words, where each word's begin, how many they are, and whether its path is whole."""
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size + 1) - size - 1
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        codes[begin + size] = 0  # between words
        alphabet, ranks = np.unique(codes, return_inverse=True)
        bits = int(len(alphabet)).bit_length()
        keys = packed_letters(ranks, self.longest, bits)
        order = suffix_array(keys)
        place = np.minimum(np.searchsorted(alphabet, self.codes), len(alphabet) - 1)
        here = (alphabet[place] == self.codes) | (self.codes == 0)  # other pieces have letters that don't occur
        sought = np.flatnonzero(here.all(1))
        inside = self.codes[sought] > 0
        # A piece's letters, and ones at their bits: packed_letters of rows that lie one after the other.
        flat = lambda x: packed_letters(x.ravel(), self.longest, bits)[:, :: self.longest]
        low, high = occurrences(keys, order, flat(np.where(inside, place[sought], 0)), flat(inside * ((1 << bits) - 1)))
        n = high - low
        which = np.repeat(np.arange(len(n), dtype=np.int32), n)
        start = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        length = self.sizes[sought].astype(np.int32)
        end, token = start + length[which], self.ids[sought].astype(np.int32)[which]
        single = np.zeros(len(codes), bool)
        single[start[length[which] == 1]] = True
        odd = np.flatnonzero(~single & (codes != 0)).astype(np.int32)
        start, end, token = np.concatenate([start, odd]), np.concatenate([end, odd + 1]), np.concatenate([token, (self.base + codes[odd] - 1).astype(np.int32)])
        depth = (end - np.repeat(begin, size + 1)[start]).astype(np.int16)
        order = np.argsort(depth, kind="stable")  # edges by the place in their word where they end
        start, end, token, depth = start[order], end[order], token[order], depth[order]
        last, back = np.full(len(codes) + 1, -2, np.int32), np.zeros(len(codes) + 1, np.int32)
        last[begin] = -1
        cuts = np.searchsorted(depth, np.arange(1, size.max(initial=0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, t = start[a:b], end[a:b], token[a:b]
            before = last[s]
            live = np.flatnonzero(before != -2)
            if not len(live):
                continue
            key, index = np.unique((before[live].astype(np.int64) + 1) * (1 << 32) + t[live], return_inverse=True)
            good = live[self.fits(key)[index]]
            last[e[good]], back[e[good]] = t[good], s[good]
        # Back from every word's end, all words a step at a time.
        word, at, steps = np.arange(len(words)), begin + size, []
        whole = np.ones(len(words), bool)
        while len(word):
            live = at > begin[word]
            word, at = word[live], at[live]
            t = last[at]
            whole[word[t < 0]] = False
            word, at, t = word[t >= 0], at[t >= 0], t[t >= 0]
            steps.append((word, at, t))
            at = back[at]
        word, at, t = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 3
        order = np.argsort(at, kind="stable")  # words lie one after the other
        counts = np.bincount(word, minlength=len(words))
        return t[order], np.cumsum(counts) - counts, counts, whole

    def _bytes(self, tokens: list[int]) -> bytes:
        ids = []
        for t in tokens:
            ids += [t] if t < self.base else [self.byte[x] for x in chr(t - self.base).encode("utf-8", "replace")]
        return np.array(ids, "<u4").tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        """The ids of words, each with its blanks."""
        out: list[bytes] = [b""] * len(words)
        part, letters = [], 0
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._bytes(self.merged_long(w))
            else:
                part.append(i)
                letters += len(w) + 1
            if part and (letters >= LETTERS or i == len(words) - 1):
                tokens, first, counts, whole = self.match([words[k] for k in part])
                data = memoryview(tokens.astype("<u4").tobytes())
                odd = np.zeros(len(part), bool)
                odd[np.repeat(np.arange(len(part)), counts)[tokens >= self.base]] = True
                for k, a, n, good, strange in zip(part, first.tolist(), counts.tolist(), whole.tolist(), odd.tolist(), strict=True):
                    out[k] = self._bytes(self.merged_long(words[k])) if not good else self._bytes(tokens[a : a + n].tolist()) if strange else bytes(data[4 * a : 4 * (a + n)])
                part, letters = [], 0
        return out

    def encode(self, texts: pa.Array) -> list[bytes | None]:
        """Ids as little-endian unsigned 32-bit numbers."""
        plain = pc.binary_join_element_wise("", pc.replace_substring(pc.fill_null(texts, ""), " ", BLANK), BLANK)
        # Cut before every blank that follows another letter; runs of blanks need a look at each text.
        if pc.any(pc.match_substring_regex(plain, f"^{BLANK}|{BLANK}{BLANK}")).as_py():
            lists = pa.array([_WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            body = pc.replace_substring(pc.fill_null(texts, ""), " ", BLANK)
            lists = pc.split_pattern(body, BLANK)
            words = pc.binary_join_element_wise(BLANK, lists.flatten(), "")
            lists = pa.ListArray.from_arrays(lists.offsets, words)
        ids, ends = self.words.batch(lists)
        data, ends = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist()
        return [None if null else bytes(data[a:b]) for null, a, b in zip(texts.is_null().to_pylist(), [0, *ends], ends, strict=False)]

    def merged_long(self, word: str) -> list[int]:
        """The encoding of a word by merging, for very long ones: a heap of candidate merges over a linked list."""
        import heapq

        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.id_of.get(p, self.base + ord(p[0])) for p in parts if p is not None]

    def decode(self, data: bytes | None) -> str | None:
        """The text of ids as encode() gives them; bytes that are no UTF-8 become the replacement sign."""
        if data is None:
            return None
        ids = np.frombuffer(data, "<u4")
        if not self.is_byte[ids].any():
            return self._plain("".join(map(self.shown.__getitem__, ids.tolist())))
        odd = self.is_byte[ids]
        cuts = np.flatnonzero(np.diff(odd, prepend=odd[0], append=odd[-1])).tolist()
        ids, raw, out = ids.tolist(), bool(odd[0]), []
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):  # runs of byte pieces, and what lies between
            out.append(bytes(map(self.byte_of.__getitem__, ids[a:b])).decode("utf-8", "replace") if raw else "".join(map(self.shown.__getitem__, ids[a:b])))
            raw = not raw
        return self._plain("".join(out))

    @staticmethod
    def _plain(joined: str) -> str:
        text = joined.replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def coder(path: str) -> PieceCoder:
    """The worker's coder of a model file."""
    if path not in _WORKER:
        _WORKER[path] = PieceCoder(path)
    return _WORKER[path]


def encode(text: Column, model_path: str) -> Column:
    """The ids of a text column, as binary little-endian unsigned 32-bit numbers."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = pa.array(batch, pa.string())
            yield pd.Series([x for at, to in runs_of_bytes(texts) for x in coder(model_path).encode(texts[at:to])], dtype=object)

    return run(text)


def decode(ids: Column, model_path: str) -> Column:
    """The text of a column of ids as encode() gives them."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([coder(model_path).decode(x) for x in batch], dtype=object)

    return run(ids)


def encode_and_decode(text: Column, model_path: str) -> Column:
    """A struct of encode()'s ids and of what decode() makes of them, by one worker."""

    @F.pandas_udf("ids binary, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = pa.array(batch, pa.string())
            ids = [x for at, to in runs_of_bytes(texts) for x in coder(model_path).encode(texts[at:to])]
            yield pd.DataFrame({"ids": ids, "text": [coder(model_path).decode(x) for x in ids]}, dtype=object)

    return run(text)

"""Ids of whole texts by a byte-level BPE tokenizer, part by part, and the bytes of its tokens.

The tokenizer cuts a text by a pattern before it merges, and looks back at nothing. So a text can be cut wherever that pattern
always ends a token: before white space that follows something else, and between a letter and an ASCII sign. Each distinct
part is encoded once by the library and kept (WordIds). Texts with white space beyond ASCII, whose runs the pattern splits in
other ways, and texts that hold a special token go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from convan.llm.common import WordIds

CACHE_PARTS = 800_000  # parts with their ids that a worker keeps
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_SIGN = np.zeros(256, bool)
for _lo, _hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _SIGN[_lo:_hi] = True
_LETTER = np.zeros(256, bool)
for _lo, _hi in ((65, 91), (97, 123)):
    _LETTER[_lo:_hi] = True
_OTHER_BLANKS = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_CODERS: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 signs for themselves, the others from U+0100 on in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteCoder:
    """Encoder of one tokenizer file; plain: the strings of special tokens are text like any other."""

    def __init__(self, path: str, plain: bool = False, cache: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = WordIds(self._new, cache)

    def _new(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id, from 0 on; special tokens stand for their strings."""
        byte_of, added = byte_alphabet(), {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = added[i].encode() if i in added else bytes(map(byte_of.__getitem__, token))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end. Nulls have none."""
        texts = pa.concat_arrays([pc.fill_null(texts, "")])  # without an offset
        whole = pc.match_substring_regex(texts, _OTHER_BLANKS)
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        blank, letter = _BLANK[data], _LETTER[data]
        # Latin letters of two bytes: C3, then anything but the signs of multiplication and division.
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (blank[1:] & ~blank[:-1]) | (letter[:-1] & _SIGN[data[1:]])
        for row in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            cut[offsets[row] : offsets[row + 1]] = False
        cut[offsets] = True
        bounds = np.flatnonzero(cut).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), texts.buffers()[2] or pa.py_buffer(b""))
        return self.words.batch(pa.ListArray.from_arrays(pa.array(np.searchsorted(bounds, offsets), pa.int32()), parts))


def coder(path: str, plain: bool = False) -> ByteCoder:
    """The worker's coder of a tokenizer file."""
    if (path, plain) not in _CODERS:
        _CODERS[path, plain] = ByteCoder(path, plain)
    return _CODERS[path, plain]

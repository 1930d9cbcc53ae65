"""Byte-level BPE ids of whole texts, many texts at a time.

The pre-tokenizer of a byte-level BPE never joins a space and the non-space before it, so ids of a text are
those of its units (a space and what follows up to the next space), one after another. That holds unless a space lies
between white space on both sides, where runs of white space are split by what follows; such texts go to the tokenizer
whole, and so do texts with the content of an added token. Units of plain characters are cut further, where letters, digits, punctuation and a single line's end meet.
Every id comes from the tokenizers library; a bounded table only saves asking again.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .segments import MOST_KEYS, SegmentTable, text_bytes

_ODD = re.compile(r"\s (?:\s|\Z)")
_encoders: dict[tuple[str, bool], "Encoder"] = {}
SPACE, LETTER, DIGIT, SIGN, BLANK, OTHER = range(6)


def _kinds() -> np.ndarray:
    """What each byte is: OTHER for all that a unit isn't cut at. The bytes of U+00C0 to U+023F count as letters (times and division signs are looked for apart)."""
    out = np.full(256, OTHER, np.uint8)
    for members, kind in ((b" ", SPACE), (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER), (b"0123456789", DIGIT), (b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", SIGN), (b"\t\n\v\f\r", BLANK), (range(0x80, 0xC0), LETTER), (range(0xC3, 0xC9), LETTER)):
        out[list(members)] = kind
    return out


_KIND = _kinds()


class Encoder:
    def __init__(self, path: str, literal: bool = True, most: int = MOST_KEYS):
        """literal: the content of an added token is text like any other; else it is that token, as at the library's defaults."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = SegmentTable(self.ask, most)

    def ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, column, data: np.ndarray, bounds: np.ndarray) -> list[int]:
        """The texts that can't be cut: first those that might be by their bytes, then those that are."""
        import pyarrow.compute as pc

        blank = (data <= 32) | (data >= 0x7F)
        (at,) = np.nonzero((data[1:] == 32) & blank[:-1])
        at += 1
        follows = np.append(blank, True)[at + 1] | np.isin(at + 1, bounds)
        maybe = np.unique(np.searchsorted(bounds, at[follows], side="right") - 1)
        out = {int(k) for k in maybe if _ODD.search(column[int(k)].as_py())}
        for content in self.added:
            out.update(np.nonzero(pc.match_substring(column, content).to_numpy(zero_copy_only=False))[0].tolist())
        return sorted(out)

    def segments(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of a column's texts, the bounds of the texts, and where segments begin that can be encoded by themselves."""
        data, bounds = text_bytes(column)
        n = len(data)
        if not n:
            return data, bounds, np.empty(0, np.int64)
        kind = _KIND[data]
        unit = kind == SPACE
        unit[bounds[:-1][np.diff(bounds) > 0]] = True
        begins = unit.copy()
        begins[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        odd = kind == OTHER
        odd[1:] |= (kind[1:] == BLANK) & ((kind[:-1] == BLANK) | (kind[:-1] == SPACE))
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        (odd,) = np.nonzero(odd)
        if len(odd):  # units with anything else stay whole
            (starts,) = np.nonzero(unit)
            held = np.zeros(len(starts) + 1, bool)
            held[np.searchsorted(starts, odd, side="right") - 1] = True
            (at,) = np.nonzero(begins)
            begins[at[held[np.searchsorted(starts, at, side="right") - 1] & ~unit[at]]] = False
        for k in self._whole(column, data, bounds):
            begins[bounds[k] + 1 : bounds[k + 1]] = False
        return data, bounds, np.nonzero(begins)[0]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow column's texts (null: empty), one after another, and the bounds of each text's (one more than there are)."""
        import pyarrow.compute as pc

        data, bounds, starts = self.segments(pc.fill_null(column, ""))
        ids, counts = self.table.look_up(data, starts, np.diff(np.append(starts, len(data))))
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, bounds)]

    def encode_with_end(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with end_id after each text's ids."""
        ids, bounds = self.encode(column)
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


def encoder(path: str, literal: bool = True) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if (path, literal) not in _encoders:
        _encoders[path, literal] = Encoder(path, literal)
    return _encoders[path, literal]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Run-length bytes of whole numbers, for many rows at once, and steps from place to place: array operations, no loop over values."""

from __future__ import annotations

import numpy as np

#: Fixed values of the format. A lead byte of 1 to 100 is a run of so many zeros.
PLUS_BYTE = 101  # a value from 75 to 255, in the next byte
MINUS_BYTE = 102  # a value from -255 to -74, its size in the next byte
PLUS_SHORT = 103  # a value to 65535, in the next two bytes
MINUS_SHORT = 104  # a value to -65535, its size in the next two bytes
ZEROS_BYTE = 105  # a run of 101 to 255 zeros, its length in the next byte
ZEROS_SHORT = 106  # a run of 256 to 65535 zeros, its length in the next two bytes
LITERAL = 180  # a value from -73 to 74 is the byte 180 higher
WIDE = 255  # any other value, in the next four bytes
MOST_ZEROS, SMALL, LARGE = 65535, -73, 74
#: How many bytes follow each lead byte.
FOLLOW = np.zeros(256, np.int64)
FOLLOW[[PLUS_BYTE, MINUS_BYTE, ZEROS_BYTE]] = 1
FOLLOW[[PLUS_SHORT, MINUS_SHORT, ZEROS_SHORT]] = 2
FOLLOW[WIDE] = 4


def follow(jump: np.ndarray, start: int = 0) -> np.ndarray:
    """The places start, jump[start], jump[jump[start]], ... below len(jump), where jump is larger than the place: each round doubles how many are known."""
    n = len(jump)
    if start >= n:
        return np.empty(0, np.int64)
    ahead, at = np.append(np.minimum(jump, n), n), np.array([start])
    while True:
        more = ahead[at]
        at = np.concatenate([at, more])
        if more[-1] >= n:
            return at[at < n]
        ahead = ahead[ahead]


def run_bytes(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows of whole numbers, one after another, and their bounds by row; bounds has those of the rows in values. Runs end with their row."""
    v = np.asarray(values, np.int64)
    if not len(v):
        return np.empty(0, np.uint8), np.zeros(len(bounds), np.int64)
    if np.abs(v).max() >= 1 << 31:
        raise ValueError("a value passes 32 bits")
    begins = v != 0
    begins[1:] |= v[:-1] != 0
    begins[bounds[:-1][bounds[:-1] < len(v)]] = True
    (starts,) = np.nonzero(begins)
    lengths = np.diff(np.append(starts, len(v)))
    parts = np.where(v[starts] == 0, (lengths - 1) // MOST_ZEROS + 1, 1)  # longer runs are several
    of = np.repeat(np.arange(len(starts)), parts)
    part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    value = v[starts[of]]
    run, size = np.where(value == 0, np.minimum(lengths[of] - part * MOST_ZEROS, MOST_ZEROS), 0), np.abs(value)
    up = value > 0
    lead = np.select(
        [run > 255, run > 100, run > 0, (value >= SMALL) & (value <= LARGE), size < 256, size < 65536],
        [ZEROS_SHORT, ZEROS_BYTE, run, value + LITERAL, np.where(up, PLUS_BYTE, MINUS_BYTE), np.where(up, PLUS_SHORT, MINUS_SHORT)],
        WIDE,
    )
    told = np.where(run > 0, run, np.where(lead == WIDE, value, size))
    width = FOLLOW[lead]
    ends = np.cumsum(1 + width)
    at = ends - 1 - width
    out = np.zeros(ends[-1], np.uint8)
    out[at] = lead
    for w in (1, 2, 4):
        (rows,) = np.nonzero(width == w)
        for k in range(w):
            out[at[rows] + 1 + k] = told[rows] >> 8 * (w - 1 - k) & 255
    firsts = np.searchsorted(starts[of], bounds)  # tokens before each row
    return out, np.append(0, ends)[firsts]


def run_values(data: np.ndarray) -> np.ndarray:
    """The whole numbers of run-length bytes. Raises ValueError where they end within a value."""
    raw = np.asarray(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    at = follow(np.arange(1, len(raw) + 1) + FOLLOW[raw])
    lead = raw[at].astype(np.int64)
    width = FOLLOW[lead]
    if at[-1] + width[-1] >= len(raw):
        raise ValueError("run-length bytes are cut short")
    told = np.zeros(len(at), np.int64)
    for w in (1, 2, 4):
        (rows,) = np.nonzero(width == w)
        for k in range(w):
            told[rows] = told[rows] << 8 | raw[at[rows] + 1 + k]
    told = np.where(lead == WIDE, told.astype(np.uint32).astype(np.int32), told)
    zeros = (lead <= 100) | (lead == ZEROS_BYTE) | (lead == ZEROS_SHORT)
    value = np.select([zeros, width == 0, (lead == MINUS_BYTE) | (lead == MINUS_SHORT)], [0, lead - LITERAL, -told], told)
    return np.repeat(value, np.where(zeros, np.where(width > 0, told, lead), 1))

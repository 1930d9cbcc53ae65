"""A table from short runs of bytes to runs of ids (or of ids with what else belongs to them), looked up many at a time with array operations.

A key is up to KEY_BYTES bytes and its length, held in four 64-bit words and compared in full, so that a lookup is exact. What the table lacks is asked for
once a batch, all of it together; it is kept while there is room, and forgotten after the batch once there is none. Results never depend on what is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: The longest key kept, and how many keys: about 24 + 32 bytes each with their ids, and 16 bytes a slot.
KEY_BYTES, MOST_KEYS = 31, 1_500_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: By the bytes of a word that count: a mask of them.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings without nulls, one after another, and the bounds of each (one more than there are)."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


class SegmentTable:
    def __init__(self, ask: Callable[[list[str]], list[list[int]]], most: int = MOST_KEYS, kind=np.uint32):
        """ask: the ids of each of a list of segments, as numbers of a kind."""
        self.ask, self.most, self.n, self.used = ask, most, 0, 0
        self.bits = max(8, (2 * most).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((1024, 4), np.uint64)
        self.begins, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, kind)

    def _keys(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(KEY_BYTES + 1, np.uint8)])
        words = np.ndarray((len(data) + KEY_BYTES - 6,), "<u8", padded, 0, (1,))
        keys = np.zeros((len(starts), 4), np.uint64)
        for k in range(4):
            (some,) = np.nonzero(lengths > 8 * k) if k else (slice(None),)
            keys[some, k] = words[starts[some] + 8 * k] & _MASKS[np.minimum(lengths[some] - 8 * k, 8)]
        keys[:, 3] |= np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56)
        return keys

    def _first_slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys * _MIX).sum(1, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX[1]
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        entries = np.full(len(keys), -1, np.int64)
        at, slot = np.arange(len(keys)), self._first_slots(keys)
        while len(at):
            e = self.slots[slot]
            same = (e >= 0) & (self.keys[e] == keys[at]).all(1)
            entries[at[same]] = e[same]
            on = (e >= 0) & ~same
            at, slot = at[on], (slot[on] + 1) & (len(self.slots) - 1)
        return entries

    def _put(self, keys: np.ndarray, first: int) -> None:
        """Gives distinct new keys the entries from first on."""
        at, slot = np.arange(len(keys)), self._first_slots(keys)
        while len(at):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = first + at[free]  # of several for one slot the last stays
            on = self.slots[slot] != first + at
            at, slot = at[on], (slot[on] + 1) & (len(self.slots) - 1)

    def _room(self, entries: int, ids: int) -> None:
        while len(self.begins) < entries:
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
            self.begins, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.counts))
        while len(self.ids) < ids:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def look_up(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments, one after another, and how many each has."""
        if not len(starts):
            return np.empty(0, self.ids.dtype), np.empty(0, np.int64)
        keys = self._keys(data, starts, lengths)
        short = lengths <= KEY_BYTES
        entries = np.full(len(starts), -1, np.int64)
        entries[short] = self._find(keys[short])
        (lacking,) = np.nonzero(entries < 0)
        if len(lacking):
            order = lacking[np.argsort(~short[lacking], kind="stable")]  # those that can be kept come first
            seen: dict[bytes, int] = {}
            raw, own, at = data.tobytes(), [], []
            for k, a, n in zip(order.tolist(), starts[order].tolist(), lengths[order].tolist()):
                said = raw[a : a + n]
                if said not in seen:
                    seen[said] = len(own)
                    own.append(k)
                at.append(seen[said])
            got = self.ask([s.decode() for s in seen])
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for x in got for i in x), self.ids.dtype, int(sizes.sum()))
            self._room(self.n + len(got), self.used + len(flat))
            self.ids[self.used : self.used + len(flat)] = flat
            self.begins[self.n : self.n + len(got)] = self.used + np.cumsum(sizes) - sizes
            self.counts[self.n : self.n + len(got)] = sizes
            entries[order] = self.n + np.array(at)
            kept = min(int(short[own].sum()), self.most - self.n)
            if kept > 0:
                self.keys[self.n : self.n + kept] = keys[own[:kept]]
                self._put(keys[own[:kept]], self.n)
                self.n, self.used = self.n + kept, self.used + int(sizes[:kept].sum())
        counts = self.counts[entries]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.begins[entries] - (ends - counts), counts) + np.arange(ends[-1])], counts

"""Operator 3: packing of token sequences into windows by minimum bin slack.

Each window takes the longest piece left and the multiset of other lengths that comes closest to filling the rest, found by a
subset-sum dynamic programme over bitsets (bit s of a layer: sum s can be reached) and read back from the layers as counts per length. The same multiset is
used for as many windows as the counts allow. What no multiset fills, a cut of another piece fills.

Windows are packed within groups of consecutive documents of a task, bounded in ids; only a group's last window can have padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import deque

from pyspark.sql import DataFrame, SparkSession

from . import common
from .token_ids import encoder, vocabulary

#: Ids of the documents packed together: 16 MB in a worker.
GROUP_IDS = 4_000_000
CAPACITY = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length come closest to room from below. lengths: ascending, those that counts has.

    Longest lengths first; copies of a length go in as layers of 1, 2, 4, ... at once; it stops when room itself is reached.
    """
    reach, mask, layers = 1, (2 << room) - 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            layers.append((reach, length, take))
            reach |= (reach << length * take) & mask
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length) that hold each id of documents of the given sizes once."""
    out, pieces = [], {}
    for doc, size in enumerate(sizes):
        full = size // capacity * capacity
        out += [[(doc, at, capacity)] for at in range(0, full, capacity)]
        if size > full:
            pieces.setdefault(size - full, deque()).append((doc, full))
    lengths, counts = sorted(pieces), {k: len(v) for k, v in pieces.items()}

    def take(length: int) -> tuple[int, int, int]:
        doc, start = pieces[length].popleft()
        counts[length] -= 1
        if not counts[length]:
            del counts[length], pieces[length]
            lengths.remove(length)
        return doc, start, length

    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        used = best_fill(lengths, counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        room = capacity - sum(k * n for k, n in used.items())
        # a window that needs no cut may be made again as long as the counts last
        times = 1 if room else min(counts[k] // n for k, n in used.items())
        for _ in range(times):
            window = [take(k) for k in sorted(used, reverse=True) for _ in range(used[k])]
            if room and lengths:  # any piece left is longer than the room, or it would have been used
                doc, start, length = take(lengths[-1])
                window.append((doc, start, room))
                rest = length - room
                if rest not in pieces:
                    insort(lengths, rest)
                pieces.setdefault(rest, deque()).append((doc, start + room))
                counts[rest] = counts.get(rest, 0) + 1
            out.append(window)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the documents' ids (text, then end_id; null text: empty) and their places in windows of capacity ids.

    One pass without a shuffle: a task encodes, packs and forgets a group at a time. Repeated rows, null ids and ids that clash are documents
    of their own; an empty table gives no rows. sequence_id is the task's number and a running number.
    """

    common.prepare(docs.sparkSession)

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer, literal=False)
        sequence = TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def packed(ids, doc_ids):
            nonlocal sequence
            columns = [[] for _ in names]
            for window in windows(list(map(len, ids)), capacity):
                offset = 0
                for doc, start, length in window:
                    row = (doc_ids[doc], start, length, zlib.crc32(ids[doc][start : start + length]), len(ids[doc]), sequence, offset)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        ids, doc_ids, n = [], [], 0
        for batch in common.short(batches):
            got, bounds = enc.encode_with_end(batch.column(1), end_id)
            got, bounds = got.astype("<u4", copy=False), bounds.tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                ids.append(got[a:b])
                doc_ids.append(doc_id)
                n += b - a
                if n >= GROUP_IDS:
                    yield packed(ids, doc_ids)
                    ids, doc_ids, n = [], [], 0
        if ids:
            yield packed(ids, doc_ids)

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    common.prepare(spark)
    return pack_documents(common.table(spark, sf_dir, "documents"), vocabulary(), 1)

"""Operator 1: token ids in word-aligned Simple-8b files.

A 64-bit word has a 4-bit selector in its top bits and 60 bits of payload, lowest value first. Selectors 1 to 14 pack
60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values. Selector 0 is an escape: its payload is an index into the block's list of
values of 2^60 and more. Blocks of 1024 values are packed by themselves, greedily, and a block index gives each block's first word
and first escape, so any range of blocks is decoded at once with array operations and any document is reached without reading others.

File: magic, words of all blocks, then the footer (block words, block escapes, escapes, document ids, document ends) and its sizes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_ids import encoder, vocabulary

#: Fixed values of the format: how many values a word of selector 1, 2, ... has, and how wide each is.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 1024
MAGIC = b"SW8BLK01"
#: Blocks encoded or decoded at once.
STRIDE = 1024
#: A part of the corpus goes on in a new file after so many documents or ids, so that an index stays small for writer and reader.
FILE_DOCS, FILE_IDS = 500_000, 1 << 28
_N = np.array((1, *COUNTS, 1), np.int64)
_TAIL = struct.Struct("<QQQQ8s")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """uint64 values -> words, words of each block, escaped values, escapes of each block."""
    n, nb = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    # a block a row, padded by the most values a word holds; zeros there fit any selector, so a block's last word may be part empty
    grid = np.zeros((nb, BLOCK + 60), np.uint64)
    full = n // BLOCK
    grid[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    if full < nb:
        grid[full, : n - full * BLOCK] = ids[full * BLOCK :]
    flat, ends = grid.ravel(), np.arange(nb) * grid.shape[1] + np.minimum(n - np.arange(nb) * BLOCK, BLOCK)
    # the narrowest selector that fits each value, then the widest that a run of values needs, for runs of each length that a selector has
    limits = np.array([1 << w for w in WIDTHS], np.uint64)
    if flat.max() < 1 << 16:
        wide = {1: np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)[flat.astype(np.uint16)]}
    else:
        wide = {1: np.searchsorted(limits, flat, side="right").astype(np.uint8)}
    selector = np.where(wide[1] < len(WIDTHS), np.uint8(14), np.uint8(0))
    for m, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 12, 8), (30, 15, 15), (60, 30, 30)):
        wide[m] = np.maximum(wide[a][: len(wide[b]) - (m - b)], wide[b][m - b :])
        s = COUNTS.index(m)
        fits = wide[m] <= s
        np.copyto(selector[: len(fits)], np.uint8(s + 1), where=fits)
    step = _N.astype(np.int64)[selector]
    at, stop, seen = np.arange(nb) * grid.shape[1], ends, []
    while len(at):
        seen.append(at)
        at = at + step[at]
        more = at < stop
        if not more.all():
            at, stop = at[more], stop[more]
    at = np.sort(np.concatenate(seen))
    sel, row = selector[at], at // grid.shape[1]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel[sel > 0]):
        (w,) = np.nonzero(sel == s)
        first = at[w]
        payload = flat[first]
        for j in range(1, COUNTS[s - 1]):
            payload |= flat[first + j] << np.uint64(j * WIDTHS[s - 1])
        words[w] |= payload
    (w,) = np.nonzero(sel == 0)
    n_escapes = np.bincount(row[w], minlength=nb)
    first = np.cumsum(n_escapes) - n_escapes
    words[w] |= (np.arange(len(w)) - first[row[w]]).astype(np.uint64)
    return words, np.bincount(row, minlength=nb), flat[at[w]], n_escapes


def unpack(words: np.ndarray, block_words: np.ndarray, sizes: np.ndarray, escapes: np.ndarray, n_escapes: np.ndarray) -> np.ndarray:
    """The values of consecutive blocks, decoded together."""
    nb = len(block_words)
    sel = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    n, row = _N[sel], np.repeat(np.arange(nb), block_words)
    end = np.cumsum(n)
    start = end - n
    first = np.cumsum(block_words) - block_words
    pos = start - start[first][row] if nb else start
    out = np.zeros((nb, BLOCK + 60), np.uint64)
    for s in np.unique(sel):
        (w,) = np.nonzero(sel == s)
        if s == 0:
            out[row[w], pos[w]] = escapes[(np.cumsum(n_escapes) - n_escapes)[row[w]] + payload[w].astype(np.int64)]
            continue
        mask = np.uint64((1 << WIDTHS[s - 1]) - 1)
        for j in range(COUNTS[s - 1]):
            out[row[w], pos[w] + j] = (payload[w] >> np.uint64(j * WIDTHS[s - 1])) & mask
    return out[:, :BLOCK][np.arange(BLOCK) < sizes[:, None]]


class Writer:
    """Writes documents one after another; keeps a block index and 16 bytes a document until closed."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.pending, self.n_pending, self.n, self.docs = [], 0, 0, 0
        self.block_words, self.block_escapes, self.escapes, self.doc_ids, self.ends = [], [], [], [], []

    def add(self, doc_ids, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents of the given ids (None: null), whose values lie between the bounds (one more than there are documents)."""
        self.doc_ids.append(np.array([-(1 << 63) if d is None else d for d in doc_ids], np.int64))
        self.ends.append(self.n + (bounds[1:] - bounds[0]).astype(np.int64))
        self.n, self.docs = self.n + len(ids), self.docs + len(doc_ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= STRIDE * BLOCK:
            self._flush(self.n_pending // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending).astype(np.uint64) if self.pending else np.empty(0, np.uint64)
        for a in range(0, n, STRIDE * BLOCK):
            words, counts, escapes, n_escapes = pack(ids[a : min(n, a + STRIDE * BLOCK)])
            self.out.write(words.astype("<u8").tobytes())
            self.block_words.append(counts)
            self.block_escapes.append(n_escapes)
            self.escapes.append(escapes)
        self.pending, self.n_pending = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_pending)
        parts = [np.concatenate([np.empty(0, np.int64), *x]) for x in (self.block_words, self.block_escapes)]
        escapes = np.concatenate([np.empty(0, np.uint64), *self.escapes])
        doc_ids, ends = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.doc_ids, self.ends))
        for a, kind in ((parts[0], "<u2"), (parts[1], "<u2"), (escapes, "<u8"), (doc_ids, "<i8"), (ends, "<i8")):
            self.out.write(a.astype(kind).tobytes())
        self.out.write(_TAIL.pack(self.n, len(parts[0]), len(escapes), self.docs, MAGIC))
        self.out.close()


class Reader:
    """Random access to a file's documents."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.n, nb, ne, nd, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} isn't a file of token ids")
        lengths = [2 * nb, 2 * nb, 8 * ne, 8 * nd, 8 * nd]
        at = size - _TAIL.size - sum(lengths)
        raw = self.file.read_at(sum(lengths), at)
        cuts = np.cumsum([0, *lengths])
        words, n_escapes, self.escapes, self.doc_ids, self.ends = (np.frombuffer(raw[cuts[i] : cuts[i + 1]], k) for i, k in enumerate(("<u2", "<u2", "<u8", "<i8", "<i8")))
        self.block_words, self.block_escapes = words.astype(np.int64), n_escapes.astype(np.int64)
        self.first_word = np.concatenate([[0], np.cumsum(self.block_words)])
        self.first_escape = np.concatenate([[0], np.cumsum(self.block_escapes)])

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The values of blocks a to b."""
        at, n = self.first_word[a], self.first_word[b] - self.first_word[a]
        words = np.frombuffer(self.file.read_at(int(8 * n), int(len(MAGIC) + 8 * at)), "<u8")
        sizes = np.minimum(self.n - np.arange(a, b) * BLOCK, BLOCK)
        return unpack(words, self.block_words[a:b], sizes, self.escapes[self.first_escape[a] : self.first_escape[b]], self.block_escapes[a:b])

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document, from its own blocks only."""
        start, end = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        if start == end:
            return np.empty(0, np.uint64)
        a = start // BLOCK
        return self.blocks(a, (end - 1) // BLOCK + 1)[start - a * BLOCK : end - a * BLOCK]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the file and ids of each document, decoding a stretch of blocks at a time."""
        have, base, block, start = np.empty(0, np.uint64), 0, 0, 0
        for doc_id, end in zip(self.doc_ids.tolist(), self.ends.tolist()):
            while base + len(have) < end:
                stop = min(block + STRIDE, len(self.block_words))
                have, base, block = np.concatenate([have[start - base :], self.blocks(block, stop)]), start, stop
            yield (None if doc_id == -(1 << 63) else doc_id), start, have[start - base : end - base]
            start = end


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, file_docs: int = FILE_DOCS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes the texts (null: empty), adds end_id, and writes files in ascending (doc_id, text) order.

    Documents are dealt by stretches of doc_id, a file each or several where it grows long, so files follow one another in order of (part, number) and no task needs more
    than its own stretches. Each attempt writes its own files and only those named in the returned manifest (part, number, uri, n_docs, n_ids) count, so a lost or repeated
    task leaves no trace in the result. Repeated rows are documents of their own; a null id sorts first; an empty table gives an empty manifest.
    """

    common.prepare(docs.sparkSession)

    def write(batches):
        import pyarrow as pa

        enc, out, part, number, uri = encoder(tokenizer, literal=False), None, None, 0, ""

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "uri": [uri], "n_docs": pa.array([out.docs], pa.int64()), "n_ids": pa.array([out.n], pa.int64())})

        for batch in common.short(batches):
            ids, bounds = enc.encode_with_end(batch.column(2), end_id)
            parts, doc_ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            cuts = np.concatenate([[0], np.nonzero(np.diff(parts))[0] + 1, [len(parts)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if out and (parts[a] != part or out.docs >= file_docs or out.n >= file_ids):
                    yield closed()
                    number, out = (number + 1 if parts[a] == part else 0), None
                if out is None:
                    part = int(parts[a])
                    uri = f"{folder}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.ids"
                    out = Writer(uri)
                out.add(doc_ids[a:b], ids[bounds[a] : bounds[b]], bounds[a : b + 1])
        if out:
            yield closed()

    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(common.stretch_of(F.col("doc_id"), common.id_bounds(docs, "doc_id", parts)).alias("part"), "doc_id", "text")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "doc_id", "text")
    return common.stored(ordered.mapInArrow(write, "part int, number int, uri string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files: one row of the manifest is one task's work."""

    common.prepare(manifest.sparkSession)

    def read(batches):
        import pyarrow as pa

        def rows(uri, base):
            for doc_id, start, ids in Reader(uri):
                yield doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

        kinds = (pa.int64(),) * 4
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk = []
                for row in rows(uri, base):
                    chunk.append(row)
                    if len(chunk) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        chunk = []
                if chunk:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row for each file: small enough for one ordered window at any size of corpus
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through Simple-8b files: doc_id, start, n_tokens, ids_crc32."""
    common.prepare(spark)
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), vocabulary(), 2, common.work_dir(spark, "token-ids"))
    return read_token_files(manifest)

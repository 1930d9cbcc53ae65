"""Operator 9: SentencePiece encoding that keeps the source bytes of every piece, and decoding.

The model's compiled character map is a double-array trie over UTF-8 bytes: normalisation replaces the longest prefix that the trie has and
records, for every byte it puts out, the source byte it came from. Ids come from the sentencepiece library; pieces follow one another through the
normalised bytes, so the record projects each to its source bytes.

Where no piece has a space mark after another character and normalisation only changes space marks, merges never cross into a space mark, and texts are encoded by their
chunks (marks and what follows them), looked up many at a time in a bounded table. The table has for each piece of a chunk its id and the source byte at which it ends in the
chunk, by the normaliser's record of the chunk; with the chunk's place in its text that is where the piece ends in the text, and where the next begins.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cached_property
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common
from .segments import MOST_KEYS, SegmentTable, text_bytes
from .token_ids import vocabulary

MARK = "▁"
_coders: dict[str, "PieceCoder"] = {}


def _fields(blob: bytes) -> list[tuple[int, bytes | int]]:
    """The fields of a serialised protocol buffer message: number and value."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = blob[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            out.append((key >> 3, varint()))
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            out.append((key >> 3, blob[i : i + n]))
            i += n
    return out


class CharacterMap:
    """Longest-prefix replacement by a compiled character map: trie size (4 bytes), trie units, replacements ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[bytes, int]:
        """What the longest rule at a place puts out and how many bytes it takes; 0 bytes where no rule applies."""
        if not self.units:
            return b"", 0
        node, value, taken = self._child(0, self.units[0]), None, 0
        for k in range(at, len(source)):
            node ^= source[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != source[k]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                value, taken = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if value is None:
            return b"", 0
        return self.replacements[value : self.replacements.index(b"\0", value)], taken

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


class Normalizer:
    """Normalisation of a text with, for each byte put out, the source byte at which it began; one entry more for the end."""

    def __init__(self, spec: bytes):
        got = dict(_fields(spec))
        self.map = CharacterMap(got.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))

    def _next(self, source: bytes, at: int) -> tuple[bytes, int]:
        out, taken = self.map.longest(source, at)
        if not taken:
            lead = source[at]
            taken = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            out = source[at : at + taken]
        return out, taken

    def align(self, text: str) -> tuple[bytes, list[int]]:
        source = text.encode()
        space = MARK.encode() if self.escape else b" "
        at, out, origin = 0, bytearray(), []
        if self.squeeze:
            while at < len(source):
                piece, taken = self._next(source, at)
                if piece != b" ":
                    break
                at += taken
        if at == len(source):
            return b"", [0]
        if not self.map.units and not self.squeeze:
            lead = space if self.dummy_prefix else b""
            if b" " not in source and text.isascii():  # copied as it is
                return lead + source, [0] * len(lead) + list(range(len(source) + 1))
            if len(source) > 64:
                raw, place = np.frombuffer(source, np.uint8), np.arange(len(source))
                begin = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, place))  # of the character
                origin = np.repeat(begin, np.where(raw == 32, len(space), 1))
                return lead + source.replace(b" ", space), [0] * len(lead) + origin.tolist() + [len(source)]

        def put(piece: bytes, begin: int) -> None:
            out.extend(piece)
            origin.extend([begin] * len(piece))

        if self.dummy_prefix:
            put(space, at)
        after_space = self.squeeze
        while at < len(source):
            piece, taken = self._next(source, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                for k, part in enumerate(piece.split(b" ")):
                    put((space if k else b"") + part, at)
                after_space = self.squeeze and piece.endswith(b" ")
            at += taken
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], origin[-len(space) + 1 :]
                at = origin.pop()
        return bytes(out), [*origin, at]


class PieceCoder:
    def __init__(self, path: str, most: int = MOST_KEYS):
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.normalizer = Normalizer(next((v for k, v in _fields(blob) if k == 3), b""))
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.byte = [self.library.is_byte(i) for i in range(len(pieces))]
        self.size = [1 if b else len(p.encode()) for p, b in zip(pieces, self.byte)]
        self.unknown, self.mark = self.library.unk_id(), self.library.piece_to_id(MARK)
        n = self.normalizer
        self.by_chunk = n.dummy_prefix and n.escape and not n.squeeze and not n.map.units and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.table = SegmentTable(self._ask, most, np.uint64)

    def _ask(self, chunks: list[str]) -> list[list[int]]:
        """Pieces of chunks led by a space or more, each as its id and, 32 bits higher, where it ends in the chunk: the normaliser's prefix stands for the first space."""
        out = []
        for chunk, ids in zip(chunks, self.library.encode([c[1:] for c in chunks], num_threads=1)):
            if ids:
                _, origin = self.normalizer.align(chunk[1:])
                out.append([i | (1 + origin[e]) << 32 for i, e in zip(ids, self._ends(chunk[1:], ids))])
            else:
                out.append([self.mark | 1 << 32])
        return out

    def _ends(self, text: str, ids: list[int]) -> list[int]:
        """Where each piece ends in the normalised bytes."""
        if self.unknown in ids:
            return np.cumsum([1 if self.byte[i] else len(p.encode()) for p, i in zip(self.library.encode(text, out_type=str), ids)], dtype=int).tolist()
        return list(accumulate(map(self.size.__getitem__, ids)))

    def aligned(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of a text and the source bytes [begin, end) of each, through the normaliser's record.

        Of the byte pieces that spell a character, the last has all its source bytes and the others none.
        """
        if not text:
            return [], []
        ids, (_, origin) = self.library.encode(text), self.normalizer.align(text)
        ends = self._ends(text, ids)
        return ids, [(origin[a], origin[b]) for a, b in zip([0, *ends[:-1]], ends)]

    def encode(self, column) -> tuple[list[list[int]], list[np.ndarray]]:
        """Ids of each text of an Arrow column (null: empty), and the source bytes of its pieces as rows (begin, end) of unsigned 32-bit numbers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        filled = pc.fill_null(column, "")
        spans_of = lambda pairs: np.array(pairs, "<u4").reshape(-1, 2)
        if not self.by_chunk:
            got = [self.aligned(t) for t in filled.to_pylist()]
            return [g[0] for g in got], [spans_of(g[1]) for g in got]
        data, bounds = text_bytes(pc.binary_join_element_wise("", filled, pa.scalar(" ", filled.type)))  # the prefix as a space of its own
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[bounds[:-1]] = True
        (starts,) = np.nonzero(begins)
        found, counts = self.table.look_up(data, starts, np.diff(np.append(starts, len(data))))
        first = np.searchsorted(starts, bounds)  # chunk of each text
        cuts = np.concatenate([[0], np.cumsum(counts)])[first]
        # a piece ends in its text where its chunk begins there, without the prefix, and as far on as the record of the chunk says
        spans = np.zeros((len(found), 2), "<u4")
        spans[:, 1] = np.repeat(starts - np.repeat(bounds[:-1], np.diff(first)) - 1, counts) + (found >> np.uint64(32)).astype(np.int64)
        spans[1:, 0] = spans[:-1, 1]
        spans[cuts[:-1][cuts[:-1] < len(spans)], 0] = 0
        flat, cuts = (found & np.uint64(0xFFFFFFFF)).tolist(), cuts.tolist()
        out, parts = [flat[a:b] for a, b in zip(cuts, cuts[1:])], [spans[a:b] for a, b in zip(cuts, cuts[1:])]
        special = pc.or_(pc.equal(filled, ""), pc.match_substring(filled, MARK)).to_numpy(zero_copy_only=False)
        for k in np.nonzero(special | np.array([self.unknown in x for x in out], bool))[0].tolist():
            out[k], pairs = self.aligned(filled[k].as_py())
            parts[k] = spans_of(pairs)
        return out, parts

    def digest(self, column, end_id: int) -> tuple[list[int], list[str], list[str], list[int], list[int]]:
        """Of each text's ids with the end id: how many, their sha256; the sha256 of the decoded text; the source byte at which the last piece ends; the crc32 of all pieces' begins and ends."""
        ids, spans = self.encode(column)
        for x in ids:
            x.append(end_id)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        decoded = [sha(t) for t in self.library.decode(ids, num_threads=1)] if ids else []
        return list(map(len, ids)), [sha(" ".join(map(self._decimal, x))) for x in ids], decoded, [int(s[-1, 1]) if len(s) else 0 for s in spans], [zlib.crc32(np.ascontiguousarray(s)) for s in spans]

    @cached_property
    def _decimal(self):
        return [str(i) for i in range(len(self.byte))].__getitem__


def coder(path: str) -> PieceCoder:
    """This process's coder for a model file."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, and begins and ends of each piece in the text's UTF-8 bytes. Null text: empty arrays; repeated rows stay."""

    common.prepare(docs.sparkSession)

    def encode(batches):
        import pyarrow as pa

        enc = coder(model)
        for batch in common.short(batches):
            ids, spans = enc.encode(batch.column(1))
            ends = [pa.array([s[:, k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "begins": ends[0], "ends": ends[1]})

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def digest_documents(docs: DataFrame, model: str, end_id: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes (where the last piece ends in the source) and spans_crc32 of each document, in one pass.

    spans_crc32 is the crc32 of the source bytes at which each piece but the end id begins and ends, as little-endian unsigned 32-bit numbers.
    Null text counts as empty (the end id alone); very long texts are worked on by themselves; repeated rows stay; an empty table gives no rows.
    """

    common.prepare(docs.sparkSession)

    def digest(batches):
        import pyarrow as pa

        enc = coder(model)
        end = enc.library.eos_id() if end_id is None else end_id
        for batch in common.short(batches):
            n, ids, decoded, covered, spans = enc.digest(batch.column(1), end)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "covered_bytes": pa.array(covered, pa.int64()), "spans_crc32": pa.array(spans, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, spans_crc32 long")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ids, decoded text and pieces' source bytes of every document: doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes, spans_crc32."""
    common.prepare(spark)
    return digest_documents(common.table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))

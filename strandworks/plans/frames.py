"""The frame codec end to end: gain, padding, 2-D transform, blocks, quantization, run-length bytes, Huffman codes, headers; and back.

A frame is a row with its traces and header fields, in order of their places, of any number and length. It is encoded and decoded within its row, so nothing is shuffled but the traces of a
frame, once, and 2 x 257 counts of symbols. A frame with an amplitude out of bounds goes out raw.

Bytes of a frame's traces: a head of 28 or 32 bytes, then (raw) the samples as floats, or (coded) the levels of the gated gain if there is one, and the Huffman codes of a body: step (float) and extent (int) of
each block, then the run-length bytes of all blocks. Bytes of its headers: a head, then the Huffman codes of their runs. All numbers are big-endian.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lot
from ..functions.coding import run_bytes, run_values
from ..operators.entropy import END, Codes
from ..operators.headers import expand, runs
from ..operators.lapped import DOUBLES, frames, worker_path
from ..operators.quant import _B, _E, _Q, _R, CPDF, DISTORTION, chain
from ..registry import query
from ..streaming.streams import folder
from ..tables import N1, N2, long_samples, r4, sql, traces

#: Fixed values of the format: the cookies of coded and of raw frames without and with a gain, and of headers.
COOKIE_V2, COOKIE_V3 = 30607, 30744
RAW_COOKIE_V2, RAW_COOKIE_V3 = 29899, 29941
HEADERS_COOKIE = 1215649
#: cookie, distortion, samples, traces, block sizes down and across, transform lengths down and across, bytes of traces and of headers; then the gain's exponent
_HEAD, _GAIN = struct.Struct(">hfiihhbbii"), struct.Struct(">f")
_HEADERS = struct.Struct(">iii?")
#: Gates of the gated gain have so many samples. In the head the exponent GATED says that levels follow; it stands for no curve of time.
GATE, LEVELS, GATED = 256, 32766.0, -1.0
#: The largest amplitude that queries code.
LIMIT = 0.45
RUN_KINDS = ("const", "ascending", "descending", "delta", "float", "literal")


@dataclass(frozen=True)
class Shape:
    """Blocks of a frame: traces across and samples down of a block, and the lengths of the transforms."""

    block2: int
    block1: int
    length2: int
    length1: int

    def __post_init__(self):
        for block, length in ((self.block2, self.length2), (self.block1, self.length1)):
            if block <= 0 or block % 8:
                raise ValueError(f"a block size must be a positive multiple of 8, not {block}")
            if block > 32767:
                raise ValueError(f"a block size must fit 16 bits, not {block}")
            if length not in lot.ANGLES:
                raise ValueError(f"a transform length must be one of {sorted(lot.ANGLES)}, not {length}")
            if block % length:
                raise ValueError(f"the transform length {length} doesn't divide the block size {block}")

    def padded(self, n2: int, n1: int) -> tuple[int, int]:
        if n2 <= 0 or n1 <= 0:
            raise ValueError("a frame needs a trace and a sample")
        return -(-n2 // self.block2) * self.block2, -(-n1 // self.block1) * self.block1


def block_size(n: int, fastest: bool = False) -> int:
    """The block size for n traces or samples, as operators' block_size_policy has it."""
    if n <= 0:
        raise ValueError("a frame needs a trace and a sample")
    if n <= 32:
        return -(-n // 8) * 8
    return (24 if n <= 48 else 32 if n <= 64 else 64) if fastest else min(-(-n // 16) * 16, 256)


def shape_of(n2: int, n1: int, fastest: bool = False) -> Shape:
    """Block sizes and transform lengths by policy."""
    blocks = block_size(n2, fastest), block_size(n1, fastest)
    return Shape(*blocks, *(8 if fastest or b % 16 else 16 for b in blocks))


#: The blocks of compress_frames, whose twin in SQL has them written out.
FIXED = Shape(8, 16, 8, 8)
BLOCKS = (N2 // FIXED.block2) * (N1 // FIXED.block1)


def time_gain(n1: int, exponent: float) -> np.ndarray:
    """The gain of n1 samples 4 ms apart: time to a power, over its mean. Exponent 0 is no gain at all."""
    raw = (np.arange(n1) * 0.004) ** exponent + 0.001
    return raw / raw.mean()


def gate_levels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels (16 bits, a gate each) and largest amplitude (single precision) of the traces in the last axis.

    A gate's amplitude is the mean size of its values that aren't zero, damped up to twice as much at the last gate, and raised to the largest from it on.
    """
    n1 = x.shape[-1]
    gates = -(-n1 // GATE)
    size = np.abs(np.concatenate([x, np.zeros((*x.shape[:-1], gates * GATE - n1))], -1)).reshape(*x.shape[:-1], gates, GATE)
    mean = size.sum(-1) / np.maximum((size > 0).sum(-1), 1) * (1 + np.arange(gates) / max(gates - 1, 1))
    decay = np.maximum.accumulate(mean[..., ::-1], -1)[..., ::-1]
    top = decay.max(-1)
    levels = np.where(top[..., None] > 0, np.maximum(np.floor(decay / np.where(top > 0, top, 1)[..., None] * LEVELS + 0.5), 1), 1)
    return levels.astype(np.uint16), np.where(top > 0, top, 1).astype(np.float32)


def gate_gain(levels: np.ndarray, top: np.ndarray, n1: int) -> np.ndarray:
    """The gain at each of n1 samples: between gate centres at the edges of gates, then straight from edge to edge."""
    a = levels.astype(float) * top[..., None].astype(float) / LEVELS
    gates = a.shape[-1]

    def edge(i):
        j = i // GATE
        upper = np.where(i <= j * GATE + GATE // 2, j - 1, j)
        weight = ((upper + 1) * GATE + GATE // 2 - i) / GATE
        between = weight * a[..., np.maximum(upper, 0)] + (1 - weight) * a[..., np.minimum(upper + 1, gates - 1)]
        return np.where(upper < 0, a[..., :1], np.where(upper + 1 >= gates, a[..., -1:], between))

    first = np.arange(gates) * GATE
    last = np.minimum(first + GATE, n1) - 1
    g0, g1 = edge(first), edge(last)
    i = np.arange(n1)
    j = i // GATE
    return g0[..., j] + (g1 - g0)[..., j] / np.maximum(last - first, 1)[j] * (i - first[j])


def tiles(grids: np.ndarray, s: Shape) -> np.ndarray:
    """Padded grids as blocks: (grids x blocks x values), blocks along a column of blocks first."""
    _, p2, p1 = grids.shape
    return grids.reshape(-1, p2 // s.block2, s.block2, p1 // s.block1, s.block1).transpose(0, 1, 3, 2, 4).reshape(len(grids), -1, s.block2 * s.block1)


def untiled(blocks: np.ndarray, s: Shape, p2: int, p1: int) -> np.ndarray:
    return blocks.reshape(-1, p2 // s.block2, p1 // s.block1, s.block2, s.block1).transpose(0, 1, 3, 2, 4).reshape(-1, p2, p1)


def steps_of(y: np.ndarray, distortion: float = DISTORTION) -> np.ndarray:
    """The quantization step of each block, in single precision: from the rms of values beyond a quarter of what the rms of all gives; 1 where there are none."""
    first = distortion * np.sqrt((y * y).mean(-1, keepdims=True)) / CPDF
    large = np.abs(y) > first * 0.25
    n = large.sum(-1)
    square = np.where(large, y * y, 0).sum(-1) / np.maximum(n, 1)
    return np.where(n > 0, distortion * np.sqrt(square) / CPDF, 1.0).astype(np.float32)


def encoded(grids: np.ndarray, distortion: float = DISTORTION, shape: Shape = FIXED) -> list[bytes]:
    """The bodies of frames of one size, before entropy coding."""
    if not len(grids):
        return []
    _, n2, n1 = grids.shape
    p2, p1 = shape.padded(n2, n1)
    y = np.zeros((len(grids), p2, p1))
    y[:, :n2, :n1] = grids
    y = lot.forward(lot.forward(y.transpose(0, 2, 1), shape.length2).transpose(0, 2, 1), shape.length1)
    y = tiles(y, shape)
    delta = steps_of(y, distortion)
    q = y / delta.astype(np.float64)[..., None]
    q = (np.sign(q) * np.floor(np.abs(q) + 0.5)).astype(np.int64)
    extent = np.where(q != 0, np.arange(1, q.shape[-1] + 1), 0).max(-1)
    extent += extent % 2
    live = np.arange(q.shape[-1]) < extent[..., None]
    data, bounds = run_bytes(q[live], np.append(0, np.cumsum(extent)))
    heads = np.zeros(extent.shape, [("delta", ">f4"), ("extent", ">i4")])
    heads["delta"], heads["extent"] = delta, extent
    cuts = bounds[:: extent.shape[1]]
    return [h.tobytes() + data[a:b].tobytes() for h, a, b in zip(heads, cuts, cuts[1:])]


def decoded(bodies: list[bytes], n2: int = N2, n1: int = N1, shape: Shape = FIXED) -> np.ndarray:
    """Grids (frames x n2 x n1) from bodies."""
    p2, p1 = shape.padded(n2, n1)
    size = shape.block2 * shape.block1
    blocks = p2 * p1 // size
    y = np.zeros((len(bodies), blocks, size))
    for k, body in enumerate(bodies):
        if len(body) < 8 * blocks:
            raise ValueError("a frame's body is cut short")
        heads = np.frombuffer(body, [("delta", ">f4"), ("extent", ">i4")], blocks)
        live = np.arange(size) < heads["extent"][:, None]
        values = run_values(np.frombuffer(body, np.uint8)[8 * blocks :])
        if len(values) != live.sum():
            raise ValueError("a frame's body has another number of values than it states")
        y[k][live] = values * np.repeat(heads["delta"].astype(float), heads["extent"])
    z = untiled(y, shape, p2, p1)
    return lot.backward(lot.backward(z, shape.length1).transpose(0, 2, 1), shape.length2).transpose(0, 2, 1)[:, :n2, :n1]


@dataclass(frozen=True)
class FrameHead:
    """What the head of a frame states."""

    raw: bool
    distortion: float
    n1: int
    n2: int
    shape: Shape
    trace_bytes: int
    header_bytes: int
    exponent: float = 0.0

    def bytes(self) -> bytes:
        """28 bytes, or 32 with a gain."""
        cookie = (RAW_COOKIE_V3 if self.raw else COOKIE_V3) if self.exponent else RAW_COOKIE_V2 if self.raw else COOKIE_V2
        s = self.shape
        out = _HEAD.pack(cookie, self.distortion, self.n1, self.n2, s.block1, s.block2, s.length1, s.length2, self.trace_bytes, self.header_bytes)
        return out + _GAIN.pack(self.exponent) if self.exponent else out

    def updated(self, trace_bytes: int, header_bytes: int) -> FrameHead:
        return FrameHead(self.raw, self.distortion, self.n1, self.n2, self.shape, trace_bytes, header_bytes, self.exponent)


def frame_head(data: bytes) -> tuple[FrameHead, int]:
    """The head at the beginning of a frame's bytes, and its length. Raises ValueError for another cookie, sizes that can't be, or too few bytes."""
    if len(data) < _HEAD.size:
        raise ValueError("a frame ends within its head")
    cookie, distortion, n1, n2, b1, b2, l1, l2, traces_, headers_ = _HEAD.unpack_from(data)
    if cookie not in (COOKIE_V2, COOKIE_V3, RAW_COOKIE_V2, RAW_COOKIE_V3):
        raise ValueError(f"{cookie} begins no frame")
    size, exponent = _HEAD.size, 0.0
    if cookie in (COOKIE_V3, RAW_COOKIE_V3):
        if len(data) < size + _GAIN.size:
            raise ValueError("a frame ends within its head")
        (exponent,) = _GAIN.unpack_from(data, size)
        size += _GAIN.size
    if n1 < 1 or n2 < 1 or traces_ < 0 or headers_ < 0:
        raise ValueError("a frame's head has sizes that can't be")
    return FrameHead(cookie in (RAW_COOKIE_V2, RAW_COOKIE_V3), distortion, n1, n2, Shape(b2, b1, l2, l1), traces_, headers_, exponent), size


def header_body(columns: list[list[int]]) -> bytes:
    """The runs of header fields in bytes: for each field their number, then kinds, lengths, first values and steps."""
    out = []
    for values in columns:
        found = runs(values)
        kinds = bytes(RUN_KINDS.index(r[0]) for r in found)
        first, step = (np.array([r[k] for r in found], ">i8").tobytes() for k in (2, 3))
        out += [struct.pack(">i", len(found)), kinds, np.array([r[1] for r in found], ">i4").tobytes(), first, step]
    return b"".join(out)


def header_columns(data: bytes, fields: int) -> list[list[int]]:
    at, out = 0, []
    for _ in range(fields):
        (n,) = struct.unpack_from(">i", data, at)
        at += 4
        kinds, parts = data[at : at + n], []
        at += n
        for kind, size in ((">i4", 4), (">i8", 8), (">i8", 8)):
            parts.append(np.frombuffer(data, kind, n, at).tolist())
            at += n * size
        out.append([v for k, *r in zip(kinds, *parts) for v in expand(RUN_KINDS[k], *r)])
    return out


def header_payload(columns: list[list[int]], remute: bool, body: bytes, codes: Codes) -> bytes:
    """Header bytes: cookie, fields, traces, whether the last field says where each trace begins; then the codes of a body."""
    return _HEADERS.pack(HEADERS_COOKIE, len(columns), len(columns[0]) if columns else 0, remute) + codes.encode(body)


def header_fields(data: bytes, codes: Codes) -> tuple[list[list[int]], list[int] | None]:
    """The fields, and where each trace's first sample that isn't zero is (None where that wasn't kept). Raises ValueError for another cookie."""
    if len(data) < _HEADERS.size:
        raise ValueError("headers end within their head")
    cookie, fields, n, remute = _HEADERS.unpack_from(data)
    if cookie != HEADERS_COOKIE:
        raise ValueError(f"{cookie} begins no headers")
    columns = header_columns(codes.decode(data[_HEADERS.size :]), fields)
    if any(len(c) != n for c in columns):
        raise ValueError("a header field has another number of values than there are traces")
    return (columns[:-1], columns[-1]) if remute else (columns, None)


def first_live(x: np.ndarray) -> np.ndarray:
    """Where the first value that isn't zero is in each row; the length where there is none."""
    live = x != 0
    return np.where(live.any(-1), live.argmax(-1), x.shape[-1])


def _sides(x: np.ndarray, gain: float) -> tuple[np.ndarray, bytes]:
    """A frame's traces without the gain, and the bytes that restoring it takes."""
    if gain == GATED:
        levels, top = gate_levels(x)
        return x / gate_gain(levels, top, x.shape[-1]), levels.astype(">u2").tobytes() + top.astype(">f4").tobytes()
    return (x * time_gain(x.shape[-1], gain) if gain else x), b""


def _restored(x: np.ndarray, head: FrameHead, side: bytes) -> np.ndarray:
    if head.exponent == GATED:
        gates = -(-head.n1 // GATE)
        levels = np.frombuffer(side, ">u2", head.n2 * gates).reshape(head.n2, gates)
        return x * gate_gain(levels, np.frombuffer(side, ">f4", head.n2, 2 * head.n2 * gates), head.n1)
    return x / time_gain(head.n1, head.exponent) if head.exponent else x


def _side_bytes(head: FrameHead) -> int:
    return head.n2 * (2 * -(-head.n1 // GATE) + 4) if head.exponent == GATED else 0


def gathered(df: DataFrame, fields: list[str]) -> DataFrame:
    """Frames of traces (volume, frame_no, trace_in_frame, samples and the fields): volume, frame_no, samples (an array a trace), fields (an array a field, trace_in_frame first).

    Traces are in order of trace_in_frame, nulls first; of several rows with one place the last in order of samples and fields counts. A null trace is an empty one; a null field is 0.
    """
    row = F.struct("trace_in_frame", F.coalesce(F.col("samples").cast(DOUBLES), F.array().cast(DOUBLES)).alias("samples"), *(F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f"f{k}") for k, f in enumerate(fields)))
    grouped = df.groupBy("volume", "frame_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    last = F.filter("rows", lambda r, i: ~F.coalesce(F.try_element_at("rows", i + 2)["trace_in_frame"].eqNullSafe(r["trace_in_frame"]) & (i + 1 < F.size("rows")), F.lit(False)))
    place = F.transform("rows", lambda r: F.coalesce(r["trace_in_frame"].cast("long"), F.lit(0)))
    others = [F.col("rows")[f"f{k}"] for k in range(len(fields))]
    return grouped.select("volume", "frame_no", last.alias("rows")).select("volume", "frame_no", F.transform("rows", lambda r: r["samples"]).alias("samples"), F.array(place, *others).alias("fields"))


PACKED = "volume long, frame_no long, traces int, samples int, coded boolean, head binary, payload binary"


def bodies(framed: DataFrame, distortion: float = DISTORTION, gain: float = 0.0, limit: float = 1e30, remute: bool = False, shape: Shape | None = None) -> DataFrame:
    """Frames before entropy coding: volume, frame_no, traces, samples, start (the bytes that go out as they are, from the frame's head on), body (null for raw frames), fields and header_body.

    Blocks are those of the shape, or by policy of each frame's size. Frames of a size that come together are transformed together. Traces shorter than their frame's longest are filled up with zeros.
    A frame without a sample has one zero a trace.
    """
    worker_path(framed.sparkSession)

    def grid_of(rows) -> np.ndarray:
        x = np.zeros((len(rows), max(1, max(map(len, rows)))))
        for k, r in enumerate(rows):
            x[k, : len(r)] = [np.nan if v is None else v for v in r]
        return x

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            grids = [grid_of(r) for r in batch.column(2).to_pylist()]
            fields = batch.column(3).to_pylist()
            if remute:
                fields = [[*f, first_live(x).tolist()] for f, x in zip(fields, grids)]
            out: list = [None] * len(grids)
            by_size: dict = {}
            for k, x in enumerate(grids):
                s = shape or shape_of(*x.shape)
                if np.abs(x).max() <= limit:
                    flat, side = _sides(x, gain)
                    by_size.setdefault((x.shape, s), []).append((k, flat, side))
                else:  # also where not a number
                    head = FrameHead(True, distortion, x.shape[1], x.shape[0], s, 0, 0, gain)
                    data = x.astype(">f4").tobytes()
                    out[k] = head.updated(len(head.bytes()) + len(data), 0).bytes() + data, None
            for ((n2, n1), s), some in by_size.items():
                head = FrameHead(False, distortion, n1, n2, s, 0, 0, gain)
                for (k, _, side), body in zip(some, encoded(np.stack([x for _, x, _ in some]), distortion, s)):
                    out[k] = head.bytes() + side, body
            sizes = [pa.array([x.shape[i] for x in grids], pa.int32()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *sizes, pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array(fields, pa.list_(pa.list_(pa.int64()))), pa.array(map(header_body, fields), pa.binary())],
                ["volume", "frame_no", "traces", "samples", "start", "body", "fields", "header_body"],
            )

    typed = framed.select(F.col("volume").cast("long"), F.col("frame_no").cast("long"), "samples", "fields")
    return typed.mapInArrow(run, "volume long, frame_no long, traces int, samples int, start binary, body binary, fields array<array<bigint>>, header_body binary")


def counts_of(df: DataFrame, *columns: str) -> list[list[int]]:
    """The counts of 256 bytes and of ends in each binary column: 257 numbers a column come to the driver, whatever the number of frames. Each is one more than found, so that any bytes can be encoded."""
    worker_path(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        totals = np.zeros((len(columns), END + 1), np.int64)
        for batch in batches:
            for k in range(len(columns)):
                found = [b for b in batch.column(k).to_pylist() if b is not None]
                totals[k, :END] += np.bincount(np.frombuffer(b"".join(found), np.uint8), minlength=END)
                totals[k, END] += len(found)
        of, symbol = np.divmod(np.arange(totals.size), END + 1)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(symbol, pa.int32()), pa.array(totals.ravel(), pa.int64())], ["of", "symbol", "n"])

    out = [[1] * (END + 1) for _ in columns]
    for r in df.select(*columns).mapInArrow(run, "of int, symbol int, n long").groupBy("of", "symbol").agg(F.sum("n").alias("n")).collect():
        out[r["of"]][r["symbol"]] += r["n"]
    return out


@dataclass(frozen=True)
class Tables:
    """Counts that the codes of traces and of headers are made of; a file of frames has them at its beginning."""

    traces: tuple[int, ...]
    headers: tuple[int, ...]

    def codes(self) -> tuple[Codes, Codes]:
        return Codes(dict(enumerate(self.traces))), Codes(dict(enumerate(self.headers)))

    def bytes(self) -> bytes:
        return np.array([self.traces, self.headers], ">i8").tobytes()

    @staticmethod
    def of(data: bytes) -> Tables:
        both = np.frombuffer(data, ">i8").reshape(2, END + 1).tolist()
        return Tables(*map(tuple, both))


def compress(framed: DataFrame, distortion: float = DISTORTION, gain: float = 0.0, limit: float = 1e30, remute: bool = False, shape: Shape | None = None) -> tuple[DataFrame, Tables]:
    """Gathered frames in bytes (PACKED), and the tables that decoding needs. Bodies are made once: they are a table in the shared folder between counting and coding."""
    spark = framed.sparkSession
    path = folder(spark, "frame-bodies")
    made = bodies(framed, distortion, gain, limit, remute, shape)
    made.write.parquet(path)
    kept = spark.read.schema(made.schema).parquet(path)
    tables = Tables(*map(tuple, counts_of(kept, "body", "header_body")))

    def run(batches):
        import pyarrow as pa

        of_traces, of_headers = tables.codes()
        for batch in batches:
            volume, frame, n2, n1, start, body, fields, header = batch.columns
            heads = [header_payload(f, remute, h, of_headers) for f, h in zip(fields.to_pylist(), header.to_pylist())]
            payloads = []
            for s, b, h in zip(start.to_pylist(), body.to_pylist(), heads):
                head, size = frame_head(s)
                codes = b"" if b is None else of_traces.encode(b)
                payloads.append(head.updated(len(s) + len(codes), len(h)).bytes() + s[size:] + codes)
            yield pa.RecordBatch.from_arrays([volume, frame, n2, n1, pa.array([b.is_valid for b in body], pa.bool_()), pa.array(heads, pa.binary()), pa.array(payloads, pa.binary())], [x.split()[0] for x in PACKED.split(", ")])

    return kept.mapInArrow(run, PACKED), tables


def restored(payload: bytes, codes: Codes) -> np.ndarray:
    """The traces of a frame from its bytes. Raises ValueError where they aren't as long as their head says."""
    head, size = frame_head(payload)
    if len(payload) != head.trace_bytes:
        raise ValueError(f"a frame has {len(payload)} bytes and states {head.trace_bytes}")
    if head.raw:
        return np.frombuffer(payload, ">f4", head.n1 * head.n2, size).reshape(head.n2, head.n1).astype(float)
    codes_at = size + _side_bytes(head)
    (x,) = decoded([codes.decode(payload[codes_at:])], head.n2, head.n1, head.shape)
    return _restored(x, head, payload[size:codes_at])


def restored_frame(payload: bytes, header: bytes, codes: tuple[Codes, Codes]) -> tuple[np.ndarray, list[list[int]]]:
    """Traces and header fields of a frame; where the headers say at which sample a trace begins, samples before it are zero again."""
    x, (fields, first) = restored(payload, codes[0]), header_fields(header, codes[1])
    if first is not None:
        x[np.arange(x.shape[1]) < np.array(first)[:, None]] = 0
    return x, fields


def uncompress(df: DataFrame, tables: Tables) -> DataFrame:
    """volume, frame_no, traces, samples, coded, fields and grid (samples trace by trace) of frames in bytes."""
    worker_path(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        codes = tables.codes()
        for batch in batches:
            got = [restored_frame(p, h, codes) for h, p in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            bounds = np.cumsum([0, *(x.size for x, _ in got)]).astype(np.int32)
            flat = np.concatenate([np.empty(0), *(x.ravel() for x, _ in got)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([f for _, f in got], pa.list_(pa.list_(pa.int64()))), pa.ListArray.from_arrays(bounds, pa.array(flat))], RESTORED_NAMES)

    return df.select(*(x.split()[0] for x in PACKED.split(", "))).mapInArrow(run, RESTORED)


RESTORED = "volume long, frame_no long, traces int, samples int, coded boolean, fields array<array<bigint>>, grid array<double>"
RESTORED_NAMES = [x.split()[0] for x in RESTORED.split(", ")]

_P = f"p AS (SELECT DISTINCT frame_no, j, i FROM samples, range({N2}) t(j)), u AS (SELECT p.frame_no, p.j AS trace_in_frame, p.i, coalesce(x,0.0e0) AS x FROM p LEFT JOIN samples s ON s.frame_no=p.frame_no AND s.trace_in_frame=p.j AND s.i=p.i)"
_F = f"f AS (SELECT frame_no, CAST(count(DISTINCT trace_in_frame) AS BIGINT) AS live, max(CASE WHEN abs(x)<={LIMIT}e0 THEN 0 ELSE 1 END) AS bad FROM samples GROUP BY 1)"
_2D = f"a AS (SELECT frame_no, i, c.k AS kt, sum(x*w) AS x FROM u JOIN f USING (frame_no) JOIN {lot.values_sql(N2, 8).replace('c(k, i, w)', 'c(k, j, w)')} ON trace_in_frame = j WHERE bad=0 GROUP BY ALL), y2 AS (SELECT frame_no, kt, c.k AS ks, sum(x*w) AS y FROM a JOIN {lot.values_sql(N1, 8)} USING (i) GROUP BY ALL)"
_BLOCKED = f"y AS (SELECT frame_no*{BLOCKS}+(kt//{FIXED.block2})*{N1 // FIXED.block1}+ks//{FIXED.block1} AS trace_id, (kt%{FIXED.block2})*{FIXED.block1}+ks%{FIXED.block1} AS k, frame_no, kt, ks, y FROM y2)"
_STEP = f"d1 AS (SELECT trace_id, {DISTORTION}e0*sqrt(avg(y*y))/{CPDF}e0 AS d FROM y GROUP BY 1), delta AS (SELECT trace_id, CAST(CAST(coalesce({DISTORTION}e0*sqrt(avg(CASE WHEN abs(y)>d*0.25e0 THEN y*y END))/{CPDF}e0, 1.0e0) AS FLOAT) AS DOUBLE) AS delta FROM y JOIN d1 USING (trace_id) GROUP BY 1)"
_BACK = f"w AS (SELECT frame_no, kt, ks, q*delta AS v FROM q JOIN y USING (trace_id, k)), b1 AS (SELECT frame_no, kt, i, sum(v*c.w) AS v FROM w JOIN {lot.values_sql(N1, 8)} ON ks=c.k GROUP BY frame_no, kt, i), z AS (SELECT frame_no, j AS trace_in_frame, i, sum(v*c.w) AS z FROM b1 JOIN {lot.values_sql(N2, 8).replace('c(k, i, w)', 'c(k, j, w)')} ON kt=c.k GROUP BY frame_no, j, i)"
#: From samples to the bytes (s), restored samples (z) and errors (n) of frames, as DuckDB has them.
CODEC_SQL = (
    _P, _F, _2D, _BLOCKED, _STEP, _Q, _E, _R, _B, _BACK,
    f"s AS (SELECT e.trace_id//{BLOCKS} AS frame_no, sum(bytes) AS bytes FROM e LEFT JOIN b USING (trace_id) GROUP BY 1)",
    "n AS (SELECT frame_no, max(abs(z-x)) AS m, sqrt(avg((z-x)*(z-x))) AS r FROM z JOIN u USING (frame_no, trace_in_frame, i) GROUP BY 1)",
)


@query("compress_frames", chain(*CODEC_SQL, body=f"SELECT f.frame_no, live, CASE WHEN bad=1 THEN 'raw' ELSE 'coded' END AS route, CAST(CASE WHEN bad=1 THEN {4 * N1 * N2} ELSE {8 * BLOCKS}+coalesce(bytes,0) END AS BIGINT) AS bytes, floor(coalesce(r,0.0e0)*1e4+0.5e0)/1e4 + 0.0e0 AS rms_error, floor(coalesce(m,0.0e0)*1e4+0.5e0)/1e4 + 0.0e0 AS max_error FROM f LEFT JOIN s USING (frame_no) LEFT JOIN n USING (frame_no)"))
def compress_frames(spark, d):
    """Frames of full size coded and restored from their bodies, without a gain: live traces, route, bytes before entropy coding, and root mean square and largest error."""
    grids = frames(traces(spark, d))
    worker_path(spark)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, N2, N1)
            (good,) = np.nonzero(np.abs(x).max((1, 2)) <= LIMIT)
            z, size, made = x.copy(), np.full(len(x), 4 * N1 * N2), encoded(x[good])
            if len(good):
                z[good], size[good] = decoded(made), list(map(len, made))
            e = np.abs(z - x)
            route = np.where(np.isin(np.arange(len(x)), good), "coded", "raw")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(route.tolist(), pa.string()), pa.array(size, pa.int64()), pa.array(np.sqrt((e * e).mean((1, 2)))), pa.array(e.max((1, 2)))], ["frame_no", "live", "route", "bytes", "rms_error", "max_error"])

    out = grids.select("frame_no", "live", F.col("grid").cast(DOUBLES)).mapInArrow(run, "frame_no int, live long, route string, bytes long, rms_error double, max_error double")
    return out.withColumn("rms_error", r4(F.col("rms_error"))).withColumn("max_error", r4(F.col("max_error")))


def rms(a: Column, b: Column | None = None) -> Column:
    """The root mean square of an array, or of the differences of two."""
    squares = F.transform(a, lambda x: x * x) if b is None else F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1)))


def there_and_back(framed: DataFrame, bound: float, **how) -> DataFrame:
    """Frames coded and restored: volume, frame_no, traces, samples, coded, whether all header fields come back, and whether the error's rms is within a share of the traces' rms (raw ones: exact)."""
    packed, tables = compress(framed, **how)
    width = F.array_max(F.transform("samples", F.size))
    whole = F.flatten(F.transform("samples", lambda s: F.slice(F.concat(s, F.array_repeat(F.lit(0.0), width)), 1, F.greatest(width, F.lit(1)))))
    was = framed.select(F.col("volume").cast("long"), F.col("frame_no").cast("long"), whole.alias("was"), F.col("fields").alias("were"))
    both = uncompress(packed, tables).join(was, ["volume", "frame_no"])
    within = F.when(F.col("coded"), rms(F.col("grid"), F.col("was")) <= bound * rms(F.col("was"))).otherwise(F.transform("was", lambda x: x.cast("float").cast("double")) == F.col("grid"))
    return both.select("volume", "frame_no", "traces", "samples", "coded", (F.col("fields") == F.col("were")).alias("headers_same"), within.alias("within"))


@query("frame_codec", sql("traces", "samples", body=f"SELECT CAST(frame_no%3 AS BIGINT) AS volume, CAST(frame_no AS BIGINT) AS frame_no, CAST(count(DISTINCT trace_id) AS INT) AS traces, CAST({N1} AS INT) AS samples, max(abs(x))<={LIMIT}e0 AS coded, true AS headers_same, true AS within FROM samples GROUP BY frame_no"))
def frame_codec(spark, d):
    """Frames of any number of traces in bytes and back, blocks by policy, gated gain, entropy coding and headers included."""
    t = traces(spark, d).withColumn("volume", F.col("frame_no") % 3)
    return there_and_back(gathered(t, ["trace_id", "frame_key"]), 0.2, distortion=DISTORTION, gain=GATED, limit=LIMIT)


@query("long_frame_codec", sql("long_samples", body="SELECT CAST(0 AS BIGINT) AS volume, CAST(trace_id//8 AS BIGINT) AS frame_no, CAST(count(DISTINCT trace_id) AS INT) AS traces, CAST(max(i)+1 AS INT) AS samples, true AS coded, true AS headers_same, true AS within FROM long_samples GROUP BY trace_id//8"))
def long_frame_codec(spark, d):
    """Frames of eight traces of a thousand samples in bytes and back at a distortion of 1e-5, with gains of four gates and samples before a trace's first live one made zero again."""
    t = long_samples(spark, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("samples"))
    t = t.select(F.lit(0).alias("volume"), F.floor(F.col("trace_id") / 8).alias("frame_no"), (F.col("trace_id") % 8).cast("int").alias("trace_in_frame"), "samples", "trace_id")
    return there_and_back(gathered(t, ["trace_id"]), 1e-4, distortion=1e-5, gain=GATED, remute=True)

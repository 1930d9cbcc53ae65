"""The frame codec, run coding of headers, Huffman codes, and arrays that don't fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import coding, lot
from strandworks.operators import entropy, headers, lapped
from strandworks.plans import frames
from strandworks.tables import N1, N2


def grids(n, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(N1) / N1
    return np.stack([[0.4 * np.exp(-3 * t) * np.sin(40 * t + k / 9 + rng.normal(0, 0.02)) for k in range(N2)] for _ in range(n)])


def test_errors_follow_the_distortion():
    x = grids(3)
    rms = lambda z: np.sqrt(((z - x) ** 2).mean() / (x**2).mean())
    sizes = []
    for distortion, bound in ((0.1, 0.2), (0.01, 0.02), (1e-5, 1e-4)):
        bodies = frames.encoded(x, distortion)
        assert rms(frames.decoded(bodies)) < bound
        sizes.append(sum(map(len, bodies)))
    assert sizes == sorted(sizes) and sizes[0] < x.size  # less than a byte a sample at the coarsest


@pytest.mark.parametrize("n2, n1", [(1, 1), (1, 700), (3, 33), (20, 64), (33, 300), (70, 513)])
@pytest.mark.parametrize("fastest", [False, True])
def test_frames_of_any_size(n2, n1, fastest):
    rng = np.random.default_rng(n1)
    x = np.cumsum(rng.standard_normal((2, n2, n1)), -1)
    s = frames.shape_of(n2, n1, fastest)
    for distortion, bound in ((0.1, 0.2), (1e-5, 1e-4)):
        z = frames.decoded(frames.encoded(x, distortion, s), n2, n1, s)
        assert z.shape == x.shape and np.sqrt(((z - x) ** 2).sum() / (x**2).sum()) < bound


def test_bodies_by_plain_loops():
    """One block at a time, with dense matrices."""
    x, s = grids(2)[:, :20, :50], frames.Shape(24, 16, 8, 16)
    out = []
    for grid in x:
        wide = np.zeros((24, 64))
        wide[:20, :50] = grid
        y = lot.matrix(24, 8) @ wide @ lot.matrix(64, 16).T
        heads, rest = b"", b""
        for across in range(0, 24, 24):
            for down in range(0, 64, 16):
                block = y[across : across + 24, down : down + 16].ravel()
                delta = frames.steps_of(block[None])[0]
                q = [int(np.sign(v) * np.floor(abs(v) + 0.5)) for v in block / float(delta)]
                n = max([k + 1 for k, v in enumerate(q) if v] or [0])
                n += n % 2
                heads += np.array([delta], ">f4").tobytes() + np.array([n], ">i4").tobytes()
                at = 0
                while at < n:
                    if q[at]:
                        v, at = q[at], at + 1
                        rest += bytes([v + 180]) if -74 < v < 75 else bytes([101 if v > 0 else 102, abs(v)]) if abs(v) < 256 else bytes([103 if v > 0 else 104]) + abs(v).to_bytes(2, "big")
                    else:
                        end = at
                        while end < n and not q[end]:
                            end += 1
                        run, at = end - at, end
                        rest += bytes([run]) if run <= 100 else bytes([105, run]) if run < 256 else bytes([106]) + run.to_bytes(2, "big")
        out.append(heads + rest)
    assert frames.encoded(x, shape=s) == out


def test_transforms_are_the_matrices():
    rng = np.random.default_rng(5)
    for length in (8, 16):
        for blocks in (1, 2, 7):
            x = rng.standard_normal((2, 3, blocks * length))
            m = lot.matrix(blocks * length, length)
            assert np.allclose(lot.forward(x, length), x @ m.T) and np.allclose(lot.backward(x, length), x @ m)
    with pytest.raises(ValueError):
        lot.forward(np.zeros(12), 8)


def test_run_length_bytes_come_back():
    rng = np.random.default_rng(2)
    some = [0, 0, 0, 1, -1, -73, 74, 75, -74, 255, 256, -255, -256, 65535, 65536, -65535, -65536, -70_000, 2**31 - 1, 1 - 2**31]
    for _ in range(200):
        rows = [[0] * int(rng.integers(0, 300)) + rng.choice(some, int(rng.integers(0, 60))).tolist() + [0] * int(rng.choice([0, 100, 101, 255, 256, 65535, 65536, 140_000])) for _ in range(int(rng.integers(1, 5)))]
        values, bounds = np.array([v for r in rows for v in r], np.int64), np.cumsum([0, *map(len, rows)])
        data, cuts = coding.run_bytes(values, bounds)
        assert (coding.run_values(data) == values).all()
        assert all(coding.run_values(data[a:b]).tolist() == r for a, b, r in zip(cuts, cuts[1:], rows))
    one = lambda v: coding.run_bytes(np.array(v), np.array([0, len(v)]))[0].tolist()
    assert one([0] * 100) == [100] and one([0] * 255) == [105, 255] and one([0] * 256) == [106, 1, 0] and one([0] * 65536) == [106, 255, 255, 1]
    assert one([-73, 74, 75, -74, 256, -65535, 65536]) == [107, 254, 101, 75, 102, 74, 103, 1, 0, 104, 255, 255, 255, 0, 1, 0, 0]
    for cut in ([101], [106, 1], [255, 0, 0, 0]):
        with pytest.raises(ValueError):
            coding.run_values(np.array(cut, np.uint8))
    with pytest.raises(ValueError):
        one([1 << 31])


def test_gated_gain_is_the_operators(spark, small):
    from strandworks.operators import gain

    rows = gain.gained(spark, small).select("x", "levels", F.array_max("decay").alias("top"), "gain").collect()
    rows = [(np.array(r["x"]), r["levels"], r["top"], r["gain"]) for r in rows]
    for x, levels, top, g in rows:
        own, most = frames.gate_levels(x)
        assert own.tolist() == levels and most == np.float32(top or 1)
        assert np.allclose(frames.gate_gain(own, most, len(x)), g, rtol=1e-6)
    assert frames.gate_levels(np.zeros((2, 300)))[0].tolist() == [[1, 1], [1, 1]]


@pytest.mark.parametrize("gain", [0.0, 0.8, frames.GATED])
def test_gains_are_taken_off_again(gain):
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.standard_normal((5, 700)), -1) + 5
    flat, side = frames._sides(x, gain)
    head = frames.FrameHead(False, 0.1, 700, 5, frames.shape_of(5, 700), 0, 0, gain)
    assert len(side) == frames._side_bytes(head) and np.allclose(frames._restored(flat, head, side), x, rtol=1e-12)


@pytest.mark.parametrize("blocks, message", [((0, 8, 8, 8), "multiple of 8"), ((8, -8, 8, 8), "multiple of 8"), ((12, 8, 8, 8), "multiple of 8"), ((8, 8, 16, 8), "divide"), ((24, 16, 16, 16), "divide"), ((8, 8, 8, 4), "one of"), ((8, 32768, 8, 8), "16 bits")])
def test_blocks_that_cannot_be(blocks, message):
    with pytest.raises(ValueError, match=message):
        frames.Shape(*blocks)


def test_blocks_by_policy(spark):
    from strandworks.functions import scalar

    n = spark.range(1, 700).select(F.col("id").cast("int").alias("n"))
    rows = n.select("n", scalar.block_size(F.col("n"), "fastest").alias("fast"), scalar.block_size(F.col("n"), "max").alias("tight")).collect()
    assert all((frames.block_size(r["n"], True), frames.block_size(r["n"])) == (r["fast"], r["tight"]) for r in rows)
    assert frames.shape_of(32, 1000) == frames.Shape(32, 256, 16, 16) and frames.shape_of(20, 64, True) == frames.Shape(24, 32, 8, 8)
    for odd in ((0, 5), (5, 0)):
        with pytest.raises(ValueError):
            frames.shape_of(*odd)
        with pytest.raises(ValueError):
            frames.FIXED.padded(*odd)


def test_frame_heads():
    for exponent, size in ((0.0, 28), (0.75, 32), (frames.GATED, 32)):
        for raw in (False, True):
            head = frames.FrameHead(raw, 0.125, 1000, 7, frames.Shape(8, 256, 8, 16), 12, 34, exponent)
            data = head.bytes()
            assert len(data) == size and frames.frame_head(data + b"more") == (head, size)
            assert frames.frame_head(head.updated(99, 100).bytes())[0] == head.updated(99, 100)
            for cut in range(size):
                with pytest.raises(ValueError):
                    frames.frame_head(data[:cut])
    with pytest.raises(ValueError, match="begins no frame"):
        frames.frame_head(bytes(40))
    with pytest.raises(ValueError, match="sizes"):
        frames.frame_head(frames.FrameHead(False, 0.1, 0, 7, frames.FIXED, 0, 0).bytes())


def test_codes_come_back():
    rng = np.random.default_rng(3)
    for spread in (1, 40, 256):
        data = bytes((rng.integers(0, spread, 3000) * rng.integers(0, 2, 3000)).astype(np.uint8))
        counts = {int(s): int(n) for s, n in zip(*np.unique(np.frombuffer(data, np.uint8), return_counts=True))} | {entropy.END: 1}
        codes = entropy.Codes(counts)
        packed = codes.encode(data)
        assert codes.decode(packed) == data and len(packed) * 8 - 8 < sum(n * codes.table[s][1] for s, n in counts.items()) <= len(packed) * 8
    lone = entropy.Codes({entropy.END: 1})
    assert lone.decode(lone.encode(b"")) == b""
    with pytest.raises(ValueError):
        lone.encode(b"x")
    skewed = entropy.Codes({s: 2**s for s in range(40)} | {entropy.END: 1})  # codes of 40 bits
    assert skewed.decode(skewed.encode(bytes(range(40)))) == bytes(range(40))


def test_header_fields_come_back():
    bits = lambda f: np.array(f, np.float32).view(np.int32).tolist()
    columns = [bits(np.arange(2, 9) * 0.5), [5] * 9 + list(range(20)) + list(range(30, 0, -3)), [-1, 3, 2, 7], [], [4], bits([1.5, 1.5, np.nan, 2.0])]
    assert [k[0] for k in headers.runs(columns[0])] == ["float"]
    assert [k[0] for k in headers.runs(columns[1])][:3] == ["const", "ascending", "delta"]
    assert frames.header_columns(frames.header_body(columns), len(columns)) == columns
    codes = entropy.Codes({s: 1 for s in range(257)})
    same = [c for c in columns if len(c) == 4] or [[1, 2], [3, 4]]
    for remute in (False, True):
        data = frames.header_payload(same, remute, frames.header_body(same), codes)
        assert frames.header_fields(data, codes) == ((same[:-1], same[-1]) if remute else (same, None))
    with pytest.raises(ValueError, match="begins no headers"):
        frames.header_fields(b"x" * 40, codes)
    with pytest.raises(ValueError, match="another number"):
        frames.header_fields(frames.header_payload([[1], [1, 2]], False, frames.header_body([[1], [1, 2]]), codes), codes)
    rng = np.random.default_rng(4)
    for _ in range(100):
        values = np.concatenate([np.arange(int(rng.integers(1, 9))) * int(rng.integers(-3, 4)) + int(rng.integers(-99, 99)) for _ in range(6)] + [bits(np.float32(rng.random()) + np.float32(rng.random()) * np.arange(5, dtype=np.float32))]).tolist()
        assert [x for r in headers.runs(values) for x in headers.expand(*r)] == values


def test_float_headers_expand_in_spark(spark):
    bits = np.array([1.0, 1.5, 2.0, 2.5, 3.0, 3.5], np.float32).view(np.int32).tolist()
    df = spark.createDataFrame([(1, 0, bits), (1, 1, [7]), (2, 0, [])], "frame_no int, field_no int, values array<int>")
    assert {(r[0], r[1]): r[2] for r in headers.expanded(df).collect()} == {(1, 0): bits, (1, 1): [7], (2, 0): []}


def test_frames_of_odd_traces(spark):
    row = lambda place, v, n=N1: (1, place, [v] * n)
    make = lambda rows: lapped.frames(spark.createDataFrame(rows, "frame_no int, trace_in_frame int, samples array<float>")).collect()
    (got,) = make([row(0, 1.0), row(0, 2.0), row(0, 1.0), row(31, 3.0, 5), (1, 4, None)])
    grid = np.array(got["grid"]).reshape(N2, N1)
    assert got["live"] == 3 and grid[0].tolist() == [2.0] * N1 and grid[31].sum() == 15 and not grid[1:31].any()
    for bad in (row(32, 1.0), row(-1, 1.0), row(0, 1.0, N1 + 1)):
        with pytest.raises(Exception, match="doesn't fit"):
            make([bad])
    long = spark.createDataFrame([([1.0] * 65,)], "x array<double>")
    with pytest.raises(Exception, match="more than 64"):
        lapped.apply_matrix(long, "x", np.eye(64), "y").collect()
    assert make([]) == []


def frame_rows(x, odd=()):
    """Rows (volume, frame_no, trace_in_frame, samples, key) of grids; the k-th frame lacks its last k traces."""
    return [(f % 2, f, t, x[f][t].tolist(), 40 + f) for f in range(len(x)) for t in range(len(x[f]) - f)] + list(odd)


SCHEMA = "volume int, frame_no int, trace_in_frame int, samples array<float>, key int"


@pytest.mark.parametrize("how", [{}, {"gain": 0.5}, {"gain": frames.GATED, "remute": True}, {"shape": frames.FIXED}])
def test_frames_through_bytes(spark, how):
    x = grids(3).astype(np.float32)
    x[1, 3, 5] = 9.0  # an amplitude out of bounds: this frame goes out raw
    x[2, :, :7] = 0
    framed = frames.gathered(spark.createDataFrame(frame_rows(x), SCHEMA), ["key"])
    packed, tables = frames.compress(framed, 0.01, limit=0.45, **how)
    got = {r["frame_no"]: r for r in frames.uncompress(packed, tables).collect()}
    assert [got[f]["coded"] for f in range(3)] == [True, False, True]
    sizes = {r["frame_no"]: len(r["payload"]) for r in packed.collect()}
    assert sizes[0] < N1 * N2 and sizes[1] > 4 * N1 * (N2 - 1)
    for f in range(3):
        n, want = N2 - f, x[f, : N2 - f]
        z = np.array(got[f]["grid"]).reshape(n, N1)
        assert (got[f]["volume"], got[f]["traces"], got[f]["samples"]) == (f % 2, n, N1)
        assert got[f]["fields"] == [list(range(n)), [40 + f] * n]
        assert (z == want).all() if f == 1 else np.abs(z - want)[:, 1:].max() < 0.05
        if how.get("remute") and f == 2:
            assert not z[:, :7].any()
    assert tables == frames.Tables.of(tables.bytes())


def test_odd_frames_through_bytes(spark):
    nan = float("nan")
    odd = [(9, 1, 0, None, None), (9, 1, 1, [1.0, None, 2.0], 5), (9, 2, 0, [], 1), (9, 3, None, [1.0], 1), (9, 3, None, [2.0], 1), (9, 3, 4, [nan], 2), (None, None, 0, [1.0, 2.0], 3), (9, 4, 0, [0.0] * 300, 1), (9, 4, 5, [1.0], -7), (9, 5, 0, [1.0], 1), (9, 5, 0, [2.0, 3.0], 1)]
    framed = frames.gathered(spark.createDataFrame(odd, SCHEMA).withColumn("rows", F.lit("x")), ["key"])
    packed, tables = frames.compress(framed, 1e-4, gain=frames.GATED, remute=True)
    got = {(r["volume"], r["frame_no"]): r for r in frames.uncompress(packed, tables).collect()}
    near = lambda k, v: np.allclose(got[k]["grid"], v, atol=1e-3)
    assert not got[9, 1]["coded"] and np.isnan(got[9, 1]["grid"][4]) and got[9, 1]["fields"] == [[0, 1], [0, 5]]
    assert near((9, 2), [0.0]) and near((None, None), [1.0, 2.0])
    assert got[9, 3]["traces"] == 2 and got[9, 3]["fields"] == [[0, 4], [1, 2]]
    assert near((9, 4), [0.0] * 300 + [1.0] + [0.0] * 299) and got[9, 4]["fields"] == [[0, 5], [1, -7]]
    assert near((9, 5), [2.0, 3.0]) and len(got) == 6
    empty = frames.gathered(spark.createDataFrame([], SCHEMA), ["key"])
    none, tables = frames.compress(empty)
    assert frames.uncompress(none, tables).count() == 0


def test_damaged_frames(spark):
    packed, tables = frames.compress(frames.gathered(spark.createDataFrame(frame_rows(grids(1)), SCHEMA), ["key"]))
    (r,) = packed.collect()
    codes = tables.codes()
    with pytest.raises(ValueError, match="states"):
        frames.restored(bytes(r["payload"][:-1]), codes[0])
    head, size = frames.frame_head(bytes(r["payload"]))
    short = codes[0].encode(b"1234")
    with pytest.raises(ValueError, match="cut short"):
        frames.restored(head.updated(size + len(short), 0).bytes() + short, codes[0])


def test_fields_are_coded_a_slice_at_a_time(spark):
    """However long Spark's batches are, a task makes runs of a bounded number of fields at once."""
    import pyarrow as pa

    class Frame:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    rows = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int32()), pa.array([0] * 1000, pa.int32()), pa.array([[k + 10, 5, 5, 5, 5] for k in range(1000)], pa.list_(pa.int64()))], ["frame_no", "field_no", "values"])
    for operator, each in ((headers.coded, 2), (headers.expanded, 1), (headers.packed, 1)):
        got = [b.num_rows for b in operator(Frame())([rows])]
        assert sum(got) == 1000 * each and max(got) <= headers.SLICE_ROWS * each

"""Properties that hold whatever the data: orthonormal transforms, exact coders, round trips, and the eleven header vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandworks.functions import lot, order
from strandworks.functions.scalar import block_size, html_escaped, nint
from strandworks.operators import entropy, frames, gain, headers, lapped, quant, select
from strandworks.sources import segy


@pytest.mark.parametrize("length", [8, 16])
@pytest.mark.parametrize("blocks", [1, 2, 8])
def test_transform_is_orthonormal(length, blocks):
    m = lot.matrix(length * blocks, length)
    assert np.abs(m @ m.T - np.eye(len(m))).max() < 1e-12


@pytest.mark.parametrize("n2,n1,length", [(16, 24, 8), (8, 8, 8), (32, 64, 16)])
def test_frames_come_back(spark, n2, n1, length):
    rng = np.random.default_rng(0)
    rows = [(0, t, rng.uniform(-50, 50, n1).tolist()) for t in range(n2 - 1)]
    df = frames_of = lapped.frames(spark.createDataFrame(rows, "frame_no int, trace_in_frame int, samples array<double>"), n2, n1)
    y = lapped.transform_frames(frames_of, "grid", length, "y", n2=n2, n1=n1)
    z = lapped.transform_frames(y, "y", length, "z", inverse=True, n2=n2, n1=n1).first()
    assert df.first()["live"] == n2 - 1
    assert np.allclose(z["grid"], z["z"])
    assert np.isclose(np.square(z["grid"]).sum(), np.square(z["y"]).sum())


def _tokens(q):
    out, k = [], 0
    while k < len(q):
        n = 0
        while k + n < len(q) and q[k + n] == 0:
            n += 1
        out.append((k, n, 0) if n else (k, 0, q[k]))
        k += n or 1
    return out


def test_run_tokens(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.integers(-3, 4, 20) * (rng.random(20) < 0.5) * 40).astype(int).tolist()) for k in range(50)] + [(50, [0] * 20), (51, [7] * 20), (52, [])]
    df = spark.createDataFrame(rows, "k int, q array<int>").withColumn("n", quant.extent(F.col("q")))
    for r in df.withColumn("t", quant.runs(F.col("q"), F.col("n"))).collect():
        last = max([i + 1 for i, v in enumerate(r["q"]) if v], default=0)
        assert r["n"] == last + last % 2
        assert [(t["place"], t["run"], t["value"]) for t in r["t"]] == _tokens(r["q"][: r["n"]])


@pytest.mark.parametrize("value,size", [(1, 1), (74, 1), (75, 2), (-73, 1), (-74, 2), (255, 2), (256, 3), (-65535, 3), (65536, 5)])
def test_literal_bytes(spark, value, size):
    assert spark.range(1).select(quant.literal_bytes(F.lit(value))).first()[0] == size


@pytest.mark.parametrize("run,size", [(1, 1), (100, 1), (101, 2), (255, 2), (256, 3), (65535, 3), (65536, 4), (131070, 6)])
def test_zero_run_bytes(spark, run, size):
    assert spark.range(1).select(quant.zero_run_bytes(F.lit(run))).first()[0] == size


BITS = lambda *v: np.array(v, np.float32).view(np.int32).tolist()
#: Fixed vectors: values and how many numbers code them (a literal 1; a constant, rising or falling run 3; others 4).
VECTORS = [
    ([0, 1, -1, 2, -2, 3, -3, 4, -4], 9),
    ([0, 0, 0, 1, -1, 2, -2, 3, 3, 3, -3, 4, -4], 13),
    ([0, 0, 0, 0, 1, -1, 2, -2, 3, 3, 3, -3, 4, -4], 13),
    ([0, 0, 0, 0, 1, 2, 3, 4, -1, 2, -2, -3, -4, -5, 3, 3, 3, -3, 4, -4], 17),
    ([*range(-2, 17, 2)], 4),
    ([*range(-2, -30, -3)], 4),
    ([1, 2, 4, 6, 8, 10, 12, 14, 16, 17], 6),
    (BITS(*range(1, 72, 10)), 4),
    (BITS(*range(10000010, 10000711, 100)), 4),
    (BITS(*range(100000010, 100000711, 100)), 8),
    (BITS(*range(-1, -702, -100)), 4),
]


@pytest.mark.parametrize("values,length", VECTORS)
def test_header_vectors(values, length):
    found = headers.runs(values)
    assert sum({"literal": 1, "delta": 4, "float": 4}.get(k, 3) for k, *_ in found) == length
    assert [v for r in found for v in headers.expand(*r)] == values


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(-5, 5) | st.integers(-(2**31), 2**31 - 1), max_size=60))
def test_header_runs_come_back(values):
    assert [v for r in headers.runs(values) for v in headers.expand(*r)] == values


@settings(deadline=None, max_examples=200)
@given(st.binary(max_size=300))
def test_huffman_comes_back(data):
    counts = {s: data.count(s) for s in set(data)} | {entropy.END: 1}
    table = entropy.code_table(counts)
    codes = entropy.Codes(counts)
    assert codes.table == table and codes.decode(codes.encode(data)) == data
    assert len(counts) == 1 or sum(2.0**-b for _, b in table.values()) == 1


def test_gates(spark):
    n = 1051
    ramp = [(n - i) * 1000.0 for i in range(n)]
    df = spark.createDataFrame([(0, ramp)], "k int, x array<double>")
    a = df.withColumn("mean", gain.gate_amplitudes(F.col("x"))).withColumn("decay", gain.decaying(F.col("mean")))
    r = a.withColumn("gain", gain.gate_gain(F.col("decay"), F.size("x"))).first()
    assert len(r["gain"]) == n and len(r["mean"]) == 5
    assert all(x >= y for x, y in zip(r["decay"], r["decay"][1:]))
    assert min(r["gain"]) > 0


def test_one_gate_and_silence(spark):
    df = spark.createDataFrame([(0, [0.0] * 10)], "k int, x array<double>")
    r = df.withColumn("a", gain.gate_amplitudes(F.col("x"))).withColumn("l", gain.gate_levels(F.col("a"))).first()
    assert r["a"] == [0.0] and r["l"] == [1.0]


def test_bad_amplitudes(spark):
    rows = [([1.0, float("nan")],), ([float("inf")],), ([-1e16],), ([1.0, -2.0],), ([],)]
    df = spark.createDataFrame(rows, "x array<double>")
    assert [r[0] for r in df.select(select.has_bad_amplitude(F.col("x"))).collect()] == [True, True, True, False, False]


def test_ranges(spark):
    v = F.col("id")
    pick = lambda c: [r[0] for r in spark.range(20).where(c).collect()]
    assert pick(select.in_range(v, 3, 12, 4)) == [3, 7, 11]
    assert pick(select.in_range(v, None, 12, 4)) == [0, 4, 8, 12]
    assert pick(select.in_range(v)) == list(range(20))


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(nint(F.lit(x))) for x in (0.5, -0.5, 1.49, -1.5, 0.0)] == [1, -1, 1, -2, 0]
    assert [one(block_size(F.lit(n), "fastest")) for n in (8, 9, 32, 48, 64, 65)] == [8, 16, 32, 24, 32, 64]
    assert one(block_size(F.lit(5000), "max", 512)) == 512
    assert one(html_escaped(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"


def test_segments_and_sums_over_stretches(spark):
    rng = np.random.default_rng(3)
    ids = sorted(rng.choice(10_000, 700, replace=False).tolist())
    keys = rng.integers(0, 3, 700).tolist()
    df = spark.createDataFrame(list(zip(ids, keys)), "id long, key int")
    want, frame, last, total = [], 0, None, 0
    for i, k in zip(ids, keys):
        frame, last, total = frame + (k != last), k, total + k
        want.append((i, frame, total))
    s = frames.segmented(df, "id", "key")
    got = order.with_running_sum(s, "id", {"total": "key"}).select("id", "frame_no", "total").orderBy("id").collect()
    assert [tuple(r) for r in got] == want


def test_an_empty_table_has_no_segments(spark):
    df = spark.createDataFrame([], "id long, key int")
    assert frames.segmented(df, "id", "key").count() == 0


def test_trace_files(spark, tmp_path):
    rows = [(k, k % 3, [float(k + i) for i in range(5)]) for k in range(10)]
    df = spark.createDataFrame(rows, "trace_id long, frame_key int, samples array<float>").repartition(2)
    manifest = segy.write_segy(df, (tmp_path / "f").as_uri(), n1=5, n2=7)
    assert {r["samples"] for r in segy.headers_of(manifest).collect()} == {5}
    got = sorted((r["trace_id"], r["frame_key"], list(r["samples"])) for r in segy.read_segy(manifest).collect())
    assert got == rows
    with pytest.raises(ValueError):
        segy.parse_header(b"short")


def test_an_empty_table_writes_no_file(spark, tmp_path):
    df = spark.createDataFrame([], "trace_id long, frame_key int, samples array<float>")
    assert segy.read_segy(segy.write_segy(df, (tmp_path / "f").as_uri())).count() == 0


def test_headers_of_several_files_are_told_once(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    manifest = segy.write_segy(e.selectExpr("vec_id AS trace_id", "label AS frame_key", "embedding AS samples").repartition(3), (tmp_path / "f").as_uri())
    assert manifest.count() == 3
    assert [tuple(r) for r in segy.src_segy_header(spark, str(tmp_path)).collect()] == [(32, 4.0, 64)]

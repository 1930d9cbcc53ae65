"""Files of compressed frames as a data source: ranges, bytes read, lost attempts, files that are damaged."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.plans import frames
from strandworks.sources import syz
from strandworks.streaming.streams import folder


def rows(volumes=4, per=6):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.standard_normal((volumes, per, 5, 40)), -1)
    return [(v, f, t, x[v, f, t].tolist(), 10 * v + f) for v in range(volumes) for f in range(per) for t in range(1 + f % 5)]


@pytest.fixture(scope="module")
def packed(spark):
    df = spark.createDataFrame(rows(), "volume long, frame_no long, trace_in_frame int, samples array<float>, key long")
    framed = frames.gathered(df, ["key"])
    return frames.compress(framed, 1e-3, gain=frames.GATED)


@pytest.fixture
def path(spark, packed):
    path = folder(spark, "syz-test")
    syz.write_frames(*packed, path, parts=3, most_bytes=4000)
    return path


def local(path):
    return path.removeprefix("file:").replace("//", "/")


def test_frames_come_back(spark, packed, path):
    got = {(r["volume"], r["frame_no"]): r for r in syz.read_frames(spark, path).collect()}
    want = {(r["volume"], r["frame_no"]): r for r in frames.uncompress(*packed).collect()}
    assert got.keys() == want.keys() and len(got) == 24
    for k, r in got.items():
        assert r["grid"] == want[k]["grid"] and r["fields"] == want[k]["fields"] and (r["traces"], r["samples"]) == (1 + k[1] % 5, 40)
    files = syz.listed(path)
    assert sum(f["frames"] for f in files) == 24 and len(files) > 4  # large volumes are several files


@pytest.mark.parametrize("test", ["volume = 2", "volume = 2 and frame_no between 2 and 3", "frame_no = 5", "frame_no in (1, 4) and volume > 1", "volume >= 3 and frame_no < 2", "frame_no <=> 0 and volume <= 1", "volume = 9", "frame_no > 3 and traces = 5", "volume = 1 or frame_no = 1", "volume = null", "frame_no + volume = 3"])
def test_filters_reach_the_files(spark, path, test):
    whole = syz.read_frames(spark, path).select("volume", "frame_no", "traces", "bytes_read")
    want = sorted(r for r in map(tuple, whole.select("volume", "frame_no").where(F.expr(test.replace("volume", "(volume + 0)").replace("frame_no", "(frame_no + 0)"))).collect()))
    got = whole.where(test)
    assert sorted(map(tuple, got.select("volume", "frame_no").collect())) == want


def test_bytes_read_follow_the_range(spark, path):
    at = local(path)
    files = syz.listed(path)
    beside = {f["name"]: f["bytes"] for f in files}
    read = lambda test, **how: syz.read_frames(spark, path, **how).where(test).agg(F.sum("bytes_read")).first()[0] or 0
    everything = read("true")
    assert everything <= sum(os.path.getsize(f"{at}/{n}") for n in beside) and everything >= 0.9 * sum(beside.values()) - 4200 * len(files)
    sizes = {(r["volume"], r["frame_no"]): 8 + r["header_bytes"] + r["trace_bytes"] for r in syz.read_frames(spark, path, grids=False).collect()}
    fixed = 8 + 3600 + 2 * 257 * 8 + 20
    for low, high in ((2, 3), (0, 0), (1, 5)):
        wanted = [f for f in files if f["volume"] == 1 and f["first"] <= high and f["last"] >= low]
        own = sum(v for (vol, f), v in sizes.items() if vol == 1 and low <= f <= high)
        assert read(f"volume = 1 and frame_no between {low} and {high}") == own + sum(fixed + 32 * f["frames"] for f in wanted)
    assert read("true", grids=False) == sum(fixed - 2 * 257 * 8 + 64 * f["frames"] for f in files)
    plan = syz.read_frames(spark, path).where("volume = 1")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_cut_and_foreign_files(spark, path):
    name = local(path) + "/" + syz.listed(path)[0]["name"]
    with open(name, "rb") as f:
        whole = f.read()

    def reads(data, message):
        with open(name, "wb") as f:
            f.write(data)
        os.path.exists(c := f"{os.path.dirname(name)}/.{os.path.basename(name)}.crc") and os.remove(c)
        with pytest.raises(Exception, match=message):
            syz.read_frames(spark, path).collect()

    for cut in (len(whole) - 1, len(whole) // 2, 100, 0):
        reads(whole[:cut], "cut short")
    reads(struct.pack(">i", 1) + whole[4:], "no compressed frames")
    with pytest.raises(Exception, match="no compressed frames"):
        syz.files_of(spark, path).collect()
    at = 8 + 3600 + 2 * 257 * 8
    reads(whole[:at] + b"\0\0\0\1" + whole[at + 4 :], "other sizes")


def test_unlisted_files_and_more_writes(spark, packed, path):
    first = syz.listed(path)
    with open(f"{local(path)}/SOURCE_1-lost.syz", "wb") as f:
        f.write(b"half a file")
    assert syz.read_frames(spark, path).count() == 24
    df, tables = packed
    syz.write_frames(df.where("volume = 3"), tables, path)
    assert syz.read_frames(spark, path).where("volume = 3").count() == 12 and syz.read_frames(spark, path).count() == 30
    syz.write_frames(df.where("volume = 0"), tables, path, overwrite=True)
    assert {r["volume"] for r in syz.read_frames(spark, path).collect()} == {0}
    assert not any(os.path.exists(f"{local(path)}/{f['name']}") for f in first)


def test_failed_writes_leave_nothing(spark, packed):
    path = folder(spark, "syz-failed")
    df, tables = packed
    with pytest.raises(Exception, match="needs a volume"):
        syz.write_frames(df.union(df.limit(1).withColumn("volume", F.lit(None).cast("long"))), tables, path, parts=1)
    assert syz.listed(path) == []
    with pytest.raises(Exception, match="need the columns"):
        syz.write_frames(df.drop("head"), tables, path)


def test_no_frames(spark, packed):
    path = folder(spark, "syz-empty")
    df, tables = packed
    syz.write_frames(df.where("false"), tables, path)
    assert syz.read_frames(spark, path).count() == 0 and syz.files_of(spark, path).count() == 0
    assert json.dumps(syz.listed(path)) == "[]"

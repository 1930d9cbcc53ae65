"""Mel spectrograms, audio files, and lookups by block index."""

import os
import struct

import numpy as np
import pytest

from oracle import assert_same, connect
from strandworks import registry
from strandworks.operators import spectral
from strandworks.sources import blocks, wav
from strandworks.streaming.streams import folder


def test_mel_of_a_larger_table(spark):
    folder_ = "/root/testdata/sf0.01"
    assert_same(registry.queries()["mel_long"](spark, folder_), connect(folder_), registry.oracle_sql()["mel_long"])


@pytest.mark.parametrize("settings", [spectral.TREMOR, spectral.AUDIO])
@pytest.mark.parametrize("n", [1, 255, 1000, 25_000])
def test_mel_power_by_direct_sums(settings, n, monkeypatch):
    monkeypatch.setattr(spectral, "FRAMES_AT_ONCE", 3)  # stretches
    rate, frame, hop, count, low, high = settings
    x, bands = np.random.default_rng(n).standard_normal(n), spectral.slaney_bands(rate, frame, count, low, high)
    got = spectral.mel_power(x, frame, hop, bands)
    assert got.shape == (1 + n // hop, count)
    k, j = np.arange(frame // 2 + 1)[:, None], np.arange(frame)
    for f in {0, len(got) // 2, len(got) - 1}:
        part = np.array([x[i] if 0 <= i < n else 0 for i in range(f * hop - frame // 2, f * hop + frame // 2)]) * (0.5 - 0.5 * np.cos(2 * np.pi * j / frame))
        power = (part * np.cos(2 * np.pi * k * j / frame)).sum(1) ** 2 + (part * np.sin(2 * np.pi * k * j / frame)).sum(1) ** 2
        assert np.allclose(got[f], bands @ power, rtol=1e-8, atol=1e-9)


def test_bands_have_their_edges():
    b = spectral.slaney_bands(22_050.0, 2048, 128, 0.0, 11_025.0)
    centres = b.argmax(1) * 22_050 / 2048
    assert (np.diff(centres) >= 0).all() and abs(centres[-1] - 10_800) < 300 and b.min() == 0
    assert np.allclose(b[20:].sum(1) * 22_050 / 2048, 1, atol=0.1)  # equal areas


def test_spectrograms_of_odd_arrays(spark):
    rows = [(1, [1.0] * 300), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan")]), (6, [0.0] * 20), (7, [float(k % 17) for k in range(12_000)])]
    df = spark.createDataFrame(rows, "id int, x array<double>").selectExpr("*", "'z' as db", "'z' as frames")
    got = {r["id"]: r for r in spectral.mel_spectrograms(df, "x").collect()}
    assert [got[k]["frames"] for k in range(1, 8)] == [31, None, None, None, None, 3, 1201]
    assert max(got[7]["db"]) == 0 and min(got[7]["db"]) >= -80 and len(got[7]["db"]) == 1201 * 128 and set(got[6]["db"]) == {0.0}


@pytest.mark.parametrize("bits", [8, 16, 24, 32, -32, -64])
@pytest.mark.parametrize("channels", [1, 2])
def test_audio_comes_back(bits, channels):
    x = np.random.default_rng(1).uniform(-1, 1, (101, channels))
    rate, got = wav.parse_wav(wav.wav_bytes(x, 44_100, bits))
    assert rate == 44_100 and got.shape == x.shape and np.abs(got - x).max() <= {8: 2**-7, 16: 2**-15, 24: 2**-23, 32: 2**-31, -32: 2**-24, -64: 0}[bits]


def test_broken_audio():
    good = wav.wav_bytes(np.zeros(10), 8000)
    assert wav.parse_wav(good[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + good[12:])[1].shape == (10, 1)
    for bad in (b"", b"RIFF", b"x" * 60, good[:30], good[:-1], good[:12], good[:12] + good[36:], good[:20] + b"\x07" + good[21:], good[:34] + b"\x0b" + good[35:]):
        with pytest.raises(ValueError):
            wav.parse_wav(bad)


@pytest.mark.parametrize("rate", [8000, 16_000, 44_100, 22_050, 11_025, 48_000])
def test_resampling_is_a_direct_sum(rate):
    x = np.random.default_rng(2).standard_normal(300)
    y = wav.resampled(x, rate)
    assert len(y) == -(-300 * 22_050 // rate)
    if rate == wav.RATE:
        assert (y == x).all()
        return
    cutoff = min(1, wav.RATE / rate)
    half = int(np.ceil(wav.CROSSINGS / cutoff))
    for n in range(0, len(y), 37):
        t = np.arange(300) - n * rate / wav.RATE
        h = cutoff * np.sinc(cutoff * t) * np.where(np.abs(t) < half, 0.5 + 0.5 * np.cos(np.pi * t / half), 0)
        assert abs(y[n] - (h * x).sum()) < 1e-9
    tone = np.sin(2 * np.pi * 440 * np.arange(4000) / rate)
    z = wav.resampled(tone, rate)
    want = np.sin(2 * np.pi * 440 * np.arange(len(z)) / wav.RATE)
    assert np.abs(z - want)[200:-200].max() < 0.01


def test_unreadable_audio_is_told(spark):
    path = folder(spark, "audio-odd")
    at = path.removeprefix("file:").replace("//", "/")
    os.makedirs(f"{at}/sub")
    stereo = np.column_stack([np.ones(50), -np.ones(50)]) * 0.5
    for name, data in (("a.wav", wav.wav_bytes(stereo, 22_050)), ("sub/b.wav", b"junk"), ("c.wav", b"R"), ("none.wav", b""), ("d.txt", b"no audio"), ("e.wav", wav.wav_bytes(np.zeros(0), 8000))):
        with open(f"{at}/{name}", "wb") as f:
            f.write(data)
    got = {r["uri"].rpartition("/")[2]: r for r in wav.read_audio(spark, path).collect()}
    assert set(got) == {"a.wav", "b.wav", "c.wav", "e.wav"} and got["a.wav"]["channels"] == 2 and not any(got["a.wav"]["samples"])
    assert got["b.wav"]["error"] and got["c.wav"]["error"] and got["e.wav"]["samples"] == []


@pytest.fixture(scope="module")
def listed(spark):
    rows = [(k * 3 - 500, [float(k), 0.5]) for k in range(1000)] + [(None, [1.0]), (7, None), (-500, [-9.0])]
    return blocks.write_blocks(spark.createDataFrame(rows, "k long, x array<float>"), "k", "x", folder(spark, "blocks"), parts=5, block=16)


def test_lookups_by_block(spark, listed):
    assert listed.count() == 5
    asked = [-500, -499, -497, 7, 10, 2497, 2500, None, 10, 10**12, -(10**12)]
    got = {r["key"]: r for r in blocks.look_up(spark.createDataFrame([(k,) for k in asked], "k long"), "k", listed).collect()}
    assert set(got) == set(asked) - {None}
    assert {k: r["values"] and list(r["values"]) for k, r in got.items()} == {k: [float((k + 500) // 3), 0.5] if (k + 500) % 3 == 0 and -500 <= k < 2500 else None for k in got}


def test_lookups_read_their_blocks_alone(spark, listed):
    keys = lambda *k: blocks.look_up(spark.createDataFrame([(x,) for x in k], "k long"), "k", listed)
    read = lambda *k: sum(r["bytes_read"] for r in keys(*k).collect())
    block = 16 * (12 + 8)
    fixed = {r["uri"]: 32 + 16 * -(-r["records"] // 16) + (10 * r["records"] + 7) // 8 for r in listed.collect()}
    assert read(-500) - block in fixed.values() and read(-500, -497) == read(-500)
    assert read(-499) in fixed.values()  # the filter knows that it isn't there
    assert read(10**9) == 0
    sizes = sum(os.path.getsize(u.removeprefix("file:").replace("//", "/")) for u in fixed)
    assert read(*range(-500, 2500, 3)) <= sizes


def test_files_without_an_index(spark, listed):
    uri = sorted(r["uri"] for r in listed.collect())[0]
    path = uri.removeprefix("file:").replace("//", "/")
    with open(path, "rb") as f:
        whole = f.read()
    try:
        for data, message in ((whole[:-1], "no block index"), (b"x", "cut short")):
            with open(path, "wb") as f:
                f.write(data)
            with pytest.raises(ValueError, match=message):
                blocks.found_in(path, [1])
    finally:
        with open(path, "wb") as f:
            f.write(whole)
    with pytest.raises(ValueError, match="comes after"):
        blocks.write_file(path + ".other", iter([(2, [1.0]), (2, [1.0])]))
    none = blocks.write_blocks(spark.createDataFrame([], "k long, x array<float>"), "k", "x", folder(spark, "blocks"))
    assert [tuple(r) for r in blocks.look_up(spark.createDataFrame([(1,)], "k long"), "k", none).collect()] == [(1, None, 0)]

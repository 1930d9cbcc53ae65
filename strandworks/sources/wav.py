"""Audio files: a reader and a sink of RIFF waveforms, and resampling to 22,050 Hz mono. A file that can't be read is a row with an error, not a failed job."""

from __future__ import annotations

import math
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lapped import worker_path
from ..registry import query
from ..streaming.streams import folder
from ..tables import sql, traces
from .segy import opened

RATE = 22_050
#: Zero crossings of the filter on either side, and output samples worked on at once.
CROSSINGS, AT_ONCE = 16, 1 << 16
PCM, FLOAT, EXTENSIBLE = 1, 3, 65534


def wav_bytes(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A file of samples (n, or n x channels) between -1 and 1: 8, 16, 24 or 32 bits (whole numbers), or -32 or -64 (floats). Larger samples are clipped in whole numbers."""
    x = np.asarray(x, float)
    channels = 1 if x.ndim == 1 else x.shape[1]
    size = abs(bits) // 8
    if bits < 0:
        raw = x.astype(f"<f{size}").tobytes()
    else:
        whole = np.clip(np.floor(x * (1 << bits - 1) + 0.5), -(1 << bits - 1), (1 << bits - 1) - 1).astype("<i8")
        raw = (whole + 128 if bits == 8 else whole).reshape(-1, 1).view(np.uint8)[:, :size].tobytes()
    head = struct.pack("<HHIIHH", FLOAT if bits < 0 else PCM, channels, rate, rate * channels * size, channels * size, 8 * size)
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body = b"WAVE" + chunk(b"fmt ", head) + chunk(b"data", raw)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (n x channels) of a file; chunks it doesn't need are passed over. Raises ValueError for what is no such file or is cut short."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF waveform")
    at, head = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError(f"the chunk {name.decode(errors='replace')!r} is cut short")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("the format is cut short")
            kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind == EXTENSIBLE and size >= 26:
                kind = struct.unpack_from("<H", data, at + 32)[0]
            known = (kind == PCM and bits in (8, 16, 24, 32)) or (kind == FLOAT and bits in (32, 64))
            if not known or not channels or not rate or block != channels * bits // 8:
                raise ValueError(f"format {kind} of {bits} bits isn't known")
            head = kind, channels, rate, bits
        elif name == b"data":
            if head is None:
                raise ValueError("samples come before their format")
            kind, channels, rate, bits = head
            size -= size % (channels * bits // 8)
            raw = np.frombuffer(data, np.uint8, size, at + 8) if size else np.empty(0, np.uint8)
            if kind == FLOAT:
                x = raw.view(f"<f{bits // 8}").astype(float)
            else:
                wide = np.zeros((len(raw) * 8 // bits, 4), np.uint8)
                wide[:, 4 - bits // 8 :] = raw.reshape(len(wide), bits // 8)  # at the top, so that the sign is right
                x = wide.view("<i4")[:, 0].astype(float) / 2.0**31
                if bits == 8:
                    x = raw / 128.0 - 1
            return rate, x.reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def resampled(x: np.ndarray, rate: int, wanted: int = RATE) -> np.ndarray:
    """Samples at another rate, as many as begin before the signal's end: a sinc under a Hann window, cut off at the lower of both rates, in polyphase form (weights for each of the phases that the rates' ratio has)."""
    if rate <= 0 or wanted <= 0:
        raise ValueError("a rate must be positive")
    if rate == wanted or not len(x):
        return np.asarray(x, float)
    g = math.gcd(rate, wanted)
    up, down = wanted // g, rate // g
    cutoff = min(1.0, up / down)
    half = math.ceil(CROSSINGS / cutoff)
    n = -(-len(x) * up // down)
    wide = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    out = np.empty(n)
    for a in range(0, n, AT_ONCE):
        at = np.arange(a, min(n, a + AT_ONCE), dtype=np.int64) * down
        first, phase = np.divmod(at, up)
        phases, which = np.unique(phase, return_inverse=True)
        t = np.arange(-half + 1, half + 1) - phases[:, None] / up
        weights = cutoff * np.sinc(cutoff * t) * np.where(np.abs(t) < half, 0.5 + 0.5 * np.cos(np.pi * t / half), 0)
        taps = np.lib.stride_tricks.sliding_window_view(wide, 2 * half)[first + 1]
        out[a : a + len(at)] = np.einsum("ij,ij->i", taps, weights[which])
    return out


AUDIO = "uri string, rate int, channels int, read long, samples array<double>, error string"


def read_audio(spark: SparkSession, path: str, wanted: int | None = RATE) -> DataFrame:
    """Files of a folder (AUDIO): rate and channels as stated, samples read, and samples of the channels' mean at the wanted rate (None: as they are). A file that can't be read has an error and nothing else; files without a byte aren't listed."""
    worker_path(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rate, x = parse_wav(data.as_py())
                    mono = x.mean(1)
                    row = uri, rate, x.shape[1], len(x), mono if wanted is None else resampled(mono, rate, wanted), None
                except ValueError as e:
                    row = uri, None, None, None, None, str(e)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in AUDIO.split(", ")])

    return files.select("path", "content").mapInArrow(run, AUDIO)


def write_audio(df: DataFrame, name: str, column: str, path: str, rate: int, bits: int = 16) -> DataFrame:
    """Writes each row's array as a file name.wav in a folder of its task's attempt; returns the list (uri, name), a table in the shared folder. Null arrays are empty files."""
    spark = df.sparkSession
    worker_path(spark)

    def write(batches):
        import pyarrow as pa

        fs, base = opened(path)
        own = f"{base}/{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows:
                fs.create_dir(own, recursive=True)
            names = batch.column(0).to_pylist()
            for n, x in zip(names, batch.column(1).to_pylist()):
                with fs.open_output_stream(f"{own}/{n}.wav") as out:
                    out.write(wav_bytes(np.array(x or [], float), rate, bits))
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{own.rpartition('/')[2]}/{n}.wav" for n in names], pa.string()), pa.array(names, pa.string())], ["uri", "name"])

    made = df.select(F.col(name).cast("string"), F.col(column).cast("array<double>")).mapInArrow(write, "uri string, name string")
    kept = folder(spark, "audio-files")
    made.write.parquet(kept)
    return spark.read.schema("uri string, name string").parquet(kept)


#: The rate at which the query writes traces.
WRITTEN = 8000


@query("audio_files", sql("samples", body=f"SELECT trace_id, CAST({WRITTEN} AS INT) AS rate, CAST(count(*) AS BIGINT) AS read, CAST(ceil(count(*)*{RATE}/{WRITTEN}.0e0) AS INT) AS resampled, true AS near FROM samples GROUP BY 1"))
def audio_files(spark, d):
    """Traces written as audio files of 16 bits and read back at 22,050 Hz: samples read and made, and whether the sums of squares agree as the rates do."""
    path = folder(spark, "audio")
    t = traces(spark, d)
    listed = write_audio(t, "trace_id", "samples", path, WRITTEN)
    got = read_audio(spark, path).where("error is null")
    energy = lambda c: F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    named = got.withColumn("trace_id", F.regexp_extract("uri", r"([0-9]+)\.wav$", 1).cast("long")).join(listed.select(F.col("name").cast("long").alias("trace_id")), "trace_id")
    both = named.join(t.select("trace_id", energy("samples").alias("was")), "trace_id")
    ratio = energy("samples") * WRITTEN / RATE / F.col("was")
    return both.select("trace_id", "rate", "read", F.size("samples").alias("resampled"), ratio.between(0.7, 1.1).alias("near"))

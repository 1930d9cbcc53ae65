"""Spectra of traces: power of the discrete Fourier transform, decibels, and mel bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query
from ..tables import N1, r4, sql, traces
from .lapped import apply_matrix

RATE, MELS, LOW, HIGH = 100.0, 16, 1.0, 45.0
BINS = N1 // 2 + 1


def fourier() -> np.ndarray:
    """Cosine and sine rows of the transform's bins."""
    k, i = np.arange(BINS)[:, None], np.arange(N1)[None, :]
    return np.vstack([np.cos(2 * np.pi * k * i / N1), np.sin(2 * np.pi * k * i / N1)])


def mel_bands() -> np.ndarray:
    """Triangular bands, evenly spaced in mel, of equal area (bands x bins)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(LOW), mel(HIGH), MELS + 2) / 2595) - 1)
    f = np.arange(BINS) * RATE / N1
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def decibels(power: Column) -> Column:
    """10 log10 of an array of powers relative to its largest, from a floor of 1e-10 and down to -80."""
    db = F.transform(power, lambda p: 10 * F.log10(F.greatest(p, F.lit(1e-10))))
    return F.element_at(F.transform(F.array(db), lambda a: F.transform(a, lambda v: F.greatest(v - F.array_max(a), F.lit(-80.0)))), 1)


def power(spark, d):
    """Traces with the power of each bin."""
    t = apply_matrix(traces(spark, d), "samples", fourier(), "f")
    return t.withColumn("power", F.zip_with(F.slice("f", 1, BINS), F.slice("f", BINS + 1, BINS), lambda c, s: c * c + s * s))


_P = f"p AS (SELECT trace_id, k, pow(sum(x*cos(2*pi()*k*i/{N1}.0e0)),2)+pow(sum(x*sin(2*pi()*k*i/{N1}.0e0)),2) AS p FROM samples, range({BINS}) r(k) GROUP BY ALL)"


@query("dft_power", sql("samples", body=_P + " SELECT trace_id, CAST(k AS INT) AS k, floor(p*1e4+0.5e0)/1e4 AS power FROM p"))
def dft_power(spark, d):
    return power(spark, d).select("trace_id", F.posexplode(F.transform("power", r4)).alias("k", "power"))


@query("power_to_db", sql("samples", body=_P + ", b AS (SELECT trace_id, k, 10*log10(greatest(p,1e-10)) AS b FROM p) SELECT trace_id, CAST(k AS INT) AS k, floor(greatest(b-max(b) OVER (PARTITION BY trace_id),-80.0e0)*1e2+0.5e0)/1e2 + 0.0e0 AS db FROM b"))
def power_to_db(spark, d):
    two = lambda v: F.floor(v * 1e2 + 0.5) / 1e2 + F.lit(0.0)
    return power(spark, d).select("trace_id", F.posexplode(F.transform(decibels(F.col("power")), two)).alias("k", "db"))


_MEL = "m AS (SELECT trace_id, band, sum(p*w) AS m FROM p JOIN (VALUES " + ", ".join(f"({b}, {k}, {float(w)!r}::DOUBLE)" for (b, k), w in np.ndenumerate(mel_bands()) if w) + ") AS c(band, k, w) USING (k) GROUP BY ALL)"


@query("mel_spectrogram", sql("samples", body=_P + ", " + _MEL + ", b AS (SELECT trace_id, band, 10*log10(greatest(m,1e-10)) AS b FROM m) SELECT trace_id, CAST(band AS INT) AS band, floor(greatest(b-max(b) OVER (PARTITION BY trace_id),-80.0e0)*1e4+0.5e0)/1e4 + 0.0e0 AS db FROM b"))
def mel_spectrogram(spark, d):
    """Mel bands of each trace in decibels."""
    m = apply_matrix(power(spark, d), "power", mel_bands(), "mel")
    return m.select("trace_id", F.posexplode(F.transform(decibels(F.col("mel")), r4)).alias("band", "db"))


#: Samples of a spectrogram's frames, and from frame to frame.
FRAME, HOP = 32, 8


def short_time(n: int = N1, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Cosine and sine rows of every frame's bins, each frame under a Hann window: (2 x frames x bins) x n. Frames lie within the trace."""
    k, j = np.arange(frame // 2 + 1)[:, None], np.arange(frame)[None, :]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * j / frame)
    starts = range(0, n - frame + 1, hop)
    out = np.zeros((2, len(starts), frame // 2 + 1, n))
    for f, start in enumerate(starts):
        out[0, f, :, start : start + frame] = window * np.cos(2 * np.pi * k * j / frame)
        out[1, f, :, start : start + frame] = window * np.sin(2 * np.pi * k * j / frame)
    return out.reshape(-1, n)


@query("stft_power", sql("samples", body=f"s AS (SELECT trace_id, f, k, i-f*{HOP} AS j, x FROM samples, range({(N1 - FRAME) // HOP + 1}) a(f), range({FRAME // 2 + 1}) b(k) WHERE i-f*{HOP} BETWEEN 0 AND {FRAME - 1}), w AS (SELECT trace_id, f, k, j, x*(0.5e0-0.5e0*cos(2*pi()*j/{FRAME}.0e0)) AS x FROM s), p AS (SELECT trace_id, f, k, pow(sum(x*cos(2*pi()*k*j/{FRAME}.0e0)),2)+pow(sum(x*sin(2*pi()*k*j/{FRAME}.0e0)),2) AS p FROM w GROUP BY ALL) SELECT trace_id, CAST(f AS INT) AS frame, CAST(k AS INT) AS bin, floor(p*1e4+0.5e0)/1e4 AS power FROM p"))
def stft_power(spark, d):
    """Power of the bins of overlapping frames of each trace under a Hann window."""
    m = short_time()
    half, bins = len(m) // 2, FRAME // 2 + 1
    t = apply_matrix(traces(spark, d), "samples", m, "s")
    power = F.zip_with(F.slice("s", 1, half), F.slice("s", half + 1, half), lambda c, s: r4(c * c + s * s))
    return t.select("trace_id", F.posexplode(power).alias("at", "power")).select("trace_id", F.floor(F.col("at") / bins).cast("int").alias("frame"), (F.col("at") % bins).cast("int").alias("bin"), "power")


#: The two settings: rate, samples of a frame, from frame to frame, bands, and the bands' lowest and highest frequency.
TREMOR, AUDIO = (100.0, 256, 10, 128, 1.0, 45.0), (22_050.0, 2048, 512, 128, 0.0, 11_025.0)
#: Frames worked on at once.
FRAMES_AT_ONCE = 1024


def slaney_bands(rate: float, frame: int, bands: int, low: float, high: float) -> np.ndarray:
    """Triangular bands of equal area (bands x bins), evenly spaced in a scale that is straight up to 1000 Hz (15 mel) and logarithmic above (27 mel to 6400 Hz)."""
    step, corner = 200 / 3, 1000.0
    rise = np.log(6.4) / 27
    to_mel = lambda f: f / step if f < corner else corner / step + np.log(f / corner) / rise
    m = np.linspace(to_mel(low), to_mel(high), bands + 2)
    edges = np.where(m < corner / step, m * step, corner * np.exp(rise * (np.maximum(m, corner / step) - corner / step)))
    f = np.arange(frame // 2 + 1) * rate / frame
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_power(x: np.ndarray, frame: int, hop: int, bands: np.ndarray) -> np.ndarray:
    """Mel power (frames x bands) of one signal of any length: frames centred at every hop, zeros beyond the ends, a Hann window, the FFT. Frames are worked on in stretches that overlap by a frame's length."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    wide = np.concatenate([np.zeros(frame // 2), x, np.zeros(frame // 2)])
    n = 1 + len(x) // hop
    out = np.empty((n, len(bands)))
    for a in range(0, n, FRAMES_AT_ONCE):
        b = min(n, a + FRAMES_AT_ONCE)
        part = wide[a * hop : (b - 1) * hop + frame]
        some = np.lib.stride_tricks.sliding_window_view(part, frame)[::hop]
        out[a:b] = (np.abs(np.fft.rfft(some * window)) ** 2) @ bands.T
    return out


def mel_spectrograms(df, column: str, settings: tuple = TREMOR):
    """Adds frames, bands and db (an array, frame by frame: decibels below the largest, down to -80, from a floor of 1e-10) of an array column of any length. Null arrays, empty ones and those with a null or a number that isn't finite have null db."""
    from pyspark.sql import types as T

    from .lapped import worker_path

    worker_path(df.sparkSession)
    rate, frame, hop, count, low, high = settings
    names = [c for c in df.columns if c not in ("frames", "bands", "db")]
    ready = df.select(*names, F.col(column).cast("array<double>").alias("db"))
    bands = slaney_bands(rate, frame, count, low, high)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch.column(len(names)):
                x = None if not value.is_valid else value.values.to_numpy(zero_copy_only=False)
                if x is None or not len(x) or not np.isfinite(x.astype(float)).all():
                    rows.append((None, None))
                    continue
                db = 10 * np.log10(np.maximum(mel_power(x.astype(float), frame, hop, bands), 1e-10))
                rows.append((len(db), np.maximum(db - db.max(), -80).ravel()))
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([count] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*names, "frames", "bands", "db"])

    fields = [f for f in df.schema.fields if f.name in names]
    return ready.mapInArrow(run, T.StructType([*fields, T.StructField("frames", T.IntegerType()), T.StructField("bands", T.IntegerType()), T.StructField("db", T.ArrayType(T.DoubleType()))]))


_RATE, _FRAME, _HOP, _BANDS, _LOW, _HIGH = TREMOR
_FFT = f"n AS (SELECT trace_id, max(i)+1 AS n FROM long_samples GROUP BY 1), fr AS (SELECT trace_id, unnest(range(0, 1+n//{_HOP})) AS f FROM n), w AS (SELECT s.trace_id, f, i-f*{_HOP}+{_FRAME // 2} AS j, x*(0.5e0-0.5e0*cos(2*pi()*(i-f*{_HOP}+{_FRAME // 2})/{_FRAME}.0e0)) AS x FROM long_samples s JOIN fr ON s.trace_id=fr.trace_id AND i BETWEEN f*{_HOP}-{_FRAME // 2} AND f*{_HOP}+{_FRAME // 2 - 1}), p AS (SELECT trace_id, f, k, pow(sum(x*cos(2*pi()*k*j/{_FRAME}.0e0)),2)+pow(sum(x*sin(2*pi()*k*j/{_FRAME}.0e0)),2) AS p FROM w, range({_FRAME // 2 + 1}) b(k) GROUP BY ALL)"
_SLANEY = "m AS (SELECT trace_id, f, band, sum(p*w) AS m FROM p JOIN (VALUES " + ", ".join(f"({b}, {k}, {float(w)!r}::DOUBLE)" for (b, k), w in np.ndenumerate(slaney_bands(_RATE, _FRAME, _BANDS, _LOW, _HIGH)) if w) + ") AS c(band, k, w) USING (k) GROUP BY ALL)"


@query("mel_long", sql("long_samples", body=f"{_FFT}, {_SLANEY} SELECT trace_id, CAST(f AS INT) AS frame, CAST(band AS INT) AS band, floor(log10(greatest(m,1e-10))*1e3+0.5e0)/1e3 + 0.0e0 AS bels FROM m"))
def mel_long(spark, d):
    """Mel power of traces of a thousand samples at the settings for tremors, in bels: 128 bands of frames of 256 samples, 10 samples apart; bands without a bin are left out."""
    from ..tables import long_samples
    from .lapped import worker_path

    worker_path(spark)
    t = long_samples(spark, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    bands = slaney_bands(_RATE, _FRAME, _BANDS, _LOW, _HIGH)
    (there,) = np.nonzero(bands.any(1))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = np.log10(np.maximum(mel_power(x.values.to_numpy(zero_copy_only=False), _FRAME, _HOP, bands), 1e-10))[:, there]
                frame, band = np.repeat(np.arange(len(m)), len(there)), np.tile(there, len(m))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((np.full(len(frame), key), frame, band, m.ravel()), kinds)], ["trace_id", "frame", "band", "bels"])

    out = t.mapInArrow(run, "trace_id int, frame int, band int, bels double")
    return out.withColumn("bels", F.floor(F.col("bels") * 1e3 + 0.5) / 1e3 + F.lit(0.0))


@query("mel_loudest", sql("long_samples", body=f"n AS (SELECT trace_id, CAST(1+(max(i)+1)//{_HOP} AS INT) AS frames FROM long_samples GROUP BY 1) SELECT trace_id, frames, CAST({_BANDS} AS INT) AS bands, 0.0e0 AS top, true AS floored FROM n"))
def mel_loudest(spark, d):
    """Spectrograms of traces of a thousand samples: frames, bands, the largest decibels (0), and whether none lies below -80."""
    from ..tables import long_samples

    t = long_samples(spark, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    got = mel_spectrograms(t, "x")
    return got.select("trace_id", "frames", "bands", F.array_max("db").alias("top"), (F.array_min("db") >= -80).alias("floored"))

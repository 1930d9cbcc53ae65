"""Trace files: a splittable source and a sink of SEG-Y-like files.

A file has a 3200-byte text header, a 400-byte header (big-endian shorts: traces a frame at 12, interval in microseconds at 16, samples a trace at 20), then records of 240 header
bytes and big-endian 4-byte floats. Records have one length, so a file is read in ranges of records by independent tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lapped import worker_path
from ..registry import query
from ..streaming.streams import folder
from ..tables import N1, N2, traces

TEXT, BINARY, HEADER = 3200, 400, 240
RECORDS_A_TASK = 4096


def opened(uri: str):
    """pyarrow's file system for a URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def file_header(n2: int, interval: int, n1: int) -> bytes:
    shorts = np.zeros(BINARY // 2, ">i2")
    shorts[[6, 8, 10]] = n2, interval, n1
    return b" " * TEXT + shorts.tobytes()


def parse_header(raw: bytes) -> tuple[int, int, int]:
    """Traces a frame, interval in microseconds, samples a trace. Raises ValueError where the file is too short or states no samples."""
    if len(raw) < TEXT + BINARY:
        raise ValueError("the file ends within its headers")
    shorts = np.frombuffer(raw[TEXT : TEXT + BINARY], ">i2")
    n2, interval, n1 = (int(shorts[k]) for k in (6, 8, 10))
    if n1 <= 0:
        raise ValueError("the file states no samples")
    return n2, interval, n1


def write_segy(df: DataFrame, path: str, n1: int = N1, n2: int = N2) -> DataFrame:
    """Writes traces (trace_id, frame_key, samples), a file a task; returns the manifest (uri, records)."""
    worker_path(df.sparkSession)

    def write(batches):
        import pyarrow as pa

        fs, base = opened(path)
        out, n, name = None, 0, f"{uuid.uuid4().hex}.sgy"
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}")
                out.write(file_header(n2, 4000, n1))
            for trace, key, x in zip(*(c.to_pylist() for c in batch.columns)):
                header = np.zeros(HEADER // 4, ">i4")
                header[:2] = trace, key
                out.write(header.tobytes() + np.asarray(x, ">f4").tobytes())
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [f"{path}/{name}"], "records": pa.array([n], pa.int64())})

    manifest = df.select("trace_id", "frame_key", "samples").mapInArrow(write, "uri string, records long")
    kept = folder(df.sparkSession, "segy-manifest")
    manifest.write.parquet(kept)
    return df.sparkSession.read.schema("uri string, records long").parquet(kept)


def headers_of(manifest: DataFrame) -> DataFrame:
    """uri, traces_per_frame, interval_ms and samples of each file, from its headers alone."""
    worker_path(manifest.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = []
            for uri in batch.column(0).to_pylist():
                fs, path = opened(uri)
                with fs.open_input_file(path) as f:
                    got.append((uri, *parse_header(f.read_at(TEXT + BINARY, 0))))
            yield pa.RecordBatch.from_pydict({"uri": pa.array([g[0] for g in got], pa.string()), "traces_per_frame": pa.array([g[1] for g in got], pa.int32()), "interval_ms": pa.array([g[2] / 1000 for g in got], pa.float64()), "samples": pa.array([g[3] for g in got], pa.int32())})

    return manifest.select("uri").mapInArrow(run, "uri string, traces_per_frame int, interval_ms double, samples int")


def read_segy(manifest: DataFrame) -> DataFrame:
    """trace_id, frame_key and samples of all records, in ranges of records a task. Raises ValueError where a file is shorter than stated."""
    worker_path(manifest.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = opened(uri)
                with fs.open_input_file(path) as f:
                    _, _, n1 = parse_header(f.read_at(TEXT + BINARY, 0))
                    size = HEADER + 4 * n1
                    raw = f.read_at((b - a) * size, TEXT + BINARY + a * size)
                if len(raw) != (b - a) * size:
                    raise ValueError(f"{uri} ends within a record")
                records = np.frombuffer(raw, np.dtype([("h", ">i4", HEADER // 4), ("x", ">f4", n1)]))
                x = np.ascontiguousarray(records["x"], np.float32)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * n1, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(records["h"][:, 0].astype(np.int64)), pa.array(records["h"][:, 1].astype(np.int32)), lists], ["trace_id", "frame_key", "samples"])

    starts = F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(RECORDS_A_TASK)))
    ranges = manifest.where("records > 0").select("uri", "records", starts.alias("a")).select("uri", "a", F.least(F.col("a") + RECORDS_A_TASK, "records").alias("b"))
    return ranges.repartition(max(1, ranges.count())).mapInArrow(run, "trace_id long, frame_key int, samples array<float>")


@query("src_segy_header", "SELECT DISTINCT CAST(32 AS INT) AS traces_per_frame, 4.0e0 AS interval_ms, CAST(len(embedding) AS INT) AS samples FROM embeddings")
def src_segy_header(spark: SparkSession, d: str) -> DataFrame:
    """The different headers of the files that the traces were written to, however many files there are."""
    return headers_of(write_segy(traces(spark, d), folder(spark, "segy"))).select("traces_per_frame", "interval_ms", "samples").distinct()


@query("src_segy_traces", "SELECT CAST(vec_id AS BIGINT) AS trace_id, CAST(label AS INT) AS frame_key, CAST(len(embedding) AS INT) AS n, floor(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE)))*1e4+0.5e0)/1e4 + 0.0e0 AS total FROM embeddings")
def src_segy_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces written to files and read back: their samples' number and sum."""
    got = read_segy(write_segy(traces(spark, d), folder(spark, "segy")))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return got.select("trace_id", "frame_key", F.size("samples").alias("n"), (F.floor(total * 1e4 + 0.5) / 1e4 + F.lit(0.0)).alias("total"))

"""Header integers: runs of constant, rising and falling values, of equal steps and of equal float steps, and their compression.

A field's values of a frame are an array in order of traces. A run of constants or of steps of one has at least 4 values, of other steps 5.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import with_lag
from ..registry import query
from ..tables import headers, sql
from .lapped import slices, worker_path

#: Runs of these kinds, in the order in which they are tried, and the fewest values of a stored one.
KINDS = ("const", "ascending", "descending", "delta", "float")
FEWEST = {"const": 4, "ascending": 4, "descending": 4, "delta": 5, "float": 5}
FIELDS = ("h0", "h1", "h2", "h3")
#: Fields of frames that a task works on at once.
SLICE_ROWS = 128


def fields(spark, d) -> DataFrame:
    """frame_no, field_no, values: each field of a frame in order of traces; a frame has at most 120 traces."""
    h = headers(spark, d).groupBy("frame_no").agg(F.array_sort(F.collect_list(F.struct("trace_in_frame", *FIELDS))).alias("h"))
    each = F.array(*(F.col("h")[f] for f in FIELDS))
    return h.select("frame_no", F.posexplode(each).alias("field_no", "values"))


def float_steps(bits: np.ndarray) -> int:
    """How many of the first values are bits of floats that go on by one float step, each exactly."""
    looks = lambda i: (i > 700_000_000 or i < -700_000_000) and not np.isnan(np.int32(i).view(np.float32))
    if len(bits) < 2 or not (looks(bits[0]) and looks(bits[1])):
        return 1
    f = bits[:2].astype(np.int32).view(np.float32)
    step, n, ahead = np.float32(f[1] - f[0]), 2, 8
    while n < len(bits):  # a stretch at a time, as most runs are short
        f = bits[n - 1 : n + ahead].astype(np.int32).view(np.float32)
        off = np.nonzero(f[:-1] + step != f[1:])[0]
        if len(off):
            return n + int(off[0])
        n, ahead = n + len(f) - 1, 4 * ahead
    return n


def runs(values: list[int]) -> list[tuple[str, int, int, int]]:
    """(kind, length, first, step) of a field's values from first to last: the first kind that gives a run long enough, else a single literal."""
    v = np.array(values, np.int64)
    step = np.diff(v)
    turns = np.append(np.nonzero(np.diff(step))[0] + 1, len(step))  # where the step changes
    lengths = (turns[np.searchsorted(turns, np.arange(len(step)), side="right")] if len(step) else step) - np.arange(len(step)) + 1
    out, at = [], 0
    while at < len(values):
        n, by = (int(lengths[at]), int(step[at])) if at < len(step) else (1, 0)
        kind = {0: "const", 1: "ascending", -1: "descending"}.get(by, "delta")
        if n < FEWEST[kind]:
            kind = "delta" if n >= FEWEST["delta"] else None
        if kind is None:
            n = float_steps(v[at:])
            kind = "float" if n >= FEWEST["float"] else None
        n = n if kind else 1
        out.append((kind or "literal", n, int(v[at]), by if kind not in (None, "const") else 0))
        at += n
    return out


def expand(kind: str, n: int, first: int, step: int) -> list[int]:
    if kind != "float":
        return [first + k * step for k in range(n)]
    out = [np.int32(first).view(np.float32)]
    delta = np.float32(np.int32(first + step).view(np.float32) - out[0])
    while len(out) < n:
        out.append(np.float32(out[-1] + delta))
    return np.array(out, np.float32).view(np.int32).tolist()


def coded(df: DataFrame) -> DataFrame:
    """Run by run: frame_no, field_no, run_no, kind, n, first, step."""
    worker_path(df.sparkSession)
    schema = "frame_no int, field_no int, run_no int, kind string, n int, first long, step long"

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, SLICE_ROWS):
            rows = [(f, g, k, *r) for f, g, v in zip(*(c.to_pylist() for c in batch.columns)) for k, r in enumerate(runs(v))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    return df.select("frame_no", "field_no", "values").mapInArrow(run, schema)


def expanded(df: DataFrame) -> DataFrame:
    """frame_no, field_no, values: what the runs of each field (frame_no, field_no, values) give when expanded again, float runs by float steps."""
    worker_path(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, SLICE_ROWS):
            back = [[x for r in runs(v) for x in expand(*r)] for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(back, pa.list_(pa.int64()))], ["frame_no", "field_no", "values"])

    return df.select("frame_no", "field_no", "values").mapInArrow(run, "frame_no int, field_no int, values array<long>")


def packed(df: DataFrame) -> DataFrame:
    """frame_no, field_no, raw and deflated bytes of the big-endian values, and whether inflating gives them back."""
    worker_path(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, SLICE_ROWS):
            raw = [np.array(v, ">i4").tobytes() for v in batch.column(2).to_pylist()]
            zipped = [zlib.compress(r, 6) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, raw), pa.int64()), pa.array(map(len, zipped), pa.int64()), pa.array([zlib.decompress(z) == r for z, r in zip(zipped, raw)])], ["frame_no", "field_no", "raw", "deflated", "same"])

    return df.select("frame_no", "field_no", "values").mapInArrow(run, "frame_no int, field_no int, raw long, deflated long, same boolean")


_LONG = "v AS (SELECT frame_no, trace_in_frame AS i, h0 AS v FROM headers)"


def islands(spark, d, field: str, step: int) -> DataFrame:
    """Stretches of a field within frames whose values go on by a step: frame_no, first place, n, first value; those of 4 and more."""
    by = Window.partitionBy("frame_no").orderBy("trace_in_frame")
    g = headers(spark, d).withColumn("g", F.col(field) - step * F.row_number().over(by)).withColumn("new", F.when((F.col("g") == F.lag("g").over(by)), 0).otherwise(1)).withColumn("island", F.sum("new").over(by))
    return g.groupBy("frame_no", "island").agg(F.min("trace_in_frame").alias("place"), F.count("*").alias("n"), F.min_by(field, "trace_in_frame").alias("first")).where("n >= 4").drop("island")


def _islands_sql(field: str, step: int) -> str:
    return sql("headers", body=f"g AS (SELECT frame_no, trace_in_frame, {field} AS v, {field}-{step}*row_number() OVER (PARTITION BY frame_no ORDER BY trace_in_frame) AS g FROM headers), c AS (SELECT *, CASE WHEN g=lag(g) OVER (PARTITION BY frame_no ORDER BY trace_in_frame) THEN 0 ELSE 1 END AS c FROM g), s AS (SELECT *, sum(c) OVER (PARTITION BY frame_no ORDER BY trace_in_frame) AS s FROM c) SELECT frame_no, CAST(min(trace_in_frame) AS INT) AS place, CAST(count(*) AS BIGINT) AS n, CAST(arg_min(v, trace_in_frame) AS INT) AS first FROM s GROUP BY frame_no, s HAVING count(*)>=4")


@query("hdr_runs_const", _islands_sql("h2", 0))
def hdr_runs_const(spark, d):
    return islands(spark, d, "h2", 0)


@query("hdr_runs_ascending", _islands_sql("h0", 1))
def hdr_runs_ascending(spark, d):
    return islands(spark, d, "h0", 1)


@query("hdr_rle_greedy")
def hdr_rle_greedy(spark, d):
    """Runs of all header fields, greedily from first to last."""
    return coded(fields(spark, d))


@query("hdr_rle_expand", sql("headers", body="SELECT frame_no, f AS field_no, CAST(row_number() OVER (PARTITION BY frame_no, f ORDER BY trace_in_frame)-1 AS INT) AS i, CAST(CASE f WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END AS BIGINT) AS value FROM headers, (VALUES (0),(1),(2),(3)) v(f)"))
def hdr_rle_expand(spark, d):
    """Header fields coded as runs and expanded again."""
    return expanded(fields(spark, d)).select("frame_no", "field_no", F.posexplode("values").alias("i", "value"))


def absent(used: DataFrame, n: int) -> DataFrame:
    """The n smallest positive values that a column value (long) doesn't have: from the gaps between its distinct values, and from what lies past the largest."""
    values = used.where("value > 0").distinct()
    gaps = with_lag(values, "value", "value", "below").select(F.coalesce("below", F.lit(0)).alias("below"), "value").where("value > below + 1").select("below", (F.col("value") - 1).alias("top"))
    past = values.agg(F.coalesce(F.max("value"), F.lit(0)).alias("below")).select("below", (F.col("below") + n).alias("top"))
    found = gaps.unionByName(past).select(F.explode(F.sequence(F.col("below") + 1, F.least("top", F.col("below") + n))).alias("value"))
    return found.orderBy("value").limit(n)


@query("absent_values", sql("headers", body="c AS (SELECT unnest(range(1, (SELECT count(*) FROM headers) + 6)) AS value) SELECT CAST(value AS BIGINT) AS value FROM c WHERE value NOT IN (SELECT h1 FROM headers) ORDER BY value LIMIT 5"))
def absent_values(spark, d):
    """The five smallest numbers that a field doesn't have, to stand for runs."""
    return absent(headers(spark, d).select(F.col("h1").cast("long").alias("value")), 5)


@query("deflate_roundtrip")
def deflate_roundtrip(spark, d):
    """Header fields deflated and inflated."""
    return packed(fields(spark, d))


@query("hdr_buffer_size", sql("headers", body="SELECT frame_no, CAST(count(*)*4*4*2+128 AS BIGINT) AS bytes FROM headers GROUP BY 1"))
def hdr_buffer_size(spark, d):
    """Bytes that are enough for a frame's coded headers: twice the raw ones and a fixed head."""
    return headers(spark, d).groupBy("frame_no").agg((F.count("*") * len(FIELDS) * 4 * 2 + 128).alias("bytes"))

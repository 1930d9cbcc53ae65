"""Lapped orthogonal transforms of traces and frames: dense products over Arrow batches, whole traces a row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lot
from ..registry import query
from ..tables import N1, N2, r4, sql, traces

DOUBLES = T.ArrayType(T.DoubleType())


def worker_path(spark: SparkSession) -> None:
    """Lets Python workers that share the driver's disk import this package; elsewhere it is shipped by --py-files."""
    import os
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def slices(batches, rows: int):
    """Arrow batches cut into slices (no copies) of at most so many rows: what a task makes of them at once is bounded, however long Spark's batches are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def apply_matrix(df: DataFrame, column: str, matrix: np.ndarray, out: str) -> DataFrame:
    """Adds the product of the matrix and an array column of as many values; a null or shorter array counts zeros, a longer one is an error."""
    worker_path(df.sparkSession)
    n = matrix.shape[1]
    whole = F.coalesce(F.col(column).cast(DOUBLES), F.array().cast(DOUBLES))
    padded = F.when(F.size(whole) > n, F.raise_error(F.lit(f"an array has more than {n} values"))).otherwise(F.slice(F.concat(whole, F.array_repeat(F.lit(0.0), n)), 1, n))
    ready = df.withColumn(out, padded)
    names = ready.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(len(names) - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            y = x @ matrix.T
            offsets = np.arange(len(y) + 1, dtype=np.int32) * matrix.shape[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=names)

    return ready.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, DOUBLES)]))


def frames(df: DataFrame, n2: int = N2, n1: int = N1) -> DataFrame:
    """frame_no, live (places that have a trace) and grid: each frame as one row of n2 * n1 values, missing traces as zeros and short ones padded.

    Of several rows with one place the greatest array counts. A place outside 0 to n2 - 1, and a trace of more than n1 samples, is an error.
    """
    zeros = F.array_repeat(F.lit(0.0), n1)
    odd = ~F.col("trace_in_frame").between(0, n2 - 1) | (F.size("samples") > n1) | F.col("trace_in_frame").isNull()
    whole = F.slice(F.concat(F.coalesce(F.col("samples").cast(DOUBLES), F.array().cast(DOUBLES)), zeros), 1, n1)
    place = F.when(F.coalesce(odd, F.lit(False)), F.raise_error(F.lit("a trace doesn't fit its frame")).cast("int")).otherwise(F.col("trace_in_frame"))
    grouped = df.select("frame_no", place.alias("place"), whole.alias("x")).groupBy("frame_no").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("rows"))
    # of equal places the last, which has the greatest array
    last = F.filter("rows", lambda r, i: F.coalesce(F.try_element_at("rows", i + 2)["place"] != r["place"], F.lit(True)))
    rows = grouped.select("frame_no", F.map_from_entries(last).alias("rows"))
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n2 - 1)), lambda k: F.coalesce(F.try_element_at("rows", k), zeros)))
    return rows.select("frame_no", F.size("rows").cast("long").alias("live"), grid.alias("grid"))


def transform_frames(df: DataFrame, column: str, length: int, out: str, inverse: bool = False, n2: int = N2, n1: int = N1) -> DataFrame:
    """Adds the 2-D transform of a grid column: along traces first, then along time; the inverse the other way round."""
    worker_path(df.sparkSession)
    across, down = lot.matrix(n2, length), lot.matrix(n1, length)
    if inverse:
        across, down = across.T, down.T
    names = [*df.columns, out]
    at = df.columns.index(column)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, n2, n1)
            y = across @ x @ down.T
            offsets = np.arange(len(y) + 1, dtype=np.int32) * (n1 * n2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, DOUBLES)]))


def long_form(df: DataFrame, column: str, index: str, value: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias(index, value)).withColumn(value, r4(F.col(value)))


def mirrored(values: Column, edge: int) -> Column:
    """An array with edge values mirrored at either end, the edge value repeated."""
    return F.concat(F.reverse(F.slice(values, 1, edge)), values, F.reverse(F.slice(values, -edge, edge)))


def multiplexed(values: Column, length: int) -> Column:
    """Puts equal frequencies of a block's transforms side by side: place b * length + l goes to l * blocks + b."""
    blocks = (F.size(values) / length).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.element_at(values, b * length + k + 1))))


def _forward_sql(length: int) -> str:
    return sql("samples", body=f"y AS (SELECT trace_id, k, sum(x*w) AS y FROM samples JOIN {lot.values_sql(N1, length)} USING (i) GROUP BY ALL) SELECT trace_id, CAST(k AS INT) AS k, floor(y*1e4+0.5e0)/1e4 + 0.0e0 AS y FROM y")


def _back_sql() -> str:
    return sql("samples", body="SELECT trace_id, i, floor(x*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM samples")


def _forward(spark, d, length):
    return long_form(apply_matrix(traces(spark, d), "samples", lot.matrix(N1, length), "y"), "y", "k", "y", "trace_id")


def _back(spark, d, length):
    y = apply_matrix(traces(spark, d), "samples", lot.matrix(N1, length), "y")
    return long_form(apply_matrix(y, "y", lot.matrix(N1, length).T, "x"), "x", "i", "x", "trace_id")


@query("lot8_forward", _forward_sql(8))
def lot8_forward(spark, d):
    return _forward(spark, d, 8)


@query("lot16_forward", _forward_sql(16))
def lot16_forward(spark, d):
    return _forward(spark, d, 16)


@query("lot8_inverse", _back_sql())
def lot8_inverse(spark, d):
    return _back(spark, d, 8)


@query("lot16_inverse", _back_sql())
def lot16_inverse(spark, d):
    return _back(spark, d, 16)


@query(
    "lot2d",
    sql(
        "samples",
        body=f"p AS (SELECT DISTINCT frame_no, j, i FROM samples, range({N2}) t(j)), u AS (SELECT p.frame_no, p.j AS trace_in_frame, p.i, coalesce(x,0.0e0) AS x FROM p LEFT JOIN samples s ON s.frame_no=p.frame_no AND s.trace_in_frame=p.j AND s.i=p.i), a AS (SELECT frame_no, i, c.k AS kt, sum(x*w) AS x FROM u JOIN {lot.values_sql(N2, 8).replace('c(k, i, w)', 'c(k, j, w)')} ON trace_in_frame = j GROUP BY ALL), "
        f"b AS (SELECT frame_no, kt, c.k AS ks, sum(x*w) AS y FROM a JOIN {lot.values_sql(N1, 8)} USING (i) GROUP BY ALL) "
        f"SELECT frame_no, CAST(kt*{N1}+ks AS INT) AS k, floor(y*1e4+0.5e0)/1e4 + 0.0e0 AS y FROM b",
    ),
)
def lot2d(spark, d):
    return long_form(transform_frames(frames(traces(spark, d)), "grid", 8, "y"), "y", "k", "y", "frame_no")


@query("pad_frame", sql("samples", "traces", body=f"f AS (SELECT DISTINCT frame_no FROM traces) SELECT f.frame_no, CAST(t.t AS INT) AS trace_in_frame, CAST(s.s AS INT) AS i, floor(coalesce(x,0.0e0)*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM f CROSS JOIN (SELECT unnest(range({N2})) AS t) t CROSS JOIN (SELECT unnest(range({N1})) AS s) s LEFT JOIN samples m ON m.frame_no=f.frame_no AND m.trace_in_frame=t.t AND m.i=s.s"))
def pad_frame(spark, d):
    """Frames padded with zero traces to full size, in long form."""
    k = F.col("k")
    return long_form(frames(traces(spark, d)), "grid", "k", "x", "frame_no").select("frame_no", F.floor(k / N1).cast("int").alias("trace_in_frame"), (k % N1).cast("int").alias("i"), "x")


@query("block_tiles", sql("samples", body="t AS (SELECT frame_no, CAST(floor(trace_in_frame/8.0e0) AS INT) AS hblk, CAST(floor(i/16.0e0) AS INT) AS vblk, x FROM samples) SELECT frame_no, hblk, vblk, CAST(hblk*4+vblk AS INT) AS block_no, CAST(count(*) AS BIGINT) AS n, floor(sum(x*x)*1e4+0.5e0)/1e4 AS energy FROM t GROUP BY ALL"))
def block_tiles(spark, d):
    """Energy of each tile of 8 traces by 16 samples; tiles are numbered along a column of blocks first."""
    t = traces(spark, d).select("frame_no", F.floor(F.col("trace_in_frame") / 8).cast("int").alias("hblk"), "samples")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(N1 // 16 - 1)), lambda v: F.aggregate(F.slice("samples", v * 16 + 1, F.lit(16)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    each = t.select("frame_no", "hblk", F.posexplode(tiles).alias("vblk", "e"))
    return each.groupBy("frame_no", "hblk", "vblk").agg((F.count("*") * 16).alias("n"), r4(F.sum("e")).alias("energy")).withColumn("block_no", (F.col("hblk") * 4 + F.col("vblk")).cast("int"))


@query("mirror_extend", sql("samples", body="a AS (SELECT trace_id, i, x FROM samples UNION ALL SELECT trace_id, -i-1, x FROM samples WHERE i<4 UNION ALL SELECT trace_id, 127-i, x FROM samples WHERE i>=60) SELECT trace_id, CAST(i+4 AS INT) AS i, floor(x*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM a"))
def mirror_extend(spark, d):
    """Traces with four samples mirrored at either end."""
    return long_form(traces(spark, d).withColumn("m", mirrored(F.col("samples").cast(DOUBLES), 4)), "m", "i", "x", "trace_id")


@query("multiplex_permute", sql("samples", body="SELECT trace_id, CAST((i%8)*8+floor(i/8.0e0) AS INT) AS i, floor(x*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM samples"))
def multiplex_permute(spark, d):
    """Samples in multiplexed order of blocks of 8."""
    return long_form(traces(spark, d).withColumn("m", multiplexed(F.col("samples").cast(DOUBLES), 8)), "m", "i", "x", "trace_id")

"""The flagship plan: transform, quantize, restore and measure every trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lot
from ..operators.lapped import apply_matrix, long_form
from ..operators.quant import _B, _D, _E, _Q, _R, _Y, blocks, chain, runs, token_bytes
from ..registry import query
from ..tables import N1, r4, sql, traces


def round_trip(df: DataFrame, distortion: float = 0.1) -> DataFrame:
    """Traces with coefficients, step, integers and restored samples z."""
    q = blocks(df, distortion=distortion)
    back = q.withColumn("w", F.transform("q", lambda v: v * F.col("delta")))
    return apply_matrix(back, "w", lot.matrix(N1, 8).T, "z")


_Z = f"z AS (SELECT trace_id, i, sum(q*delta*w) AS z FROM q JOIN {lot.values_sql(N1, 8)} USING (k) GROUP BY ALL)"


@query(
    "compress_pipeline",
    chain(
        _Y, _D, _Q, _E, _R, _B, _Z,
        "s AS (SELECT e.trace_id, CAST(8+coalesce(sum(bytes),0) AS BIGINT) AS bytes FROM e LEFT JOIN b ON b.trace_id=e.trace_id GROUP BY 1)",
        "n AS (SELECT trace_id, CAST(sum(CASE WHEN q<>0 THEN 1 ELSE 0 END) AS INT) AS nonzero FROM q GROUP BY 1)",
        "r AS (SELECT trace_id, sqrt(avg((z-x)*(z-x))) AS rms_error, max(abs(z-x)) AS max_error FROM samples JOIN z USING (trace_id, i) GROUP BY 1)",
        body="SELECT trace_id, nonzero, bytes, floor(rms_error*1e4+0.5e0)/1e4 AS rms_error, floor(max_error*1e4+0.5e0)/1e4 AS max_error FROM r JOIN s USING (trace_id) JOIN n USING (trace_id)",
    ),
)
def compress_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Per trace: coefficients that aren't zero, bytes, and root mean square and largest error of the restored samples."""
    r = round_trip(traces(spark, d))
    e = F.zip_with("z", "samples", lambda z, x: z - x.cast("double"))
    size = 8 + F.aggregate(runs(F.col("q"), F.col("extent")), F.lit(0), lambda a, x: a + token_bytes(x))
    out = r.select("trace_id", F.size(F.filter("q", lambda v: v != 0)).alias("nonzero"), size.cast("long").alias("bytes"), e.alias("e"))
    return out.select("trace_id", "nonzero", "bytes", r4(F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v) / F.size("e"))).alias("rms_error"), r4(F.array_max(F.transform("e", F.abs))).alias("max_error"))


@query("reconstruction_error", chain(_Y, _D, _Q, _Z, body="SELECT trace_id, i, floor((z-x)*1e4+0.5e0)/1e4 + 0.0e0 AS error FROM samples JOIN z USING (trace_id, i)"))
def reconstruction_error(spark, d):
    e = round_trip(traces(spark, d)).withColumn("e", F.zip_with("z", "samples", lambda z, x: z - x.cast("double")))
    return long_form(e, "e", "i", "error", "trace_id")



@query("bad_amplitude_route", sql("samples", body="b AS (SELECT frame_no, max(CASE WHEN abs(x)>0.35e0 OR isnan(x) THEN 1 ELSE 0 END) AS bad, CAST(count(DISTINCT trace_id) AS BIGINT) AS traces FROM samples GROUP BY 1) SELECT CASE WHEN bad=1 THEN 'raw' ELSE 'compressed' END AS route, CAST(count(*) AS BIGINT) AS frames, CAST(sum(traces) AS BIGINT) AS traces FROM b GROUP BY 1"))
def bad_amplitude_route(spark, d):
    """Frames with an amplitude out of bounds are kept raw, the others compressed: how many of either."""
    from ..operators.select import has_bad_amplitude

    b = traces(spark, d).groupBy("frame_no").agg(F.bool_or(has_bad_amplitude(F.col("samples"), 0.35)).alias("bad"), F.count("*").alias("traces"))
    return b.groupBy(F.when(F.col("bad"), "raw").otherwise("compressed").alias("route")).agg(F.count("*").alias("frames"), F.sum("traces").alias("traces"))

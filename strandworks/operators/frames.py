"""Frames: segmentation of a stream of traces by change of key, counters, and the pairing of headers and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import bounds_of, stretch, with_running_sum
from ..registry import query
from ..tables import headers, r4, sql, table, traces


def segmented(df: DataFrame, order: str, key: str) -> DataFrame:
    """Adds frame_no, number and traces_so_far, in order of a unique order: a frame begins wherever the key differs from the row before, so a key that comes back starts a new one.

    One pass over stretches of the order: what a row needs from other stretches (frames and rows before, where the frame it is in began) comes from a table with a row a
    stretch, so no task sees the whole stream, or a frame that is longer than a stretch.
    """
    cut = df.withColumn("_s", stretch(F.col(order), bounds_of(df, order)))
    w = Window.partitionBy("_s").orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("_n", F.row_number().over(w)).withColumn("_change", (F.col("_n") > 1) & ~F.col(key).eqNullSafe(F.lag(key).over(w)))
    rows = rows.withColumn("_f", F.count_if("_change").over(upto)).withColumn("_at", F.max(F.when(F.col("_change"), F.col("_n"))).over(upto))
    total = rows.groupBy("_s").agg(F.min_by(key, "_n").alias("first"), F.max_by(key, "_n").alias("last"), F.max("_f").alias("f"), F.max("_n").alias("n"), F.max("_at").alias("at"))
    total = total.withColumn("new", F.lag(F.lit(False), 1, True).over(Window.orderBy("_s")) | ~F.col("first").eqNullSafe(F.lag("last").over(Window.orderBy("_s"))))
    total = total.withColumn("_rows", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_frames", F.coalesce(F.sum(F.col("f") + F.col("new").cast("int")).over(before), F.lit(0)) + F.col("new").cast("int"))
    total = total.withColumn("began", F.max(F.coalesce(F.col("_rows") + F.col("at"), F.when(F.col("new"), F.col("_rows") + 1))).over(before))
    total = total.select("_s", "_rows", "_frames", F.when(F.col("new"), F.col("_rows") + 1).otherwise(F.col("began")).alias("_began"))
    out = rows.join(F.broadcast(total), "_s")  # as many rows as stretches, which follow the number of partitions
    place = F.col("_rows") + F.col("_n")
    number = place - F.coalesce(F.col("_rows") + F.col("_at"), F.col("_began")) + 1
    return out.select(*df.columns, (F.col("_frames") + F.col("_f")).alias("frame_no"), number.cast("int").alias("number"), place.alias("traces_so_far"))


def keyed(spark, d) -> DataFrame:
    return traces(spark, d).select("trace_id", "frame_key")


_CHANGE = "c AS (SELECT trace_id, frame_key, CASE WHEN frame_key=lag(frame_key) OVER (ORDER BY trace_id) THEN 0 ELSE 1 END AS c FROM traces), f AS (SELECT trace_id, frame_key, sum(c) OVER (ORDER BY trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS frame_no FROM c)"


@query("frame_segmentation", sql("traces", body=_CHANGE + " SELECT trace_id, frame_key, CAST(frame_no AS BIGINT) AS frame_no FROM f"))
def frame_segmentation(spark, d):
    return segmented(keyed(spark, d), "trace_id", "frame_key").select("trace_id", "frame_key", "frame_no")


@query("trace_in_frame", sql("traces", body=_CHANGE + " SELECT trace_id, CAST(frame_no AS BIGINT) AS frame_no, CAST(row_number() OVER (PARTITION BY frame_no ORDER BY trace_id) AS INT) AS number, row_number() OVER (PARTITION BY frame_no ORDER BY trace_id) > 2 AS overflow FROM f"))
def trace_in_frame(spark, d):
    """Number of each trace in its frame, and whether that is over two."""
    return segmented(keyed(spark, d), "trace_id", "frame_key").select("trace_id", "frame_no", "number", (F.col("number") > 2).alias("overflow"))


@query("frame_counters", sql("traces", body=_CHANGE + " SELECT trace_id, CAST(row_number() OVER (ORDER BY trace_id) AS BIGINT) AS traces_so_far, CAST(dense_rank() OVER (ORDER BY frame_no) AS BIGINT) AS frames_so_far FROM f"))
def frame_counters(spark, d):
    """How many traces and frames there are up to each trace."""
    return segmented(keyed(spark, d), "trace_id", "frame_key").select("trace_id", "traces_so_far", F.col("frame_no").alias("frames_so_far"))


@query("running_bytes", "SELECT o_orderkey, CAST(sum(b) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes, CAST(sum(1) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS traces FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS b FROM orders)")
def running_bytes(spark, d):
    """Running totals of bytes and traces."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("b"), F.lit(1).cast("long").alias("one"))
    return with_running_sum(o, "o_orderkey", {"bytes": "b", "traces": "one"}).select("o_orderkey", "bytes", "traces")


@query("header_trace_join", sql("headers", "traces", body="SELECT t.trace_id, h.h0, h.h1, floor(CAST(t.samples[1] AS DOUBLE)*1e4+0.5e0)/1e4 + 0.0e0 AS first_sample FROM traces t JOIN headers h ON h.frame_no=t.frame_no AND h.trace_in_frame=t.trace_in_frame"))
def header_trace_join(spark, d):
    """Headers and traces of the same place in the same frame."""
    t = traces(spark, d).select("trace_id", "frame_no", "trace_in_frame", r4(F.element_at("samples", 1).cast("double")).alias("first_sample"))
    return t.join(headers(spark, d).drop("h2", "h3"), ["frame_no", "trace_in_frame"]).select("trace_id", "h0", "h1", "first_sample")


@query("waveform_lookup", sql("traces", body="SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, trace_id IS NULL AS missing, frame_no FROM orders LEFT JOIN traces ON trace_id=o_custkey"))
def waveform_lookup(spark, d):
    """Orders with the trace of their customer's number; missing ones are kept and marked."""
    t = traces(spark, d).select("trace_id", "frame_no")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("trace_id"))
    return o.join(t.withColumn("there", F.lit(True)), "trace_id", "left").select("o_orderkey", F.col("there").isNull().alias("missing"), "frame_no")


@query("header_transpose", sql("headers", body="SELECT frame_no, trace_in_frame, f AS field_no, CASE f WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END AS value FROM headers, (VALUES (0),(1),(2),(3)) v(f)"))
def header_transpose(spark, d):
    """Header fields as rows."""
    return headers(spark, d).select("frame_no", "trace_in_frame", F.posexplode(F.array("h0", "h1", "h2", "h3")).alias("field_no", "value"))


@query("compressed_frame_sizes", sql("headers", body="SELECT frame_no, CAST(count(*) AS BIGINT) AS traces, CAST(sum(4*(64+4)) AS BIGINT) AS raw_bytes, count(*)=1 AS lone FROM headers GROUP BY 1"))
def compressed_frame_sizes(spark, d):
    """Traces and raw bytes of each frame, and whether it has one trace only."""
    return headers(spark, d).groupBy("frame_no").agg(F.count("*").alias("traces"), (F.count("*") * 4 * 68).alias("raw_bytes"), (F.count("*") == 1).alias("lone"))


@query("combined_frame_size", sql("headers", "traces", body="h AS (SELECT frame_no, count(*) AS n FROM headers GROUP BY 1), t AS (SELECT frame_no, count(*) AS n FROM traces GROUP BY 1) SELECT coalesce(h.frame_no,t.frame_no) AS frame_no, CAST(coalesce(h.n,0)*16 AS BIGINT) AS header_bytes, CAST(coalesce(t.n,0)*256 AS BIGINT) AS trace_bytes FROM h FULL JOIN t ON h.frame_no=t.frame_no"))
def combined_frame_size(spark, d):
    """Header and trace bytes of each frame that has either."""
    h = headers(spark, d).groupBy("frame_no").agg(F.count("*").alias("h"))
    t = traces(spark, d).groupBy("frame_no").agg(F.count("*").alias("t"))
    return h.join(t, "frame_no", "full").select("frame_no", (F.coalesce("h", F.lit(0)) * 16).alias("header_bytes"), (F.coalesce("t", F.lit(0)) * 256).alias("trace_bytes"))


@query("frame_header_hex", sql("headers", body="SELECT frame_no, trace_in_frame, concat(lower(lpad(hex(h1 & 65535),4,'0')), lower(lpad(hex(h0),8,'0')), lower(lpad(hex(h2),2,'0')), lower(lpad(hex(h3),8,'0'))) AS header FROM headers"))
def frame_header_hex(spark, d):
    """A frame header's words as big-endian hex: cookie, size, block, bytes."""
    from ..functions.scalar import be_hex

    return headers(spark, d).select("frame_no", "trace_in_frame", F.concat(be_hex(F.col("h1").bitwiseAND(65535), 4), be_hex(F.col("h0")), be_hex(F.col("h2"), 2), be_hex(F.col("h3"))).alias("header"))


@query("buffer_guess", "SELECT p_partkey, CAST(CASE WHEN x<=0.01e0 THEN 2*n WHEN x<=0.1e0 THEN n ELSE n/2 END AS BIGINT) AS bytes FROM (SELECT p_partkey, (p_partkey%30)/100.0e0 AS x, CAST(p_size*4 AS BIGINT) AS n FROM part)")
def buffer_guess(spark, d):
    """A guess of compressed bytes from the distortion: twice, once or half the raw bytes."""
    x, n = (F.col("p_partkey") % 30) / 100, F.col("p_size").cast("long") * 4
    return table(spark, d, "part").select("p_partkey", F.when(x <= 0.01, n * 2).when(x <= 0.1, n).otherwise(F.floor(n / 2)).cast("long").alias("bytes"))

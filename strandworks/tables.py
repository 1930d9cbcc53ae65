"""The views on which queries run: traces, their samples, headers and classification records, made of the given tables.

Each view has a twin in DuckDB's SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a trace, traces of a frame.
N1, N2 = 64, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, frame_no, trace_in_frame, frame_key, samples (array of floats); the last frame is partial."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("trace_id"), F.floor(F.col("vec_id") / N2).cast("int").alias("frame_no"), (F.col("vec_id") % N2).cast("int").alias("trace_in_frame"), F.col("label").cast("int").alias("frame_key"), F.col("embedding").alias("samples"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces in long form: i counts samples from 0, x is a double."""
    t = traces(spark, sf_dir)
    return t.select("trace_id", "frame_no", "trace_in_frame", "frame_key", F.posexplode("samples").alias("i", "v")).withColumn("x", F.col("v").cast("double")).drop("v")


def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, i, x: traces of 1000 samples with zeros and both signs."""
    e = table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 7 == 0, 0.0).when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    return e.select(F.floor(F.col("event_id") / 1000).cast("int").alias("trace_id"), (F.col("event_id") % 1000).cast("int").alias("i"), x.alias("x"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, trace_in_frame and four integer header fields."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 120).cast("int").alias("frame_no"), (F.col("o_orderkey") % 120).cast("int").alias("trace_in_frame"), F.col("o_orderkey").cast("int").alias("h0"), F.col("o_custkey").cast("int").alias("h1"), F.substring("o_orderpriority", 1, 1).cast("int").alias("h2"), F.floor("o_totalprice").cast("int").alias("h3"))


def class_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts, filename, predicted_class, confidence, with repeated file names."""
    e = table(spark, sf_dir, "events")
    confidence = F.floor(F.col("value") / (F.col("value") + 50.0) * 1e4 + 0.5) / 1e4
    return e.select(F.col("event_id").cast("long").alias("log_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("sig_"), F.col("user_id").cast("string"), F.lit(".png")).alias("filename"), F.col("event_type").alias("predicted_class"), confidence.alias("confidence"))


def r4(c: Column) -> Column:
    """Four decimals, in a way that other engines have too; no negative zero."""
    return F.floor(c * 1e4 + 0.5) / 1e4 + F.lit(0.0)


SQL = {
    "traces": "SELECT CAST(vec_id AS BIGINT) AS trace_id, CAST(floor(vec_id/32.0e0) AS INT) AS frame_no, CAST(vec_id%32 AS INT) AS trace_in_frame, CAST(label AS INT) AS frame_key, embedding AS samples FROM embeddings",
    "samples": "SELECT CAST(vec_id AS BIGINT) AS trace_id, CAST(floor(vec_id/32.0e0) AS INT) AS frame_no, CAST(vec_id%32 AS INT) AS trace_in_frame, CAST(label AS INT) AS frame_key, CAST(unnest(range(len(embedding))) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "long_samples": "SELECT CAST(floor(event_id/1000.0e0) AS INT) AS trace_id, CAST(event_id%1000 AS INT) AS i, CASE WHEN event_id%7=0 THEN 0.0e0 WHEN event_id%2=0 THEN value ELSE -value END AS x FROM events",
    "headers": "SELECT CAST(floor(o_orderkey/120.0e0) AS INT) AS frame_no, CAST(o_orderkey%120 AS INT) AS trace_in_frame, CAST(o_orderkey AS INT) AS h0, CAST(o_custkey AS INT) AS h1, CAST(substring(o_orderpriority,1,1) AS INT) AS h2, CAST(floor(o_totalprice) AS INT) AS h3 FROM orders",
    "class_log": "SELECT CAST(event_id AS BIGINT) AS log_id, CAST(ts AS TIMESTAMP) AS ts, concat('sig_', CAST(user_id AS VARCHAR), '.png') AS filename, event_type AS predicted_class, floor((value/(value+50.0e0))*1e4+0.5e0)/1e4 AS confidence FROM events",
}


def sql(*views: str, body: str) -> str:
    """A statement over views of SQL."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + (" " if body.lstrip().upper().startswith("SELECT") else ", ") + body

"""Selections: ranges with strides, validity of frames, thresholds, and rows not done yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..tables import class_log, headers, r4, sql, table, traces

#: Amplitudes beyond this aren't data.
BAD = 1e15


def in_range(value: Column, least: int | None = None, most: int | None = None, stride: int = 1) -> Column:
    """least <= value <= most, every stride-th from least, or from 0 where there is no least."""
    out = F.pmod(value - (least or 0), F.lit(stride)) == 0
    if least is not None:
        out &= value >= least
    if most is not None:
        out &= value <= most
    return out


def has_bad_amplitude(samples: Column, bound: float = BAD) -> Column:
    """Whether an array has a value beyond the bound, infinite or not a number."""
    return F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) > bound))


def volume_of(name: Column, prefix: str = "SOURCE_") -> Column:
    """The number in names like SOURCE_12.sgy.syz; null for others."""
    return F.nullif(F.regexp_extract(name, "^" + prefix + r"([0-9]+)\.sgy\.syz$", 1), F.lit("")).try_cast("int")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done."""
    return df.join(done.select(key), key, "left_anti")


_NAMED = "SELECT c_custkey, concat(CASE WHEN c_custkey%5=0 THEN 'OTHER_' ELSE 'SOURCE_' END, CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey%7=0 THEN '.sgy' ELSE '.sgy.syz' END) AS name FROM customer"


def named(spark, d) -> DataFrame:
    """Customers as files of volumes, some of another prefix or without the codec's extension."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.concat(F.when(k % 5 == 0, "OTHER_").otherwise("SOURCE_"), k.cast("string"), F.when(k % 7 == 0, ".sgy").otherwise(".sgy.syz")).alias("name"))


@query("volume_range_filter", f"WITH n AS ({_NAMED}), v AS (SELECT name, TRY_CAST(nullif(regexp_extract(name, '^SOURCE_([0-9]+)\\.sgy\\.syz$', 1), '') AS INT) AS volume FROM n) SELECT name, volume FROM v WHERE volume BETWEEN 10 AND 900 AND (volume-10)%3=0")
def volume_range_filter(spark, d):
    """Files of volumes 10 to 900, every third."""
    return named(spark, d).select("name", volume_of(F.col("name")).alias("volume")).where(in_range(F.col("volume"), 10, 900, 3))


@query("volume_listing", f"WITH n AS ({_NAMED}) SELECT name, TRY_CAST(nullif(regexp_extract(name, '^SOURCE_([0-9]+)\\.sgy\\.syz$', 1), '') AS INT) AS volume FROM n WHERE name LIKE '%.syz'")
def volume_listing(spark, d):
    """The listing of compressed files, in order of name."""
    return named(spark, d).where(F.col("name").endswith(".syz")).select("name", volume_of(F.col("name")).alias("volume")).orderBy("name")


@query("output_name", f"WITH n AS ({_NAMED}) SELECT name, split_part(name, '.syz', 1) AS output FROM n")
def output_name(spark, d):
    """The name of a file without the codec's extension."""
    return named(spark, d).select("name", F.substring_index("name", ".syz", 1).alias("output"))


@query("frame_range_scan", sql("traces", body="SELECT trace_id, frame_no FROM traces WHERE frame_no+1 BETWEEN 2 AND 12 AND (frame_no+1-2)%2=0"))
def frame_range_scan(spark, d):
    """Traces of frames 2 to 12, counted from 1, every other one."""
    return traces(spark, d).select("trace_id", "frame_no").where(in_range(F.col("frame_no") + 1, 2, 12, 2))


@query("trace_range_filter", sql("traces", body="SELECT trace_id, frame_no, trace_in_frame FROM traces WHERE (trace_in_frame+1)%4=0 AND trace_in_frame+1<=24"))
def trace_range_filter(spark, d):
    """Every fourth trace of a frame up to the 24th, counted from 1; the stride begins at 0 as there is no least."""
    return traces(spark, d).select("trace_id", "frame_no", "trace_in_frame").where(in_range(F.col("trace_in_frame") + 1, None, 24, 4))


@query("sample_truncate", sql("traces", body="SELECT trace_id, CAST(len(samples[1:40]) AS INT) AS n, floor(list_sum(list_transform(samples[1:40], lambda v: CAST(v AS DOUBLE)))*1e4+0.5e0)/1e4 + 0.0e0 AS total FROM traces"))
def sample_truncate(spark, d):
    """Traces cut to 40 samples: how many are left, and their sum."""
    cut = F.slice("samples", 1, 40)
    return traces(spark, d).select("trace_id", F.size(cut).alias("n"), r4(F.aggregate(cut, F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total"))


@query("bad_amplitude", sql("samples", body="SELECT frame_no, max(CASE WHEN abs(x)>0.35e0 OR isnan(x) THEN 1 ELSE 0 END)=1 AS bad FROM samples GROUP BY 1"))
def bad_amplitude(spark, d):
    """Whether a frame has an amplitude beyond 0.35."""
    return traces(spark, d).groupBy("frame_no").agg(F.bool_or(has_bad_amplitude(F.col("samples"), 0.35)).alias("bad"))


@query("category_filter", sql("class_log", body="SELECT log_id, filename FROM class_log WHERE predicted_class='click'"))
def category_filter(spark, d):
    return class_log(spark, d).where("predicted_class = 'click'").select("log_id", "filename")


@query("coerced_threshold", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9.]+)', 1) AS DOUBLE) AS magnitude FROM events WHERE TRY_CAST(regexp_extract(props, '([0-9.]+)', 1) AS DOUBLE) >= 4 ORDER BY event_id LIMIT 20")
def coerced_threshold(spark, d):
    """The first 20 events whose properties give a number of 4 or more; text that isn't a number counts as null."""
    number = F.regexp_extract("props", "([0-9.]+)", 1).try_cast("double")
    return table(spark, d, "events").select("event_id", number.alias("magnitude")).where("magnitude >= 4").orderBy("event_id").limit(20)


@query("resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def resume_anti_join(spark, d):
    """Orders without an item of over 30."""
    done = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return not_done(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("probably_float", sql("headers", body="SELECT frame_no, trace_in_frame, (h3*5000 > 700000000 OR h3*5000 < -700000000) AND ((h3*5000) & 2147483647) <= 2139095040 AS is_float FROM (SELECT frame_no, trace_in_frame, CAST(h3 AS BIGINT)%400000 AS h3 FROM headers)"))
def probably_float(spark, d):
    """Whether an integer's bits are likely those of a float: far from zero and no NaN."""
    return headers(spark, d).select("frame_no", "trace_in_frame", looks_like_float((F.col("h3").cast("long") % 400000) * 5000).alias("is_float"))


def looks_like_float(i: Column) -> Column:
    return ((i > 700_000_000) | (i < -700_000_000)) & (i.bitwiseAND(0x7FFFFFFF) <= 0x7F800000)


@query("uncertain_flag", sql("class_log", body="SELECT log_id, confidence, confidence < 0.6e0 AS uncertain FROM class_log"))
def uncertain_flag(spark, d):
    return class_log(spark, d).select("log_id", "confidence", (F.col("confidence") < 0.6).alias("uncertain"))


@query("frame_integrity", sql("headers", body="SELECT frame_no, trace_in_frame, CASE WHEN h1%10 NOT IN (1,2,3,4) THEN 'bad cookie' WHEN h2<=1 THEN 'bad size' ELSE 'ok' END AS state FROM headers"))
def frame_integrity(spark, d):
    """Frames by the state of their headers: one of four cookies, and a size over one."""
    cookie = (F.col("h1") % 10).isin(1, 2, 3, 4)
    return headers(spark, d).select("frame_no", "trace_in_frame", F.when(~cookie, "bad cookie").when(F.col("h2") <= 1, "bad size").otherwise("ok").alias("state"))


@query("segy_key_dump", sql("traces", body="SELECT trace_id, frame_key FROM traces ORDER BY trace_id LIMIT 10"))
def segy_key_dump(spark, d):
    """The frame keys of the first 10 traces."""
    return traces(spark, d).select("trace_id", "frame_key").orderBy("trace_id").limit(10)

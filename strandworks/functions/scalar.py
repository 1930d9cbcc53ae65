"""Scalar expressions: lengths, policies, bytes, texts and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query
from ..tables import class_log, headers, r4, sql, table, traces


def padded_length(n: Column, block: int) -> Column:
    """n rounded up to a multiple of block."""
    return (F.ceil(n / block) * block).cast("int")


def block_size(n: Column, policy: str, most: int = 256) -> Column:
    """Block size for a length: its own multiple of 8 up to 32; beyond, 24 to 48, 32 to 64, then 64 where speed counts, else a multiple of 16 up to most."""
    fixed = F.when(n <= 8, 8).when(n <= 16, 16).when(n <= 24, 24).when(n <= 32, 32)
    if policy == "fastest":
        return fixed.otherwise(F.when(n <= 48, 24).when(n <= 64, 32).otherwise(64)).cast("int")
    return fixed.otherwise(F.least(F.ceil(n / 16) * 16, F.lit(most))).cast("int")


def transform_length(block: Column, policy: str) -> Column:
    """Transform length of a block: 8 where speed counts, else 16 if blocks of 16 fill it."""
    return F.lit(8) if policy == "fastest" else F.when(block % 16 == 0, 16).otherwise(8)


def nint(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("int")


def be_hex(i: Column, digits: int = 8) -> Column:
    """Big-endian bytes of an integer as lower-case hex digits."""
    return F.right(F.lpad(F.lower(F.hex(i.cast("long"))), 16, "0"), F.lit(digits))


def duration_text(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))


def run_time(name: Column) -> Column:
    """The time in names like run_20200131_235959; null for others."""
    return F.try_to_timestamp(F.regexp_extract(name, r"_(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*(F.nullif(v, F.lit(0)) for v in values))


def accuracy_band(x: Column) -> Column:
    return F.when(x >= 0.95, "high").when(x >= 0.85, "middle").otherwise("low")


@query("padded_length", "SELECT o_orderkey, CAST(ceil((o_orderkey%700)/16.0e0)*16 AS INT) AS padded FROM orders")
def q_padded_length(spark, d):
    return table(spark, d, "orders").select("o_orderkey", padded_length(F.col("o_orderkey") % 700, 16).alias("padded"))


_FIX = "WHEN n<=8 THEN 8 WHEN n<=16 THEN 16 WHEN n<=24 THEN 24 WHEN n<=32 THEN 32"


@query("block_size_policy", f"SELECT o_orderkey, CAST(CASE {_FIX} WHEN n<=48 THEN 24 WHEN n<=64 THEN 32 ELSE 64 END AS INT) AS fastest, CAST(CASE {_FIX} ELSE least(ceil(n/16.0e0)*16, 256) END AS INT) AS tightest, CAST(CASE {_FIX} ELSE least(ceil(n/16.0e0)*16, 512) END AS INT) AS first_version FROM (SELECT o_orderkey, o_orderkey%700+1 AS n FROM orders)")
def q_block_size(spark, d):
    n = F.col("o_orderkey") % 700 + 1
    return table(spark, d, "orders").select("o_orderkey", block_size(n, "fastest").alias("fastest"), block_size(n, "max").alias("tightest"), block_size(n, "max", 512).alias("first_version"))


@query("trans_length_policy", "SELECT p_partkey, 8 AS fastest, CASE WHEN (p_size*8)%16=0 THEN 16 ELSE 8 END AS tightest FROM part")
def q_transform_length(spark, d):
    b = F.col("p_size") * 8
    return table(spark, d, "part").select("p_partkey", transform_length(b, "fastest").alias("fastest"), transform_length(b, "max").alias("tightest"))


@query("nint", "SELECT l_orderkey, l_linenumber, CAST(sign(x)*floor(abs(x)+0.5e0) AS INT) AS n FROM (SELECT l_orderkey, l_linenumber, (l_quantity-25.0e0)/2.0e0 AS x FROM lineitem)")
def q_nint(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", nint((F.col("l_quantity") - 25.0) / 2.0).alias("n"))


@query("int_to_be_hex", sql("headers", body="SELECT frame_no, trace_in_frame, lower(lpad(hex(h0),8,'0')) AS b0, lower(lpad(hex(h3),8,'0')) AS b3 FROM headers"))
def q_be_hex(spark, d):
    return headers(spark, d).select("frame_no", "trace_in_frame", be_hex(F.col("h0")).alias("b0"), be_hex(F.col("h3")).alias("b3"))


@query("short_bytes", sql("headers", body="SELECT frame_no, trace_in_frame, lower(lpad(hex(h1 & 65535),4,'0')) AS b, CAST((h1 >> 8) & 255 AS INT) AS high, CAST(h1 & 255 AS INT) AS low FROM headers"))
def q_short_bytes(spark, d):
    h = F.col("h1")
    return headers(spark, d).select("frame_no", "trace_in_frame", be_hex(h.bitwiseAND(65535), 4).alias("b"), F.shiftright(h, 8).bitwiseAND(255).alias("high"), h.bitwiseAND(255).alias("low"))


@query("utf16_bytes", "SELECT c_custkey, array_to_string(list_transform(string_split(c_name, ''), lambda c: upper(printf('%04x', unicode(c)))), '') AS b, true AS same FROM customer")
def q_utf16(spark, d):
    """Texts to UTF-16BE bytes and back."""
    b = F.encode("c_name", "UTF-16BE")
    return table(spark, d, "customer").select("c_custkey", F.hex(b).alias("b"), (F.decode(b, "UTF-16BE") == F.col("c_name")).alias("same"))


@query("duration_text", "SELECT o_orderkey, concat(CAST(CAST(floor(s/60.0e0) AS BIGINT) AS VARCHAR), 'm ', CAST(s%60 AS VARCHAR), 's') AS duration FROM (SELECT o_orderkey, CAST(o_orderkey%7000 AS BIGINT) AS s FROM orders)")
def q_duration(spark, d):
    return table(spark, d, "orders").select("o_orderkey", duration_text(F.col("o_orderkey").cast("long") % 7000).alias("duration"))


@query("run_name_ts", "SELECT event_id, TRY_CAST(try_strptime(nullif(regexp_extract(name, '_([0-9]{8}_[0-9]{6})$', 1), ''), '%Y%m%d_%H%M%S') AS TIMESTAMP) AS ts FROM (SELECT event_id, CASE WHEN event_id%9=0 THEN 'run_latest' ELSE concat('run_', strftime(CAST(ts AS TIMESTAMP), '%Y%m%d_%H%M%S')) END AS name FROM events)")
def q_run_time(spark, d):
    name = F.when(F.col("event_id") % 9 == 0, "run_latest").otherwise(F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd_HHmmss")))
    return table(spark, d, "events").select("event_id", run_time(name).cast("timestamp_ntz").alias("ts"))


@query("regex_metric", "SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT) AS metric FROM events")
def q_regex_metric(spark, d):
    """The first number in a report's text."""
    return table(spark, d, "events").select("event_id", F.nullif(F.regexp_extract("props", "([0-9]+)", 1), F.lit("")).try_cast("long").alias("metric"))


def row_of_key(key: Column) -> Column:
    """The row of a key bucket$row,...; null where that is no number."""
    return F.substring_index(F.substring_index(key, "$", -1), ",", 1).try_cast("long")


@query("trace_key_parse", "SELECT o_orderkey, split_part(k, '$', 1) AS bucket, CAST(split_part(split_part(k, '$', 2), ',', 1) AS BIGINT) AS row_no FROM (SELECT o_orderkey, concat('bucket', CAST(o_orderkey%7 AS VARCHAR), '$', CAST(o_custkey AS VARCHAR), ',:3,:6000') AS k FROM orders)")
def q_trace_key(spark, d):
    k = F.concat(F.lit("bucket"), (F.col("o_orderkey") % 7).cast("string"), F.lit("$"), F.col("o_custkey").cast("string"), F.lit(",:3,:6000"))
    return table(spark, d, "orders").select("o_orderkey", F.substring_index(k, "$", 1).alias("bucket"), row_of_key(k).alias("row_no"))


@query("html_escape", "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def q_html_escape(spark, d):
    """Pages with their marks escaped, as a hash."""
    return table(spark, d, "pages").select("page_id", F.sha2(F.encode(html_escaped(F.col("html")), "UTF-8"), 256).alias("escaped"))


@query("format_result", sql("class_log", body="SELECT log_id, concat(predicted_class, ' ', CAST(CAST(floor(confidence*100.0e0+0.5e0) AS INT) AS VARCHAR), '%') AS line FROM class_log"))
def q_format_result(spark, d):
    return class_log(spark, d).select("log_id", F.format_string("%s %d%%", "predicted_class", F.floor(F.col("confidence") * 100 + 0.5).cast("int")).alias("line"))


@query("schema_fallback", "SELECT p_partkey, coalesce(nullif(CAST(p_size%3 AS INT), 0), nullif(CAST(p_partkey%4 AS INT), 0), -1) AS epochs FROM part")
def q_fallback(spark, d):
    return table(spark, d, "part").select("p_partkey", F.coalesce(first_truthy((F.col("p_size") % 3).cast("int"), (F.col("p_partkey") % 4).cast("int")), F.lit(-1)).alias("epochs"))


@query("normalize_const", sql("samples", body="SELECT trace_id, i, floor((x-0.1e0)/0.25e0*1e4+0.5e0)/1e4 + 0.0e0 AS z FROM samples"))
def q_normalize(spark, d):
    """Samples less a fixed mean, over a fixed deviation."""
    z = F.transform("samples", lambda x: r4((x.cast("double") - 0.1) / 0.25))
    return traces(spark, d).select("trace_id", F.posexplode(z).alias("i", "z"))


@query("pixel_to_db", sql("samples", body="p AS (SELECT trace_id, i, greatest(0, least(255, CAST(floor(abs(x)*255.0e0) AS INT))) AS pixel FROM samples) SELECT trace_id, i, pixel, floor(pixel/255.0e0*-80.0e0*1e4+0.5e0)/1e4 + 0.0e0 AS db FROM p"))
def q_pixel_to_db(spark, d):
    """Pixels of 0 to 255 as levels of 0 to -80 dB."""
    pixels = F.transform("samples", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.abs(x.cast("double")) * 255.0).cast("int"))))
    p = traces(spark, d).select("trace_id", F.posexplode(pixels).alias("i", "pixel"))
    return p.withColumn("db", r4(F.col("pixel") / 255.0 * -80.0))


@query("accuracy_band", sql("class_log", body="SELECT log_id, CASE WHEN confidence>=0.95e0 THEN 'high' WHEN confidence>=0.85e0 THEN 'middle' ELSE 'low' END AS band FROM class_log"))
def q_band(spark, d):
    return class_log(spark, d).select("log_id", accuracy_band(F.col("confidence")).alias("band"))


@query("float_bits", "SELECT CAST(vec_id AS BIGINT) AS trace_id, CAST(embedding[1] AS FLOAT) AS x, CAST(CAST(CAST(embedding[1] AS FLOAT) AS BIT) AS INT) AS bits, true AS same FROM embeddings")
def q_float_bits(spark, d):
    """The bits of each trace's first sample as an integer, by way of an Arrow function over whole columns, and back."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def bits(x):
        import numpy as np
        import pandas as pd

        return pd.Series(x.to_numpy(np.float32).view(np.int32))

    @pandas_udf("float")
    def value(b):
        import numpy as np
        import pandas as pd

        return pd.Series(b.to_numpy(np.int32).view(np.float32))

    t = traces(spark, d).select("trace_id", F.element_at("samples", 1).alias("x")).withColumn("bits", bits("x"))
    return t.withColumn("same", value("bits") == F.col("x"))


@query("compression_ratio", sql("headers", body="SELECT frame_no, floor(sum(CAST(h1 AS DOUBLE))/sum(CAST(h2 AS DOUBLE))*1e4+0.5e0)/1e4 AS ratio FROM headers GROUP BY 1"))
def q_ratio(spark, d):
    """Bytes read over bytes written, by frame."""
    return headers(spark, d).groupBy("frame_no").agg(r4(F.sum(F.col("h1").cast("double")) / F.sum(F.col("h2").cast("double"))).alias("ratio"))

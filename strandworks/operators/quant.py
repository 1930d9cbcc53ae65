"""Quantization of blocks of coefficients, and the sizes of what run-length coding makes of them; a block is an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lot
from ..registry import query
from ..tables import N1, r4, sql, traces
from .lapped import apply_matrix, long_form

#: The distortion that queries use, and the constant of the step's definition.
DISTORTION, CPDF = 0.1, 0.26


def let(value: Column, body) -> Column:
    """body(value), computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v, lambda a: a / F.greatest(F.size(x), F.lit(1)))


def step(x: Column, distortion: float = DISTORTION) -> Column:
    """The quantization step of a block: from its rms, then again from the values beyond a quarter of that step; 1 where there are none."""
    first = distortion * F.sqrt(mean_square(x)) / CPDF
    return let(first, lambda d: let(F.filter(x, lambda v: F.abs(v) > d * 0.25), lambda big: F.when(F.size(big) == 0, F.lit(1.0)).otherwise(distortion * F.sqrt(mean_square(big)) / CPDF)))


def nint(x: Column) -> Column:
    """The nearest integer, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("int")


def quantized(x: Column, delta: Column) -> Column:
    return let(delta, lambda d: F.transform(x, lambda v: nint(v / d)))


def extent(q: Column) -> Column:
    """How many values up to the last that isn't zero, made even."""
    last = F.aggregate(F.transform(q, lambda v, i: F.when(v != 0, i + 1).otherwise(0)), F.lit(0), lambda a, v: F.greatest(a, v))
    return let(last, lambda n: n + n % 2)


def blocks(df: DataFrame, length: int = 8, distortion: float = DISTORTION) -> DataFrame:
    """Traces as blocks: coefficients y, step delta, integers q and their extent."""
    y = apply_matrix(df, "samples", lot.matrix(N1, length), "y").withColumn("delta", step(F.col("y"), distortion))
    q = y.withColumn("q", quantized(F.col("y"), F.col("delta")))
    return q.withColumn("extent", extent(F.col("q")))


def literal_bytes(v: Column) -> Column:
    """Bytes of a value that isn't zero: 1 from -73 to 74, 2 up to 255, 3 up to 65535, else 5, whatever the sign."""
    a = F.abs(v)
    return F.when((v < 75) & (v > -74), 1).when(a < 256, 2).when(a < 65536, 3).otherwise(5)


def zero_run_bytes(n: Column) -> Column:
    """Bytes of a run of zeros: whole stretches of 65535 take 3, the rest 1 up to 100, 2 up to 255, else 3."""
    whole = F.floor((n - 1) / 65535)
    rest = n - whole * 65535
    return (whole * 3 + F.when(rest <= 100, 1).when(rest <= 255, 2).otherwise(3)).cast("int")


def runs(q: Column, n: Column) -> Column:
    """Tokens of a block's first n values: structs (place, run, value); a run of zeros is one token, any other value one with run 0."""
    cut = F.slice(q, F.lit(1), n)

    def tokens(v: Column) -> Column:
        starts = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("place"), x.alias("value"))), lambda t: (t["value"] != 0) | (t["place"] == 0) | (F.coalesce(F.try_element_at(v, F.greatest(t["place"], F.lit(1))), F.lit(1)) != 0))
        return let(starts, lambda s: F.transform(s, lambda t, k: F.struct(t["place"].alias("place"), F.when(t["value"] == 0, F.coalesce(F.try_element_at(s, k + 2)["place"], F.size(v)) - t["place"]).otherwise(0).cast("int").alias("run"), t["value"].alias("value"))))

    return let(cut, tokens)


def token_bytes(t: Column) -> Column:
    return F.when(t["run"] > 0, zero_run_bytes(t["run"])).otherwise(literal_bytes(t["value"]))


_Y = f"y AS (SELECT trace_id, k, sum(x*w) AS y FROM samples JOIN {lot.values_sql(N1, 8)} USING (i) GROUP BY ALL)"
_D = f"d1 AS (SELECT trace_id, {DISTORTION}e0*sqrt(avg(y*y))/{CPDF}e0 AS d FROM y GROUP BY 1), delta AS (SELECT trace_id, coalesce({DISTORTION}e0*sqrt(avg(CASE WHEN abs(y)>d*0.25e0 THEN y*y END))/{CPDF}e0, 1.0e0) AS delta FROM y JOIN d1 USING (trace_id) GROUP BY 1)"
_Q = "q AS (SELECT trace_id, k, y, delta, CAST(sign(y/delta)*floor(abs(y/delta)+0.5e0) AS INT) AS q FROM y JOIN delta USING (trace_id))"
_E = "m AS (SELECT trace_id, max(CASE WHEN q<>0 THEN k+1 ELSE 0 END) AS m FROM q GROUP BY 1), e AS (SELECT trace_id, CAST(m+m%2 AS INT) AS extent FROM m)"
_R = "c AS (SELECT trace_id, k, q, CASE WHEN q=0 THEN 1 ELSE 0 END AS z FROM q JOIN e USING (trace_id) WHERE k<extent), g AS (SELECT *, CASE WHEN z=1 THEN k-row_number() OVER (PARTITION BY trace_id, z ORDER BY k) ELSE k+1000000 END AS g FROM c), t AS (SELECT trace_id, CAST(min(k) AS INT) AS place, CASE WHEN z=1 THEN CAST(count(*) AS INT) ELSE 0 END AS run, CAST(min(q) AS INT) AS value FROM g GROUP BY trace_id, z, g)"
_B = "b AS (SELECT *, CASE WHEN run>0 THEN CASE WHEN run<=100 THEN 1 WHEN run<=255 THEN 2 ELSE 3 END WHEN value<75 AND value>-74 THEN 1 WHEN abs(value)<256 THEN 2 WHEN abs(value)<65536 THEN 3 ELSE 5 END AS bytes FROM t)"


def chain(*parts: str, body: str) -> str:
    return sql("samples", body=", ".join(parts) + " " + body)


@query("quant_delta", chain(_Y, _D, body="SELECT trace_id, floor(delta*1e4+0.5e0)/1e4 AS delta FROM delta"))
def quant_delta(spark, d):
    return blocks(traces(spark, d)).select("trace_id", r4(F.col("delta")).alias("delta"))


@query("block_rms", chain(_Y, _D, body="SELECT trace_id, floor(sqrt(avg(y*y))*1e4+0.5e0)/1e4 AS rms, floor(coalesce(sqrt(avg(CASE WHEN abs(y)>d*0.25e0 THEN y*y END)),0.0e0)*1e4+0.5e0)/1e4 AS rms_large FROM y JOIN d1 USING (trace_id) GROUP BY 1"))
def block_rms(spark, d):
    """Root mean square of each block, of all values and of those beyond a quarter of the first step."""
    y, x = apply_matrix(traces(spark, d), "samples", lot.matrix(N1, 8), "y"), F.col("y")
    first = F.sqrt(mean_square(x))
    large = let(DISTORTION * first / CPDF, lambda s: let(F.filter(x, lambda v: F.abs(v) > s * 0.25), lambda b: F.when(F.size(b) == 0, 0.0).otherwise(F.sqrt(mean_square(b)))))
    return y.select("trace_id", r4(first).alias("rms"), r4(large).alias("rms_large"))


@query("quantize", chain(_Y, _D, _Q, body="SELECT trace_id, CAST(k AS INT) AS k, q FROM q"))
def quantize(spark, d):
    return blocks(traces(spark, d)).select("trace_id", F.posexplode("q").alias("k", "q"))


@query("dequantize", chain(_Y, _D, _Q, body="SELECT trace_id, CAST(k AS INT) AS k, floor(q*delta*1e4+0.5e0)/1e4 + 0.0e0 AS y FROM q"))
def dequantize(spark, d):
    return long_form(blocks(traces(spark, d)).withColumn("z", F.transform("q", lambda v: v * F.col("delta"))), "z", "k", "y", "trace_id")


@query("nonzero_extent", chain(_Y, _D, _Q, _E, body="SELECT trace_id, extent FROM e"))
def nonzero_extent(spark, d):
    return blocks(traces(spark, d)).select("trace_id", F.col("extent").cast("int").alias("extent"))


@query("rle_tokens", chain(_Y, _D, _Q, _E, _R, body="SELECT trace_id, place, run, value FROM t"))
def rle_tokens(spark, d):
    return blocks(traces(spark, d)).select("trace_id", F.inline(runs(F.col("q"), F.col("extent"))))


@query("rle_bytes", chain(_Y, _D, _Q, _E, _R, _B, body="SELECT e.trace_id, CAST(coalesce(sum(bytes),0) AS BIGINT) AS bytes, CAST(count(place) AS BIGINT) AS tokens FROM e LEFT JOIN b ON b.trace_id=e.trace_id GROUP BY 1"))
def rle_bytes(spark, d):
    """Bytes and tokens of each block after run-length coding."""
    t = blocks(traces(spark, d)).withColumn("t", runs(F.col("q"), F.col("extent")))
    return t.select("trace_id", F.aggregate("t", F.lit(0), lambda a, x: a + token_bytes(x)).cast("long").alias("bytes"), F.size("t").cast("long").alias("tokens"))


@query("symbol_histogram", chain(_Y, _D, _Q, _E, _R, body="SELECT CASE WHEN run>0 THEN 'zeros' ELSE CAST(value AS VARCHAR) END AS symbol, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1"))
def symbol_histogram(spark, d):
    """How often each symbol occurs in all blocks' tokens."""
    t = blocks(traces(spark, d)).select(F.inline(runs(F.col("q"), F.col("extent"))))
    return t.groupBy(F.when(F.col("run") > 0, "zeros").otherwise(F.col("value").cast("string")).alias("symbol")).agg(F.count("*").alias("n"))


@query("block_encoded_size", chain(_Y, _D, _Q, _E, _R, _B, body="SELECT e.trace_id, extent, CAST(8+coalesce(sum(bytes),0) AS BIGINT) AS bytes FROM e LEFT JOIN b ON b.trace_id=e.trace_id GROUP BY 1, 2"))
def block_encoded_size(spark, d):
    """Bytes of each block with its header of step and extent, before entropy coding."""
    t = blocks(traces(spark, d)).withColumn("t", runs(F.col("q"), F.col("extent")))
    return t.select("trace_id", F.col("extent").cast("int").alias("extent"), (8 + F.aggregate("t", F.lit(0), lambda a, x: a + token_bytes(x))).cast("long").alias("bytes"))

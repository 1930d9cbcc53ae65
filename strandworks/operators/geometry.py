"""Uniform samplings, vectors and grids as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query
from ..tables import r4, sql, table, traces


def index_of(value: Column, first: float, delta: float, n: int) -> Column:
    """The nearest index of a uniform sampling, within it."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((value - first) / delta + 0.5))).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cross(a: Column, b: Column) -> Column:
    at = lambda v, k: F.element_at(v, k % 3 + 1)
    return F.array(*(at(a, k + 1) * at(b, k + 2) - at(a, k + 2) * at(b, k + 1) for k in range(3)))


def vectors(spark, d):
    """Two vectors of each trace: its first three samples, and the next three."""
    x = F.col("samples").cast("array<double>")
    return traces(spark, d).select("trace_id", F.slice(x, 1, 3).alias("a"), F.slice(x, 4, 3).alias("b"))


_V = "v AS (SELECT trace_id, " + ", ".join(f"CAST(samples[{k + 1}] AS DOUBLE) AS {c}" for k, c in enumerate(("ax", "ay", "az", "bx", "by_", "bz"))) + " FROM traces)"


@query("sampling_lookup", "SELECT p_partkey, i, floor((10.0e0+i*2.5e0)*1e4+0.5e0)/1e4 AS value FROM (SELECT p_partkey, CAST(greatest(0, least(99, floor((p_retailprice/10.0e0-10.0e0)/2.5e0+0.5e0))) AS INT) AS i FROM part)")
def sampling_lookup(spark, d):
    """The nearest of 100 samples 2.5 apart from 10, for each price."""
    i = index_of(F.col("p_retailprice") / 10.0, 10.0, 2.5, 100)
    return table(spark, d, "part").select("p_partkey", i.alias("i")).withColumn("value", r4(10.0 + F.col("i") * 2.5))


@query("sampling_decimate", sql("samples", body="SELECT trace_id, CAST(i/4 AS INT) AS i, floor(x*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM samples WHERE i%4=0"))
def sampling_decimate(spark, d):
    """Every fourth sample."""
    kept = F.transform(F.filter("samples", lambda v, i: i % 4 == 0), lambda v: r4(v.cast("double")))
    return traces(spark, d).select("trace_id", F.posexplode(kept).alias("i", "x"))


@query("sampling_nearest", sql("samples", body="SELECT trace_id, CAST(i AS INT) AS i, floor(x*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM (SELECT trace_id, i, x, row_number() OVER (PARTITION BY trace_id ORDER BY abs(x-0.1e0), i) AS r FROM samples) WHERE r=1"))
def sampling_nearest(spark, d):
    """The sample nearest to 0.1 of each trace."""
    near = F.array_min(F.transform("samples", lambda v, i: F.struct(F.abs(v.cast("double") - 0.1).alias("far"), i.alias("i"), v.cast("double").alias("x"))))
    return traces(spark, d).select("trace_id", near["i"].alias("i"), r4(near["x"]).alias("x"))


@query("vector_ops", sql("traces", body=_V + """ SELECT trace_id, floor((ax*bx+ay*by_+az*bz)*1e4+0.5e0)/1e4 + 0.0e0 AS dot, floor(sqrt(ax*ax+ay*ay+az*az)*1e4+0.5e0)/1e4 AS norm, floor((ay*bz-az*by_)*1e4+0.5e0)/1e4 + 0.0e0 AS cross_x,
 floor(sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz))*1e4+0.5e0)/1e4 AS distance, floor(acos(greatest(-1.0e0,least(1.0e0,(ax*bx+ay*by_+az*bz)/(sqrt(ax*ax+ay*ay+az*az)*sqrt(bx*bx+by_*by_+bz*bz)))))*1e4+0.5e0)/1e4 AS angle FROM v"""))
def vector_ops(spark, d):
    a, b = F.col("a"), F.col("b")
    norm = lambda v: F.sqrt(dot(v, v))
    between = F.zip_with(a, b, lambda x, y: x - y)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))
    return vectors(spark, d).select("trace_id", r4(dot(a, b)).alias("dot"), r4(norm(a)).alias("norm"), r4(F.element_at(cross(a, b), 1)).alias("cross_x"), r4(norm(between)).alias("distance"), r4(angle).alias("angle"))


@query("vector_rotate", sql("traces", body=_V + " SELECT trace_id, floor((ax*cos(0.5e0)-ay*sin(0.5e0))*1e4+0.5e0)/1e4 + 0.0e0 AS x, floor((ax*sin(0.5e0)+ay*cos(0.5e0))*1e4+0.5e0)/1e4 + 0.0e0 AS y, floor(az*1e4+0.5e0)/1e4 + 0.0e0 AS z FROM v"))
def vector_rotate(spark, d):
    """Vectors turned by half a radian about the third axis, by Rodrigues' formula."""
    from math import cos, sin

    k, a = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("a")
    turned = F.zip_with(F.zip_with(F.transform(a, lambda v: v * cos(0.5)), F.transform(cross(k, a), lambda v: v * sin(0.5)), lambda x, y: x + y), F.transform(k, lambda v: v * dot(k, a) * (1 - cos(0.5))), lambda x, y: x + y)
    out = vectors(spark, d).withColumn("t", turned)
    return out.select("trace_id", *(r4(F.element_at("t", i + 1)).alias(c) for i, c in enumerate("xyz")))


@query("grid_containment", "SELECT p_partkey, p_size BETWEEN 10 AND 29 AND p_retailprice BETWEEN 1000.0e0 AND 1499.0e0 AS inside, CAST(floor((p_size-10)/5.0e0) AS INT) AS cell FROM part")
def grid_containment(spark, d):
    """Whether a part lies in a grid of sizes and prices, and its cell along sizes."""
    inside = F.col("p_size").between(10, 29) & F.col("p_retailprice").between(1000.0, 1499.0)
    return table(spark, d, "part").select("p_partkey", inside.alias("inside"), F.floor((F.col("p_size") - 10) / 5).cast("int").alias("cell"))

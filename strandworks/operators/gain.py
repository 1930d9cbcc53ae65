"""Gains: a curve of time, and gains of gates of 256 samples. Long traces are arrays in order of their samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..tables import N1, long_samples, r4, sql, traces
from .quant import let

GATE, EXPONENT, LEVELS = 256, 0.8, 32766.0


def time_gain(n: Column, exponent: float = EXPONENT) -> Column:
    """The gain of n samples 4 ms apart: time to a power, over its mean."""
    raw = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pow(i * 4.0 / 1000.0, F.lit(exponent)) + 0.001)
    return let(raw, lambda g: let(F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g), lambda mean: F.transform(g, lambda x: x / mean)))


def gate_amplitudes(x: Column) -> Column:
    """Mean size of a trace's values that aren't zero in each gate, damped to twice as much at the last gate; 0 for a gate without any. One gate isn't damped."""
    gates = F.ceil(F.size(x) / GATE).cast("int")

    def mean(j: Column) -> Column:
        live = F.filter(F.slice(x, j * GATE + 1, F.lit(GATE)), lambda v: v != 0)
        average = let(live, lambda v: F.when(F.size(v) == 0, 0.0).otherwise(F.aggregate(v, F.lit(0.0), lambda a, y: a + F.abs(y)) / F.size(v)))
        return average * (1.0 + j / F.greatest(gates - 1, F.lit(1)))

    return F.transform(F.sequence(F.lit(0), gates - 1), mean)


def decaying(a: Column) -> Column:
    """Each value raised to the largest from it on."""
    return let(a, lambda v: F.transform(v, lambda _, j: F.array_max(F.slice(v, j + 1, F.size(v) - j))))


def gate_levels(a: Column) -> Column:
    """Decaying amplitudes in 16-bit levels of the largest, at least 1."""
    return let(a, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.when(top == 0, 1.0).otherwise(F.greatest(F.floor(x / top * LEVELS + 0.5), F.lit(1)).cast("double")))))


def gate_gain(a: Column, n: Column) -> Column:
    """The gain at each of n samples: between gate centres at the edges of gates, then straight from edge to edge. a: decaying amplitudes."""

    def edge(v: Column, i: Column) -> Column:
        j = F.floor(i / GATE).cast("int")
        middle = j * GATE + GATE // 2
        upper, lower = F.when(i <= middle, j - 1).otherwise(j), F.when(i <= middle, j).otherwise(j + 1)
        weight = (lower * GATE + GATE // 2 - i) / F.lit(float(GATE))
        at = lambda k: F.element_at(v, k + 1)
        return F.when(upper < 0, F.element_at(v, 1)).when(lower >= F.size(v), F.element_at(v, -1)).otherwise(weight * at(F.greatest(upper, F.lit(0))) + (1 - weight) * at(F.least(lower, F.size(v) - 1)))

    def gains(v: Column) -> Column:
        def gate(j: Column) -> Column:
            first = j * GATE
            last = F.least(first + GATE, n) - 1
            ends = F.struct(edge(v, first).alias("a"), edge(v, last).alias("b"))
            return let(ends, lambda e: F.transform(F.sequence(F.lit(0), last - first), lambda i: e["a"] + (e["b"] - e["a"]) / F.greatest(last - first, F.lit(1)) * i))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(v) - 1), gate))

    return let(a, gains)


def gathered(spark, d) -> DataFrame:
    """Long traces as arrays."""
    return long_samples(spark, d).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))


def amplitudes(spark, d) -> DataFrame:
    """Long traces with decaying amplitudes as stored, in levels, and their largest."""
    a = gathered(spark, d).withColumn("mean", gate_amplitudes(F.col("x"))).withColumn("decay", decaying(F.col("mean")))
    return a.withColumn("levels", gate_levels(F.col("decay"))).withColumn("stored", F.transform("levels", lambda v: v * F.when(F.array_max("decay") == 0, 1.0).otherwise(F.array_max("decay")) / LEVELS))


_G = "n AS (SELECT trace_id, CAST(ceil(count(*)/256.0e0) AS INT) AS gates, CAST(count(*) AS INT) AS n FROM long_samples GROUP BY 1), g AS (SELECT trace_id, gates, n, CAST(floor(i/256.0e0) AS INT) AS gate, coalesce(avg(CASE WHEN x<>0 THEN abs(x) END),0.0e0) AS m FROM long_samples JOIN n USING (trace_id) GROUP BY trace_id, gates, n, gate), a AS (SELECT trace_id, gates, n, gate, m*(1.0e0+CAST(gate AS DOUBLE)/greatest(gates-1,1)) AS amp FROM g)"
_S = "s AS (SELECT *, max(amp) OVER (PARTITION BY trace_id ORDER BY gate ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS decay, max(amp) OVER (PARTITION BY trace_id) AS top FROM a), l AS (SELECT *, CASE WHEN top=0 THEN 1.0e0 ELSE greatest(floor(decay/top*32766.0e0+0.5e0),1.0e0) END AS level FROM s), st AS (SELECT *, level*(CASE WHEN top=0 THEN 1.0e0 ELSE top END)/32766.0e0 AS amp2 FROM l)"
_I = """e AS (SELECT trace_id, gate, n, edge, i, gates, CASE WHEN i<=gate*256+128 THEN gate-1 ELSE gate END AS u FROM (SELECT *, 0 AS edge, gate*256 AS i FROM st UNION ALL SELECT *, 1 AS edge, least(gate*256+256,n)-1 AS i FROM st)),
v AS (SELECT e.trace_id, e.gate, e.n, e.edge, e.i, CASE WHEN u<0 THEN f.amp2 WHEN u+1>=e.gates THEN z.amp2 ELSE ((u+1)*256+128-e.i)/256.0e0*a1.amp2 + (1.0e0-((u+1)*256+128-e.i)/256.0e0)*a2.amp2 END AS g
 FROM e JOIN st f ON f.trace_id=e.trace_id AND f.gate=0 JOIN st z ON z.trace_id=e.trace_id AND z.gate=e.gates-1 LEFT JOIN st a1 ON a1.trace_id=e.trace_id AND a1.gate=u LEFT JOIN st a2 ON a2.trace_id=e.trace_id AND a2.gate=u+1),
w AS (SELECT a.trace_id, a.gate, a.i AS i0, b.i AS i1, a.g AS g0, b.g AS g1 FROM v a JOIN v b ON a.trace_id=b.trace_id AND a.gate=b.gate AND a.edge=0 AND b.edge=1),
gain AS (SELECT s.trace_id, s.i, s.x, g0+(g1-g0)/greatest(i1-i0,1)*(s.i-i0) AS g FROM long_samples s JOIN w ON w.trace_id=s.trace_id AND s.i BETWEEN i0 AND i1)"""


@query("gate_mean_amp", sql("long_samples", body=_G + " SELECT trace_id, gate, floor(amp*1e4+0.5e0)/1e4 AS amp FROM a"))
def gate_mean_amp(spark, d):
    return amplitudes(spark, d).select("trace_id", F.posexplode(F.transform("mean", r4)).alias("gate", "amp"))


@query("gate_suffix_max", sql("long_samples", body=_G + ", " + _S + " SELECT trace_id, gate, floor(decay*1e4+0.5e0)/1e4 AS amp, CAST(level AS INT) AS level FROM st"))
def gate_suffix_max(spark, d):
    z = F.arrays_zip(F.transform("decay", r4).alias("amp"), F.transform("levels", lambda v: v.cast("int")).alias("level"))
    return amplitudes(spark, d).select("trace_id", F.posexplode(z).alias("gate", "z")).select("trace_id", "gate", "z.amp", "z.level")


def gained(spark, d) -> DataFrame:
    return amplitudes(spark, d).withColumn("gain", gate_gain(F.col("stored"), F.size("x")))


@query("gate_interpolate", sql("long_samples", body=_G + ", " + _S + ", " + _I + " SELECT trace_id, CAST(i AS INT) AS i, floor(g*1e4+0.5e0)/1e4 AS gain FROM gain"))
def gate_interpolate(spark, d):
    return gained(spark, d).select("trace_id", F.posexplode(F.transform("gain", r4)).alias("i", "gain"))


@query("gated_gain_roundtrip", sql("long_samples", body="SELECT trace_id, i, floor(x*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM long_samples"))
def gated_gain_roundtrip(spark, d):
    """Gated gain applied and removed again."""
    on = gained(spark, d).withColumn("y", F.zip_with("x", "gain", lambda x, g: x / g))
    return on.select("trace_id", F.posexplode(F.zip_with("y", "gain", lambda y, g: r4(y * g))).alias("i", "x"))


@query("ft_gain_curve", sql("samples", body=f"t AS (SELECT trace_id, i, pow(i*4.0e0/1000.0e0, {EXPONENT}e0)+0.001e0 AS g FROM samples), m AS (SELECT trace_id, avg(g) AS m FROM t GROUP BY 1) SELECT trace_id, i, floor(g/m*1e4+0.5e0)/1e4 AS gain FROM t JOIN m USING (trace_id)"))
def ft_gain_curve(spark, d):
    """The time gain of each trace's length."""
    return traces(spark, d).select("trace_id", F.posexplode(F.transform(time_gain(F.size("samples")), r4)).alias("i", "gain"))


@query("ft_gain_roundtrip", sql("samples", body="SELECT trace_id, i, floor(x*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM samples"))
def ft_gain_roundtrip(spark, d):
    """Time gain applied and removed again."""
    t = traces(spark, d).withColumn("g", time_gain(F.size("samples"))).withColumn("y", F.zip_with("samples", "g", lambda x, g: x.cast("double") * g))
    return t.select("trace_id", F.posexplode(F.zip_with("y", "g", lambda y, g: r4(y / g))).alias("i", "x"))


@query("first_nonzero", sql("long_samples", body="SELECT trace_id, CAST(coalesce(min(CASE WHEN x<>0 THEN i END), count(*)) AS INT) AS first FROM long_samples GROUP BY 1"))
def first_nonzero(spark, d):
    """Place of the first value that isn't zero; the length where there is none."""
    return long_samples(spark, d).groupBy("trace_id").agg(F.coalesce(F.min(F.when(F.col("x") != 0, F.col("i"))), F.count("*")).cast("int").alias("first"))


@query("remute", sql("samples", body="SELECT trace_id, i, CASE WHEN i < trace_in_frame THEN 0.0e0 ELSE floor(x*1e4+0.5e0)/1e4 + 0.0e0 END AS x FROM samples"))
def remute(spark, d):
    """Samples before a trace's first live one made zero again; a trace's place in its frame stands for that."""
    muted = F.transform("samples", lambda v, i: F.when(i < F.col("trace_in_frame"), 0.0).otherwise(r4(v.cast("double"))))
    return traces(spark, d).select("trace_id", F.posexplode(muted).alias("i", "x"))


@query("zscore_guarded", sql("samples", body="m AS (SELECT trace_id, avg(x) AS m, stddev_pop(x) AS s FROM samples GROUP BY 1) SELECT trace_id, i, floor((CASE WHEN s<1e-10 THEN 0.0e0 ELSE (x-m)/s END)*1e4+0.5e0)/1e4 + 0.0e0 AS z FROM samples JOIN m USING (trace_id)"))
def zscore_guarded(spark, d):
    """Samples less their mean over their deviation; zeros where there is next to none."""
    x = F.transform("samples", lambda v: v.cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    z = let(x, lambda a: let(mean(a), lambda m: let(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)), lambda sd: F.transform(a, lambda v: F.when(sd < 1e-10, 0.0).otherwise(r4((v - m) / sd))))))
    return traces(spark, d).select("trace_id", F.posexplode(z).alias("i", "z"))


@query("trim_or_pad", sql("samples", body="SELECT trace_id, CAST(c.i AS INT) AS i, floor(coalesce(x,0.0e0)*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM (SELECT DISTINCT trace_id FROM samples) t CROSS JOIN (SELECT unnest(range(80)) AS i) c LEFT JOIN samples s USING (trace_id, i)"))
def trim_or_pad(spark, d):
    """Traces cut or filled with zeros to 80 samples."""
    padded = F.slice(F.concat(F.col("samples").cast("array<double>"), F.array_repeat(F.lit(0.0), 80)), 1, 80)
    return traces(spark, d).select("trace_id", F.posexplode(F.transform(padded, r4)).alias("i", "x"))


@query("time_flip", sql("samples", body=f"SELECT trace_id, CAST({N1 - 1}-i AS INT) AS i, floor(x*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM samples"))
def time_flip(spark, d):
    return traces(spark, d).select("trace_id", F.posexplode(F.transform(F.reverse("samples"), lambda v: r4(v.cast("double")))).alias("i", "x"))


@query("mixup_pairs", sql("samples", body="SELECT a.trace_id, a.i, floor((0.7e0*a.x+0.3e0*b.x)*1e4+0.5e0)/1e4 + 0.0e0 AS x, a.frame_key AS label, b.frame_key AS other FROM samples a JOIN samples b ON b.trace_id = a.trace_id - a.trace_id%2 + 1 - a.trace_id%2 AND b.i=a.i"))
def mixup_pairs(spark, d):
    """Each trace blended with its neighbour, 0.7 to 0.3."""
    t = traces(spark, d)
    other = t.select((F.col("trace_id") - F.col("trace_id") % 2 + 1 - F.col("trace_id") % 2).alias("trace_id"), F.col("samples").alias("o"), F.col("frame_key").alias("other"))
    x = F.zip_with("samples", "o", lambda a, b: r4(0.7 * a.cast("double") + 0.3 * b.cast("double")))
    return t.join(other, "trace_id").select("trace_id", F.posexplode(x).alias("i", "x"), F.col("frame_key").alias("label"), "other")

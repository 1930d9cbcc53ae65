"""Weighted draws with replacement, mixup and augmentation: nothing random but by keys, so results don't depend on partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..operators.lapped import worker_path
from ..operators.labels import _MAPPED, mapped
from ..operators.quant import let
from ..registry import query
from ..tables import N1, r4, sql, traces

#: Distinct rows of a stretch, about, and the most stretches: their total weights come to the driver.
STRETCH_ROWS, MOST_STRETCHES = 65_536, 100_000


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's table: a place drawn evenly stays with the chance keep, else its other is taken. The weights' sum must be positive."""
    n = len(weights)
    keep, other = weights * (n / weights.sum()), np.arange(n)
    low, high = [k for k in range(n) if keep[k] < 1], [k for k in range(n) if keep[k] >= 1]
    while low and high:
        k, h = low.pop(), high[-1]
        other[k] = h
        keep[h] -= 1 - keep[k]
        if keep[h] < 1:
            low.append(high.pop())
    keep[[*low, *high]] = 1  # what rounding left over
    return keep, other


def drawn(rows: DataFrame, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """Rows drawn n times in all with replacement, by weight: the rows drawn at least once, each with draws (how often). Rows that are equal in all columns are drawn as one that weighs as much.

    Rows are dealt to stretches by a hash of all columns. The driver splits n over the stretches by their total weights (a multinomial draw); each stretch then draws its part by an alias table, from a generator that
    its number sets. Rows whose weight is null, zero, negative or not finite are never drawn; without any other, the result is empty.
    """
    names = [c for c in rows.columns if c != "draws"]
    worker_path(rows.sparkSession)
    ok = F.when((weight > 0) & (weight < float("inf")), weight.cast("double"))
    distinct = rows.select(*names, ok.alias("draws")).where("draws is not null").groupBy(*names).agg(F.sum("draws").alias("draws"))
    total = distinct.count()
    stretches = max(1, min(MOST_STRETCHES, -(-total // STRETCH_ROWS)))
    cut = distinct.withColumn("_stretch", F.pmod(F.xxhash64(*names), F.lit(stretches)).cast("int"))
    weights = {r["_stretch"]: r["w"] for r in cut.groupBy("_stretch").agg(F.sum("draws").alias("w")).collect()}  # a row a stretch
    order = sorted(weights)
    # to 9 digits, as sums of doubles may end otherwise in another order
    share = np.array([float(f"{weights[s]:.9e}") for s in order])
    parts = dict(zip(order, np.random.Generator(np.random.Philox(seed)).multinomial(n, share / share.sum()).tolist())) if order else {}

    def run(batches):
        import pyarrow as pa

        def finished(table):
            stretch = table.column(len(names) + 1)[0].as_py()
            rng = np.random.Generator(np.random.Philox(key=[seed, stretch + 1]))
            keep, other = alias_table(np.array([float(f"{w:.9e}") for w in table.column(len(names)).to_pylist()]))
            times = np.zeros(len(keep), np.int64)
            left = parts[stretch]
            while left:
                k = min(left, 1 << 20)
                at = rng.integers(0, len(keep), k)
                times += np.bincount(np.where(rng.random(k) < keep[at], at, other[at]), minlength=len(keep))
                left -= k
            out = table.set_column(len(names), "draws", pa.array(times)).select([*names, "draws"])
            return out.filter(pa.array(times > 0)).to_batches()

        held = None  # a stretch's rows, which come one after another
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            stretch = held.column(len(names) + 1).to_numpy()
            cuts = np.concatenate([[0], np.nonzero(np.diff(stretch))[0] + 1])
            for a, b in zip(cuts, cuts[1:]):
                yield from finished(held.slice(a, b - a))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from finished(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in names)
    return cut.repartition("_stretch").sortWithinPartitions("_stretch", F.xxhash64(*names), *names).mapInArrow(run, f"{schema}, draws long")


def balanced(rows: DataFrame, label: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """Draws in which every class weighs the same: n, or as many as there are rows with a class. Rows without a class aren't drawn."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg((1 / F.count("*")).alias("_w"))
    weighted = rows.join(counts, label)
    n = weighted.count() if n is None else n
    return drawn(weighted, F.col("_w"), n, seed).drop("_w")


@query("balanced_draws", f"WITH {_MAPPED}, c AS (SELECT class, count(*) AS rows FROM m WHERE class IS NOT NULL GROUP BY 1) SELECT class, CAST((SELECT sum(rows) FROM c) AS BIGINT) AS all_draws, true AS even, true AS from_class FROM c")
def balanced_draws(spark, d):
    """Draws by inverse class frequency, as many as rows: their number, and of each class whether it has its share within six standard deviations, and no more distinct rows than it has."""
    m = mapped(spark, d).where("class is not null")
    got = balanced(m, "class").groupBy("class").agg(F.sum("draws").alias("k"), F.count("*").alias("rows"))
    had = m.groupBy("class").agg(F.count("*").alias("had"))
    total = got.agg(F.sum("k").alias("all_draws"), F.count("*").alias("classes"))
    n, share = F.col("all_draws"), 1 / F.col("classes")
    even = F.abs(F.col("k") - n * share) <= 6 * F.sqrt(n * share * (1 - share)) + 1
    return got.join(had, "class").join(F.broadcast(total)).select("class", "all_draws", even.alias("even"), (F.col("rows") <= F.col("had")).alias("from_class"))  # total is one row


#: The shape of mixup's shares, rows of a block in which partners are found, and the streams of random numbers.
ALPHA, BLOCK_ROWS = 0.4, 256
SHARE, ORDER, BLOCK, FLIP, SHIFT, GAIN, NOISE = 100, 1, 2, 3, 4, 5, 1000
#: Places that a trace moves at most, how far its gain goes from 1, and the noise's standard deviation.
MOST_SHIFT, GAIN_RANGE, SIGMA = 4, 0.2, 0.02


def mixed_up(rows: DataFrame, key: str, values: str, label: str, total: int | None = None) -> DataFrame:
    """Rows blended with partners: key, values (array of doubles), share, label and other (soft labels: label has share, other the rest).

    Rows fall into blocks by a hash of the key; in a block's random order each row's partner is the next, and the last one's the first. So partners are random without a sort of all rows; a row alone in its block
    is blended with itself. Rows of unequal length are blended as far as the shorter goes. Rows with a null key or null values are dropped. Rows that share a key share a block.
    """
    there = rows.where(F.col(key).isNotNull() & F.col(values).isNotNull()).select(F.col(key).alias("k"), F.col(values).cast("array<double>").alias("v"), F.col(label).alias("l"))
    blocks = max(1, (there.count() if total is None else total) // BLOCK_ROWS)
    cut = there.withColumn("b", F.floor(draws.uniform(F.col("k"), BLOCK) * blocks))
    order = Window.partitionBy("b").orderBy(draws.uniform(F.col("k"), ORDER), "k", "v")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    partner = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(every))
    paired = cut.select("*", partner(F.struct("v", "l")).alias("p")).withColumn("share", draws.beta(F.col("k"), ALPHA, SHARE))
    n = F.least(F.size("v"), F.size("p.v"))
    blend = F.zip_with(F.slice("v", F.lit(1), n), F.slice("p.v", F.lit(1), n), lambda a, b: F.col("share") * a + (1 - F.col("share")) * b)
    return paired.select(F.col("k").alias(key), blend.alias(values), "share", F.col("l").alias("label"), F.col("p.l").alias("other"))


_SHARE = f"s0 AS (SELECT trace_id, t, pow({draws.uniform_sql('trace_id', f'2*t+{SHARE}')}, {1 / ALPHA}e0) AS x, pow({draws.uniform_sql('trace_id', f'2*t+1+{SHARE}')}, {1 / ALPHA}e0) AS y FROM (SELECT CAST(vec_id AS BIGINT) AS trace_id FROM embeddings), range(40) r(t)), share AS (SELECT trace_id, arg_min(x/(x+y), t) AS share FROM s0 WHERE x+y<=1 GROUP BY 1)"
_PAIRS = f"o AS (SELECT trace_id, frame_key, floor({draws.uniform_sql('trace_id', str(BLOCK))} * greatest(1, (SELECT count(*) FROM embeddings)//{BLOCK_ROWS})) AS b, {draws.uniform_sql('trace_id', str(ORDER))} AS u FROM traces), pr AS (SELECT trace_id, frame_key, coalesce(lead(trace_id) OVER w, first_value(trace_id) OVER w) AS pid, coalesce(lead(frame_key) OVER w, first_value(frame_key) OVER w) AS other FROM o WINDOW w AS (PARTITION BY b ORDER BY u, trace_id))"


@query("mixup_beta", sql("traces", "samples", body=f"{_SHARE}, {_PAIRS} SELECT a.trace_id, a.i, floor((share*a.x+(1-share)*c.x)*1e4+0.5e0)/1e4 + 0.0e0 AS x, floor(share*1e4+0.5e0)/1e4 AS share, pr.frame_key AS label, pr.other FROM samples a JOIN pr USING (trace_id) JOIN share USING (trace_id) JOIN samples c ON c.trace_id=pr.pid AND c.i=a.i"))
def mixup_beta(spark, d):
    """Traces blended with random partners in shares of the Beta(0.4, 0.4) distribution, with soft labels."""
    got = mixed_up(traces(spark, d), "trace_id", "samples", "frame_key")
    return got.select("trace_id", F.posexplode(F.transform("samples", r4)).alias("i", "x"), r4(F.col("share")).alias("share"), "label", "other")


def augmented(key: Column, x: Column) -> Column:
    """An array flipped in time for half of all keys, moved by up to MOST_SHIFT places (zeros come in), scaled by 1 +- GAIN_RANGE, with normal noise of SIGMA added."""
    flipped = F.when(draws.uniform(key, FLIP) < 0.5, F.reverse(x)).otherwise(x)
    by = F.floor(draws.uniform(key, SHIFT) * (2 * MOST_SHIFT + 1)).cast("int") - MOST_SHIFT
    zeros = F.array_repeat(F.lit(0.0), MOST_SHIFT)
    moved = let(F.concat(zeros, flipped, zeros), lambda w: F.slice(w, by + MOST_SHIFT + 1, F.size(w) - 2 * MOST_SHIFT))
    gain = 1 + GAIN_RANGE * (2 * draws.uniform(key, GAIN) - 1)
    return F.transform(moved, lambda v, i: v * gain + SIGMA * draws.normal(key, i + NOISE))


_KEYED = f"k AS (SELECT trace_id, {draws.uniform_sql('trace_id', str(FLIP))} < 0.5 AS flip, CAST(floor({draws.uniform_sql('trace_id', str(SHIFT))}*{2 * MOST_SHIFT + 1}) AS INT) - {MOST_SHIFT} AS moved, 1+{GAIN_RANGE}*(2*{draws.uniform_sql('trace_id', str(GAIN))}-1) AS gain FROM traces)"


@query("augmented_traces", sql("traces", "samples", body=f"{_KEYED}, g AS (SELECT trace_id, flip, gain, i, CASE WHEN flip THEN {N1 - 1}-(i+moved) ELSE i+moved END AS src FROM k, range({N1}) r(i)) SELECT g.trace_id, CAST(g.i AS INT) AS i, floor((coalesce(x, 0.0e0)*gain + {SIGMA}*{draws.normal_sql('g.trace_id', f'g.i+{NOISE}')})*1e4+0.5e0)/1e4 + 0.0e0 AS x FROM g LEFT JOIN samples s ON s.trace_id=g.trace_id AND s.i=g.src"))
def augmented_traces(spark, d):
    """Traces flipped, moved, scaled and with noise, each by its own random numbers."""
    x = augmented(F.col("trace_id"), F.col("samples").cast("array<double>"))
    return traces(spark, d).select("trace_id", F.posexplode(F.transform(x, r4)).alias("i", "x"))

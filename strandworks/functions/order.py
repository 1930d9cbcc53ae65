"""Ordered computation over whole tables without a task that sees them whole: the key's range is cut into stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds_of(df: DataFrame, key: str, parts: int | None = None) -> list:
    """Values of an integer key that cut it into about so many even stretches, by default four a shuffle partition; the last is the largest."""
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = df.select(F.percentile_approx(key, F.array(*(F.lit(i / parts) for i in range(1, parts + 1))), 100 * parts), F.max(key)).first()
    return sorted({*(got[0] or []), got[1]} - {None})


def stretch(key: Column, bounds: list) -> Column:
    """How many bounds lie below key, by binary search."""
    if not bounds:
        return F.lit(0)
    values = F.array(*map(F.lit, bounds))
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, w: F.when((at + w <= len(bounds)) & (F.try_element_at(values, at + w) < key), at + w).otherwise(at))


def with_lag(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """Adds the column's value in the row before, in order of a unique key. A stretch's first row gets the last value of the stretch before from a table with a row a stretch."""
    cut = df.withColumn("_s", stretch(F.col(key), bounds_of(df, key)))
    w = Window.partitionBy("_s").orderBy(key)
    last = cut.groupBy("_s").agg(F.max_by(column, key).alias("_last")).withColumn("_prior", F.lag("_last").over(Window.orderBy("_s"))).select("_s", "_prior")
    return cut.withColumn("_n", F.row_number().over(w)).withColumn("_lag", F.lag(column).over(w)).join(last, "_s").withColumn(out, F.when(F.col("_n") == 1, F.col("_prior")).otherwise(F.col("_lag"))).drop("_s", "_n", "_lag", "_prior")


def with_running_sum(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Adds running sums {out: column} in order of a unique key: sums within stretches, and before each from a table with a row a stretch."""
    cut = df.withColumn("_s", stretch(F.col(key), bounds_of(df, key)))
    w = Window.partitionBy("_s").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_s").agg(*(F.sum(c).alias(f"_t{k}") for k, c in enumerate(columns.values())))
    totals = totals.select("_s", *(F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in range(len(columns))))
    out = cut.select("*", *(F.sum(c).over(w).alias(f"_w{k}") for k, c in enumerate(columns.values()))).join(totals, "_s")
    return out.withColumns({o: F.col(f"_w{k}") + F.col(f"_b{k}") for k, o in enumerate(columns)}).drop("_s", *(f"_w{k}" for k in range(len(columns))), *(f"_b{k}" for k in range(len(columns))))


def with_number(df: DataFrame, group: str, key: str, out: str) -> DataFrame:
    """Adds a row's number from 1 within its group, in order of a unique integer key. A group is numbered by stretches of the key, so the largest is dealt over as many tasks; null groups are one group."""
    cut = df.withColumn("_s", stretch(F.col(key), bounds_of(df, key)))
    before = Window.partitionBy("_g").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    counts = cut.groupBy(F.col(group).alias("_g"), F.col("_s").alias("_t")).agg(F.count("*").alias("_c"))
    counts = counts.select("_g", "_t", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    numbered = cut.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_s").orderBy(key)))
    return numbered.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t"))).withColumn(out, F.col("_n") + F.col("_b")).drop("_s", "_t", "_g", "_n", "_b")

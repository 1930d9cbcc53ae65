"""Mergeable sketches of distinct values and of quantiles by day and key, from which any span of days is answered without reading rows again.

A day's sketches are written once. Blocks of WIDTH days, of WIDTH of those and so on are merged from the blocks below, so a span is covered by at most
2 * (WIDTH - 1) blocks a level, however long it is. Sketches merge in any order: a late day's rows are one more row of its block, to be appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..streaming.streams import folder
from ..tables import table

#: Days of a block of level 1, and how many levels there are beside days: the largest block is 512 days.
WIDTH, LEVELS = 8, 3
#: 2^REGISTERS registers give distinct values to 1.6 % (one standard error); SIZE items a compactor give ranks to 0.7 % (with 99 of 100).
REGISTERS, SIZE = 12, 400
OWN = ("level", "block", "n", "distinct", "spread")


def by_day(df: DataFrame, ts: str, keys: list[str], distinct: str, value: str) -> DataFrame:
    """One row for each day (block, in days since 1970, at level 0) and keys: n rows, and binary sketches of the distinct values of one column and of the spread of another.

    Tasks sketch before they shuffle, so a key with many rows is one small row a task. Nulls are keys of their own and count in n; in sketched columns they are left out, as are values
    that aren't numbers. Rows without a time belong to no day. spread is null where no value is left.
    """
    if clash := {*keys} & {*OWN}:
        raise ValueError(f"keys can't be named {sorted(clash)}")
    number = F.col(value).cast("double")
    rows = df.where(F.col(ts).isNotNull()).select(F.unix_date(F.to_date(ts)).alias("block"), *keys, F.col(distinct).alias("distinct"), F.when(~F.isnan(number), number).alias("spread"))
    sketched = rows.groupBy("block", *keys).agg(F.count("*").alias("n"), F.hll_sketch_agg("distinct", REGISTERS).alias("distinct"), F.kll_sketch_agg_double("spread", SIZE).alias("spread"), F.count("spread").alias("_values"))
    return sketched.select(F.lit(0).alias("level"), "block", *keys, "n", "distinct", F.when(F.col("_values") > 0, F.col("spread")).alias("spread"))


def _merged(rows: DataFrame, by: list) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("spread", SIZE).alias("spread"), F.count("spread").alias("_values")).withColumn("spread", F.when(F.col("_values") > 0, F.col("spread"))).drop("_values")


def write(days: DataFrame, keys: list[str], path: str, mode: str = "append") -> None:
    """Writes sketches of days and of the blocks above them, a folder a level; each level is merged from what was written of the one below, so rows are read once."""
    days.drop("level").write.mode(mode).parquet(f"{path}/level=0")
    spark, below = days.sparkSession, days.drop("level")
    written = spark.read.schema(below.schema).parquet(f"{path}/level=0")
    for level in range(1, LEVELS + 1):
        # all of the level is merged anew: its rows are few, and blocks that got late days mustn't be counted twice
        written = _merged(written.withColumn("block", F.floor(F.col("block") / WIDTH).cast("int")), ["block", *keys]).select(below.columns)
        written.write.mode("overwrite").parquet(f"{path}/level={level}")
        written = spark.read.schema(below.schema).parquet(f"{path}/level={level}")


def cover(first: int, last: int) -> list[tuple[int, int]]:
    """The fewest (level, block) that cover the days from first to last and no other."""
    out, level = [], 0
    while first <= last:
        if level == LEVELS:
            out += [(level, b) for b in range(first, last + 1)]
            break
        while first <= last and first % WIDTH:
            out.append((level, first))
            first += 1
        while first <= last and (last + 1) % WIDTH:
            out.append((level, last))
            last -= 1
        first, last, level = first // WIDTH, (last + 1) // WIDTH - 1, level + 1
    return out


def over(spark, path: str, keys: list[str], spans: dict[int, tuple[int, int]]) -> DataFrame:
    """Merged sketches of each span (its number: first and last day) and keys: span, keys, n, distinct, spread. Spans may overlap; all are answered in one pass over the blocks they need. A span without rows has none."""
    wanted = [(s, level, block) for s, (first, last) in spans.items() for level, block in cover(first, last)]
    blocks = spark.createDataFrame(wanted, "span int, level int, block int")
    # the list has as many rows as the asker's spans need, whatever the tables hold
    return _merged(spark.read.parquet(path).join(F.broadcast(blocks), ["level", "block"]), ["span", *keys])


def estimates(merged: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """span, keys, n, distinct (a whole number) and a value at each rank, named as ranks say; null where there is no value."""
    at = lambda r: F.when(F.col("spread").isNotNull(), F.kll_sketch_get_quantile_double("spread", F.lit(r)))
    return merged.select("span", *keys, "n", F.hll_sketch_estimate("distinct").alias("distinct"), *(at(r).alias(c) for c, r in ranks.items()))


#: First and last day of the queries' spans, counted from the table's first day.
SPANS = {0: (0, 0), 1: (3, 9), 2: (0, 29), 3: (5, 27)}
RANKS = {"median": 0.5, "p95": 0.95}


def _estimated(spark, d) -> tuple[DataFrame, DataFrame, dict[int, tuple[int, int]]]:
    """The table, estimates of all spans of it by kind of event, and the spans in days since 1970."""
    events = table(spark, d, "events")
    path = folder(spark, "sketches")
    write(by_day(events, "ts", ["event_type"], "user_id", "value"), ["event_type"], path)
    start = spark.read.parquet(f"{path}/level=0").agg(F.min("block")).first()[0]
    spans = {} if start is None else {s: (start + a, start + b) for s, (a, b) in SPANS.items()}
    return events, estimates(over(spark, path, ["event_type"], spans), ["event_type"], RANKS), spans


@query("sketch_spans")
def sketch_spans(spark, d):
    """Rows, users and two quantiles of the values, by span of days and kind of event, from stored sketches."""
    return _estimated(spark, d)[1].withColumnRenamed("distinct", "users")


#: What estimates may be off: a share of the distinct values (three standard errors), and a share of all ranks.
DISTINCT_OFF, RANK_OFF = 0.05, 0.02


def _spans_of(day: Column, spans: dict[int, tuple[int, int]]) -> Column:
    return F.array_compact(F.array(*(F.when(day.between(a, b), F.lit(s)) for s, (a, b) in spans.items()))) if spans else F.array().cast("array<int>")


_SPANS_SQL = ", ".join(f"({s}, {a}, {b})" for s, (a, b) in SPANS.items())


@query("sketch_errors", f"WITH e AS (SELECT CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day, event_type, user_id FROM events), f AS (SELECT min(day) AS first FROM e) SELECT CAST(span AS INT) AS span, event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS users_close, TRUE AS median_close, TRUE AS p95_close FROM e, f, (VALUES {_SPANS_SQL}) s(span, a, b) WHERE day BETWEEN first+CAST(a AS INT) AND first+CAST(b AS INT) GROUP BY 1, 2")
def sketch_errors(spark, d):
    """Exact counts of rows (from the sketches' table) and users (from the rows) by span and kind, and whether the sketches' estimates lie within the stated bounds of what the rows say."""
    events, found, spans = _estimated(spark, d)
    e = events.select("event_type", "user_id", "value", F.explode(_spans_of(F.unix_date(F.to_date("ts")), spans)).alias("span"))
    near = found.select("span", F.col("event_type").alias("kind"), *RANKS)
    # a row for each span and kind is broadcast, as many as the estimates have
    ranked = e.join(F.broadcast(near), (e["span"] == near["span"]) & e["event_type"].eqNullSafe(near["kind"])).drop(near["span"])
    off = lambda c, r: (F.greatest(F.lit(r) - F.count_if(F.col("value") <= F.col(c)) / F.count("value"), F.count_if(F.col("value") < F.col(c)) / F.count("value") - F.lit(r)) <= RANK_OFF).alias(f"{c}_close")
    exact = ranked.groupBy("span", "event_type").agg(F.count_distinct("user_id").alias("users"), *(off(c, r) for c, r in RANKS.items()))
    kind = found.select(F.col("span").alias("_s"), F.col("event_type").alias("_k"), "n", "distinct")
    return exact.join(kind, (F.col("span") == F.col("_s")) & F.col("event_type").eqNullSafe(F.col("_k"))).select("span", "event_type", "n", "users", (F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * DISTINCT_OFF)).alias("users_close"), *(f"{c}_close" for c in RANKS))

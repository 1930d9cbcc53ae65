"""As-of joins: each row gets the nearest row of another table before it, after it, or either, by a key and an ordered column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import bounds_of, stretch
from ..registry import query
from ..tables import table

DIRECTIONS = ("backward", "forward", "nearest")


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, direction: str = "backward", tolerance: int | None = None) -> DataFrame:
    """Adds match (a struct of right's columns but by; null without one) to the rows of left: right's row of the same by whose on is nearest, at or before left's (backward), at or after (forward), or either (nearest: of
    two as near the earlier), and no further than the tolerance. on is a whole number in both. Of right's rows with one place the greatest in order of its other columns counts. Nulls match nothing.

    Both tables are cut into stretches of on, so a key with many rows is many tasks' work. Within a stretch the last (or next) row of right is carried along; what lies in other stretches comes from a table with a
    row for each key and stretch that has rows of right. No window holds all of a key's rows, and nothing is joined by inequality.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"the direction must be one of {DIRECTIONS}")
    kept = [c for c in left.columns if c != "match"]
    values = [c for c in right.columns if c not in (by, on)]
    match = F.struct(F.col(on).cast("long").alias(on), *values)
    theirs = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(on).cast("long").alias("_on")).agg(F.max(match).alias("_match"))
    ours = left.select(*(F.col(c).alias(f"_l{k}") for k, c in enumerate(kept)), F.col(by).alias("_by"), F.col(on).cast("long").alias("_on"), F.lit(True).alias("_mine"))
    bounds = bounds_of(ours.select("_on").unionByName(theirs.select("_on")), "_on")
    empty = theirs.withColumns({f"_l{k}": F.lit(None).cast(left.schema[c].dataType) for k, c in enumerate(kept)}).withColumn("_mine", F.lit(False))
    cut = ours.withColumn("_match", F.lit(None).cast(theirs.schema["_match"].dataType)).unionByName(empty).withColumn("_s", stretch(F.col("_on"), bounds))
    out, found = cut, []
    for way, wanted in (("backward", direction != "forward"), ("forward", direction != "backward")):
        if not wanted:
            continue
        back = way == "backward"
        # at one place right's row comes first on the way there
        order = (F.asc if back else F.desc)("_on"), F.col("_mine")
        upto = Window.partitionBy("_by", "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        # every stretch of a key that has rows of either table gets the end of the nearest one with rows of right
        places = cut.groupBy("_by", "_s").agg((F.max_by if back else F.min_by)("_match", F.when(F.col("_match").isNotNull(), F.col("_on"))).alias("_end"))
        beyond = Window.partitionBy("_by").orderBy((F.asc if back else F.desc)("_s")).rowsBetween(Window.unboundedPreceding, -1)
        carried = places.select("_by", "_s", F.last("_end", True).over(beyond).alias(f"_{way}_far"))
        out = out.withColumn(f"_{way}", F.last("_match", True).over(upto)).join(carried.withColumnsRenamed({"_by": "_b", "_s": "_t"}), F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_s") == F.col("_t"))).drop("_b", "_t")
        out = out.withColumn(f"_{way}", F.coalesce(f"_{way}", f"_{way}_far")).drop(f"_{way}_far")
        found.append(F.col(f"_{way}"))
    far = lambda m: F.abs(m[on] - F.col("_on"))
    best = found[0] if len(found) == 1 else F.when(found[0].isNull() | (far(found[1]) < far(found[0])), F.coalesce(found[1], found[0])).otherwise(found[0])
    if tolerance is not None:
        best = F.when(far(best) <= tolerance, best)
    return out.where("_mine").select(*(F.col(f"_l{k}").alias(c) for k, c in enumerate(kept)), F.when(F.col("_by").isNotNull() & F.col("_on").isNotNull(), best).alias("match"))


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    # the table is named twice: one plan of both sides trips the optimizer's pushing of projections through unions
    of = lambda kind, name: table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias("device"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return of("error", "event_id"), of("view", "view_id")


_E = "e AS (SELECT event_id, user_id AS device, epoch_us(CAST(ts AS TIMESTAMP)) AS tick, event_type FROM events), l AS (SELECT event_id, device, tick FROM e WHERE event_type='error'), r AS (SELECT device, tick, max(event_id) AS view_id FROM e WHERE event_type='view' GROUP BY 1, 2)"


@query("asof_backward", f"WITH {_E} SELECT l.event_id, r.view_id, l.tick-r.tick AS gap FROM l ASOF LEFT JOIN r ON l.device=r.device AND l.tick>=r.tick")
def asof_backward(spark, d):
    """Errors with the last view of their device before, and the microseconds between."""
    left, right = _sides(spark, d)
    return as_of(left, right, "device", "at").select("event_id", "match.view_id", (F.col("at") - F.col("match.at")).alias("gap"))


#: Half an hour in microseconds.
TOLERANCE = 1_800_000_000


@query("asof_nearest", f"WITH {_E}, b AS (SELECT l.event_id, r.view_id, l.tick-r.tick AS gap FROM l ASOF LEFT JOIN r ON l.device=r.device AND l.tick>=r.tick), f AS (SELECT l.event_id, r.view_id, r.tick-l.tick AS gap FROM l ASOF LEFT JOIN r ON l.device=r.device AND l.tick<=r.tick), n AS (SELECT event_id, CASE WHEN b.gap IS NULL OR f.gap<b.gap THEN f.view_id ELSE b.view_id END AS view_id, CASE WHEN b.gap IS NULL OR f.gap<b.gap THEN -f.gap ELSE b.gap END AS gap FROM b JOIN f USING (event_id)) SELECT event_id, CASE WHEN abs(gap)<={TOLERANCE} THEN view_id END AS view_id, CASE WHEN abs(gap)<={TOLERANCE} THEN gap END AS gap FROM n")
def asof_nearest(spark, d):
    """Errors with the nearest view of their device, no more than half an hour before or after, and the microseconds between."""
    left, right = _sides(spark, d)
    return as_of(left, right, "device", "at", "nearest", TOLERANCE).select("event_id", "match.view_id", (F.col("at") - F.col("match.at")).alias("gap"))

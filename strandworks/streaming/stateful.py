"""A counter of verified records with state of its own for each class: typed, with timers, and outliving a restart."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lapped import worker_path
from ..registry import query
from ..tables import sql
from .streams import folder, stream_of

#: Records of a class that make a trigger, and days without one after which a class's count is forgotten.
THRESHOLD, IDLE_DAYS = 50, 30
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "class string, kind string, number long, pending long"


class TriggerCounter(StatefulProcessor):
    """Counts a class's records. At each threshold a row (kind trigger, its number) goes out and the count starts again; a class without records for so long, by the watermark, gives a row (kind idle) with what was pending, and is forgotten."""

    def __init__(self, threshold: int, idle_ms: int):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "pending long, triggers long, seen long, timer long")

    def _row(self, key, kind: str, number: int, pending: int):
        import pandas as pd

        return pd.DataFrame({"class": [key[0]], "kind": [kind], "number": [number], "pending": [pending]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        pending, triggers, seen, timer = self.count.get() if self.count.exists() else (0, 0, None, None)
        for part in rows:
            pending += len(part)
            latest = part["ts_ms"].max()
            seen = int(latest) if seen is None else max(seen, int(latest))
        while pending >= self.threshold:
            pending, triggers = pending - self.threshold, triggers + 1
            yield self._row(key, "trigger", triggers, pending)
        due = seen + self.idle_ms
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.count.update((pending, triggers, seen, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.count.exists():
            pending, triggers, seen, timer = self.count.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= timer:
                self.count.clear()
                yield self._row(key, "idle", triggers, pending)

    def close(self) -> None:
        pass


def count_verified(records: DataFrame, out: str, state: str, threshold: int = THRESHOLD, idle_days: int = IDLE_DAYS) -> None:
    """Runs a stream of verified records (class, ts) over all there is into Parquet files at out, going on from the state of earlier runs.

    Records of a null class count as a class; records without a time, or more than a day behind the watermark's class of records, count as they come. The session's state store isn't touched: the records must be a
    stream of a session of their own (see counting_session).
    """
    timed = records.select("class", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0)).alias("ts_ms")).withWatermark("ts", "1 day")
    rows = timed.groupBy("class").transformWithStateInPandas(TriggerCounter(threshold, idle_days * 86_400_000), RESULT, "Append", "EventTime")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def counting_session(spark):
    """A session beside this one whose streams keep their state as such counters need it."""
    worker_path(spark)
    other = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        other.conf.set(key, spark.conf.get(key))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return other


@query("retrain_events", sql("class_log", body=f"v AS (SELECT CASE WHEN log_id%5=0 THEN 'other' ELSE predicted_class END AS class FROM class_log WHERE log_id%11<>0 AND (log_id%5=0 OR log_id%3<>0)), n AS (SELECT class, count(*)//{THRESHOLD} AS n FROM v GROUP BY 1) SELECT class, CAST(unnest(range(1, n+1)) AS BIGINT) AS number FROM n"))
def retrain_events(spark, d):
    """Each time that a class has gathered 50 more verified records: the class and the event's number, once."""
    other = counting_session(spark)
    e = stream_of(other, d, "events").select(F.col("event_id").alias("n"), "event_type", "ts")
    verified = e.where("n % 11 <> 0 and (n % 5 = 0 or n % 3 <> 0)").select(F.when(F.col("n") % 5 == 0, "other").otherwise(F.col("event_type")).alias("class"), "ts")
    out = folder(spark, "retrain-events")
    count_verified(verified, out, folder(spark, "retrain-events-state"))
    return spark.read.schema(RESULT).parquet(out).where("kind = 'trigger'").select("class", "number")

"""Structured Streaming over files of records: watching, deduplication, routing, windows and counters.

Each query streams the table's files with an available-now trigger into a table in a folder that driver and executors share, and returns that table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..tables import class_log, r4, sql, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder, in full, in spark.checkpoint.dir; in local mode in a temporary one where that is unset, on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = Path(tempfile.gettempdir()).as_uri()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream; each file is read once, whatever fails meanwhile."""
    there = table(spark, d, name)
    reader = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", 8)
    files = there.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):  # a single file, which a stream finds in its folder
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(f"{d}/{name}.parquet")


def drained(stream: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all there is, in append mode, and returns what it wrote, in a folder for each value of the columns by."""
    spark = stream.sparkSession
    out, state = folder(spark, name), folder(spark, f"{name}-state")
    stream.writeStream.format("parquet").partitionBy(*by).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def passed_over(stream: DataFrame, name: str) -> str:
    """A state in which the files that are there now count as seen; their records aren't read."""
    state = folder(stream.sparkSession, f"{name}-state")
    stream.writeStream.foreachBatch(lambda batch, number: None).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return state


def by_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, str], DataFrame], mode: str = "append", state: str | None = None) -> DataFrame:
    """Runs a stream batch by batch, from a state if one is named, each written to a folder of its own number, so that a repeated batch replaces itself; returns all batches."""
    spark = stream.sparkSession
    out, state = folder(spark, name), state or folder(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        handle(batch, out).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def log_stream(spark, d) -> DataFrame:
    e = stream_of(spark, d, "events")
    confidence = F.floor(F.col("value") / (F.col("value") + 50.0) * 1e4 + 0.5) / 1e4
    return e.select(F.col("event_id").cast("long").alias("log_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("sig_"), F.col("user_id").cast("string"), F.lit(".png")).alias("filename"), F.col("event_type").alias("predicted_class"), confidence.alias("confidence"))


@query("stream_watch", sql("class_log", body="SELECT log_id, filename, predicted_class, confidence<0.6e0 AS uncertain FROM class_log"))
def stream_watch(spark, d):
    """Records of new files, each classified once."""
    return drained(log_stream(spark, d).select("log_id", "filename", "predicted_class", (F.col("confidence") < 0.6).alias("uncertain")), "watch")


@query("stream_watch_new", sql("class_log", body="SELECT log_id, predicted_class FROM class_log WHERE log_id%3<>0"))
def stream_watch_new(spark, d):
    """Records of the files that come after the watch began; those in the folder at its start are passed over."""
    path, log = folder(spark, "inbox"), class_log(spark, d).select("log_id", "predicted_class")
    log.where("log_id % 3 = 0").write.parquet(path)
    inbox = spark.readStream.schema(log.schema).parquet(path)
    state = passed_over(inbox, "watch-new")
    log.where("log_id % 3 <> 0").write.mode("append").parquet(path)
    return by_batches(inbox, "watch-new", lambda b, _: b, state=state).select(*log.columns)


@query("stream_dedup", sql("class_log", body="SELECT DISTINCT filename FROM class_log"))
def stream_dedup(spark, d):
    """File names, each once, remembered in the query's state."""
    return drained(log_stream(spark, d).select("filename").dropDuplicates(["filename"]), "dedup")


@query("stream_route", sql("class_log", body="SELECT log_id, concat('predicted_class=', predicted_class) AS folder, predicted_class FROM class_log"))
def stream_route(spark, d):
    """Records routed to a folder for each class, and the name of the folder that each is found in."""
    routed = drained(log_stream(spark, d).select("log_id", "predicted_class"), "pending", by=("predicted_class",))
    return routed.select("log_id", F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1).alias("folder"), "predicted_class")


@query("tumbling_power", "SELECT user_id AS device, time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS hour, floor(avg(value)*1e4+0.5e0)/1e4 AS watts, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def tumbling_power(spark, d):
    """Mean power of each device by hours, in update mode without a watermark: late rows count, and the state keeps every device's hours."""
    e = stream_of(spark, d, "events").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), "value")
    w = e.groupBy("device", F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    got = by_batches(w, "tumbling", lambda b, _: b.select("device", F.col("w.start").alias("hour"), (F.floor(F.col("v") * 1e4 + 0.5) / 1e4).alias("watts"), "n"), "update")
    # in update mode the last batch that names a window has its final value
    return got.groupBy("device", "hour").agg(F.max_by(F.struct("watts", "n"), "batch").alias("r")).select("device", F.col("hour").cast("timestamp_ntz").alias("hour"), "r.watts", "r.n")


def timed(spark, d) -> DataFrame:
    """Events with a watermark a day behind the latest: later ones of an earlier file are dropped, and windows that ended before it are complete."""
    e = stream_of(spark, d, "events").select("event_id", F.col("user_id").alias("device"), "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.withWatermark("ts", "1 day")


#: What has ended before the watermark; the watermark counts whole milliseconds.
_COMPLETE = "<= (SELECT date_trunc('millisecond', max(CAST(ts AS TIMESTAMP))) - INTERVAL '1 day' FROM events)"


def _local(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


@query("watermarked_power", f"SELECT device, hour, floor(v*1e4+0.5e0)/1e4 AS watts, n FROM (SELECT user_id AS device, time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS hour, avg(value) AS v, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2) WHERE hour + INTERVAL '1 hour' {_COMPLETE}")
def watermarked_power(spark, d):
    """Mean power of each device by hours that are complete, each written once; the state holds a day of hours."""
    w = timed(spark, d).groupBy("device", F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return drained(w.select("device", F.col("w.start").alias("hour"), "v", "n"), "watermarked").select("device", _local("hour").alias("hour"), r4(F.col("v")).alias("watts"), "n")


@query("sliding_power", f"SELECT start, floor(v*1e4+0.5e0)/1e4 AS watts, n FROM (SELECT time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) - k * INTERVAL '1 hour' AS start, avg(value) AS v, CAST(count(*) AS BIGINT) AS n FROM events, range(3) t(k) GROUP BY 1) WHERE start + INTERVAL '3 hours' {_COMPLETE}")
def sliding_power(spark, d):
    """Mean power by windows of three hours that begin every hour, once complete."""
    w = timed(spark, d).groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return drained(w.select(F.col("w.start").alias("start"), "v", "n"), "sliding").select(_local("start").alias("start"), r4(F.col("v")).alias("watts"), "n")


@query("device_sessions", f"WITH g AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN CAST(ts AS TIMESTAMP) <= lag(CAST(ts AS TIMESTAMP)) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id AS device, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS stop, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL '6 hours' {_COMPLETE}")
def device_sessions(spark, d):
    """Stretches of readings of a device with no more than six hours between them, once complete."""
    w = timed(spark, d).groupBy("device", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return drained(w.select("device", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"), "sessions").select("device", _local("start").alias("start"), _local("stop").alias("stop"), "n")


@query("followed_errors", "SELECT e.event_id AS error_id, p.event_id AS view_id FROM events e JOIN events p ON e.user_id=p.user_id AND p.ts BETWEEN e.ts AND e.ts + INTERVAL '2 hours' WHERE e.event_type='error' AND p.event_type='view'")
def followed_errors(spark, d):
    """Errors with the views of the same device in the two hours after: a join of two streams, whose state the watermarks and the time between bound."""
    error = timed(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "device", F.col("ts").alias("failed"))
    view = timed(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("device").alias("viewer"), F.col("ts").alias("viewed"))
    return drained(error.join(view, F.expr("device = viewer AND viewed BETWEEN failed AND failed + INTERVAL 2 HOURS")).select("error_id", "view_id"), "followed")


def lines_after(log: DataFrame, cursor: int, most: int = 2000) -> DataFrame:
    """line and next: up to so many lines after a cursor, in order, and the cursor to ask with afterwards. Lines are found by number, so none is lost however far behind a reader is."""
    page = log.where(F.col("line") > cursor).orderBy("line").limit(most)
    return page.withColumn("next", F.max("line").over(Window.partitionBy(F.lit(0))))  # a page


@query("log_cursor", "WITH c AS (SELECT max(event_id)//4 AS c FROM events), p AS (SELECT event_id AS line FROM events, c WHERE event_id > c ORDER BY event_id LIMIT 2000) SELECT line, max(line) OVER () AS next FROM p")
def log_cursor(spark, d):
    """The page of a log after a cursor at its first quarter."""
    log = table(spark, d, "events").select(F.col("event_id").alias("line"))
    return lines_after(log, (log.agg(F.max("line")).first()[0] or 0) // 4)


@query("log_tail", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 2000")
def log_tail(spark, d):
    """The last 2000 lines of a log."""
    return table(spark, d, "events").select("event_id").orderBy(F.desc("event_id")).limit(2000)


@query("log_run_capture", "SELECT event_id, nullif(regexp_extract(line, 'Run: (run_[0-9]+)', 1), '') AS run FROM (SELECT event_id, CASE WHEN event_id%10=0 THEN concat('Run: run_', CAST(user_id AS VARCHAR), ' started') ELSE props END AS line FROM events)")
def log_run_capture(spark, d):
    """Run names in a log's lines."""
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("Run: run_"), F.col("user_id").cast("string"), F.lit(" started"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.nullif(F.regexp_extract(line, "Run: (run_[0-9]+)", 1), F.lit("")).alias("run"))


@query("retrain_trigger", "SELECT event_type AS class, CAST(floor(count(*)/50.0e0) AS BIGINT) AS triggers FROM events GROUP BY 1")
def retrain_trigger(spark, d):
    """How often each class has gathered 50 verified records: a running count by class in the query's state."""
    e = stream_of(spark, d, "events").groupBy(F.col("event_type").alias("class")).agg(F.count("*").alias("n"))
    got = by_batches(e, "retrain", lambda b, _: b, "update")
    return got.groupBy("class").agg(F.max_by("n", "batch").alias("n")).select("class", F.floor(F.col("n") / 50).cast("long").alias("triggers"))

"""Records in text files: metadata in CSV, runs and models described in JSON of several ages, reports as lines of text.

Files are written and read by Spark's own sources. A run is a line with its descriptions as JSON text, so one scan with a stated schema reads every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import duration_text, first_truthy, run_time
from ..operators.evaluate import predicted, report
from ..operators.evaluate import _C as CENTROIDS
from ..operators.evaluate import _P as PREDICTED
from ..registry import query
from ..streaming.streams import folder
from ..tables import r4, sql, table

#: What a run's description and its sidecar may hold; whatever else they hold is left unread.
RUN = "best_val_accuracy double, val_accuracy double, p1_epochs int, p2_epochs int, epochs int, model string, unreadable string"
SIDECAR = "start_time double, end_time double, gpu_energy_wh double, unreadable string"
MODEL = "class_names array<string>, confidence_threshold double, in_chans int, norm_mean array<double>, norm_std array<double>, img_size int, unreadable string"

# Means and deviations of colour channels, the side of an image and the threshold of older models.
COLOUR_MEAN = (0.485, 0.456, 0.406)
COLOUR_STD = (0.229, 0.224, 0.225)
SIDE = 224
THRESHOLD = 0.6


def described(text: Column, schema: str) -> Column:
    """JSON text by a schema that ends with the column unreadable, which holds text that isn't JSON."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"})


def parse_runs(lines: DataFrame) -> DataFrame:
    """name, started, accuracy, epochs, model, training_time, energy and is_best of runs (name, meta, sidecar, written).

    meta and sidecar are JSON texts or null, written is the second at which the model was last written, or null. A run without meta has
    nulls in what meta tells; one whose meta can't be read goes; a sidecar that can't be read counts as none. Zero counts as missing where
    there is something to fall back on. Without times in the sidecar the model's time after the start counts, if less than a day. The best
    run is the last by name of those with the greatest accuracy.
    """
    m, s = F.col("m"), F.col("s")
    read = lines.select("name", "written", run_time(F.col("name")).alias("started"), described(F.col("meta"), RUN).alias("m"), described(F.col("sidecar"), SIDECAR).alias("s"), F.col("meta").isNull().alias("bare")).where(F.col("bare") | m.isNotNull() & m["unreadable"].isNull())
    timed = (s["start_time"] != 0) & (s["end_time"] != 0)
    since = F.col("written") - F.unix_timestamp("started")
    seconds = F.when(timed, F.floor(s["end_time"] - s["start_time"])).when((since > 0) & (since < 86400), since)
    phases = F.coalesce(m["p1_epochs"], F.lit(0)) + F.coalesce(m["p2_epochs"], F.lit(0))
    accuracy = F.coalesce(first_truthy(m["best_val_accuracy"]), m["val_accuracy"])
    runs = read.select("name", "started", accuracy.alias("accuracy"), F.coalesce(first_truthy(phases), m["epochs"]).alias("epochs"), m["model"].alias("model"), F.when(m.isNotNull(), duration_text(seconds)).alias("training_time"), F.when(m.isNotNull(), s["gpu_energy_wh"]).alias("energy"))
    best = runs.where("accuracy is not null").agg(F.max_by("name", F.struct("accuracy", "name")).alias("best"))
    return runs.join(F.broadcast(best)).withColumn("is_best", F.coalesce(F.col("name") == F.col("best"), F.lit(False))).drop("best")  # one row


def run_lines(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs whose descriptions have several ages: two phases, one phase, none, broken; some have a sidecar."""
    u = F.col("user_id")
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"), r4(F.max(F.col("value") / (F.col("value") + 50.0))).alias("acc"), F.date_trunc("second", F.min("ts").cast("timestamp")).alias("t"))
    newer = F.to_json(F.struct(F.col("acc").alias("best_val_accuracy"), F.lit(0.5).alias("val_accuracy"), F.lit(3).alias("p1_epochs"), F.col("n").alias("p2_epochs"), F.lit(7).alias("epochs"), F.lit("das").alias("model"), F.array(F.lit("a")).alias("more")))
    older = F.to_json(F.struct(F.when(u % 3 == 0, 0.0).alias("best_val_accuracy"), F.col("acc").alias("val_accuracy"), F.col("n").alias("epochs")))
    meta = F.when(u % 7 == 3, F.lit(None).cast("string")).when(u % 7 == 5, F.lit('{"epochs": ')).when(u % 2 == 0, newer).otherwise(older)
    sidecar = F.when(u % 3 == 1, F.to_json(F.struct(F.lit(100.5).alias("start_time"), (F.col("n") + 100.75).alias("end_time"), (F.col("n") * 2.0).alias("gpu_energy_wh")))).when(u % 3 == 2, F.lit("{broken"))
    name = F.concat(F.lit("run_u"), u.cast("string"), F.when(u % 11 == 0, "_odd").otherwise(F.date_format("t", "_yyyyMMdd_HHmmss")))
    return g.select(name.alias("name"), meta.alias("meta"), sidecar.alias("sidecar"), F.when(u % 5 != 0, F.unix_timestamp("t") + F.col("n") * 3000).alias("written"))


@query(
    "run_records",
    """WITH g AS (SELECT user_id AS u, CAST(count(*) AS INT) AS n, floor(max(value/(value+50.0e0))*1e4+0.5e0)/1e4 AS acc, date_trunc('second', min(CAST(ts AS TIMESTAMP))) AS t FROM events GROUP BY 1),
r AS (SELECT concat('run_u', u, CASE WHEN u%11=0 THEN '_odd' ELSE strftime(t, '_%Y%m%d_%H%M%S') END) AS name, CASE WHEN u%11<>0 THEN t END AS started, u%7=3 AS bare,
CASE WHEN u%7<>3 THEN acc END AS accuracy, CASE WHEN u%7=3 THEN NULL WHEN u%2=0 THEN n+3 ELSE n END AS epochs, CASE WHEN u%7<>3 AND u%2=0 THEN 'das' END AS model,
CASE WHEN u%3=1 THEN n WHEN u%5<>0 AND u%11<>0 AND n*3000<86400 THEN n*3000 END AS s, CASE WHEN u%3=1 AND u%7<>3 THEN n*2.0e0 END AS energy FROM g WHERE u%7<>5)
SELECT name, started, accuracy, CAST(epochs AS INT) AS epochs, model, CASE WHEN NOT bare THEN concat(s//60, 'm ', s%60, 's') END AS training_time, energy, coalesce(name = (SELECT name FROM r WHERE accuracy IS NOT NULL ORDER BY accuracy DESC, name DESC LIMIT 1), false) AS is_best
FROM (SELECT *, s IS NULL AS z FROM r) WHERE NOT z UNION ALL
SELECT name, started, accuracy, CAST(epochs AS INT), model, NULL, energy, coalesce(name = (SELECT name FROM r WHERE accuracy IS NOT NULL ORDER BY accuracy DESC, name DESC LIMIT 1), false) FROM r WHERE s IS NULL""",
)
def run_records(spark, d):
    """Runs written as lines of JSON and read back, whatever the age of their descriptions."""
    path = folder(spark, "runs")
    run_lines(spark, d).write.json(path)
    got = parse_runs(spark.read.schema("name string, meta string, sidecar string, written long").json(path))
    return got.withColumn("started", F.col("started").cast("timestamp_ntz"))


def parse_models(lines: DataFrame) -> DataFrame:
    """name, classes, threshold, channels, mean, std and side of models (name, meta), with the defaults of models that don't state them.

    Models named das_cnn_ are of one channel unless they say otherwise. A model without readable class names can't be used and goes.
    """
    m, one = F.col("m"), F.col("name").startswith("das_cnn_")
    default = lambda colour: F.when(one, F.array(F.lit(0.5))).otherwise(F.array(*map(F.lit, colour)))
    read = lines.select("name", described(F.col("meta"), MODEL).alias("m")).where(m["unreadable"].isNull() & m["class_names"].isNotNull())
    channels = F.coalesce(m["in_chans"], F.when(one, 1).otherwise(3))
    return read.select("name", F.size(m["class_names"]).alias("classes"), F.coalesce(m["confidence_threshold"], F.lit(THRESHOLD)).alias("threshold"), channels.alias("channels"), F.coalesce(m["norm_mean"], default(COLOUR_MEAN)).alias("mean"), F.coalesce(m["norm_std"], default(COLOUR_STD)).alias("std"), F.coalesce(m["img_size"], F.lit(SIDE)).alias("side"))


@query("model_metadata", "SELECT concat(CASE WHEN s_suppkey%2=0 THEN 'das_cnn_' ELSE 'net_' END, s_suppkey) AS name, CAST(s_nationkey%3+1 AS INT) AS classes, CASE WHEN s_suppkey%3=0 THEN 0.75e0 ELSE 0.6e0 END AS threshold, CAST(CASE WHEN s_suppkey%3=0 THEN 2 WHEN s_suppkey%2=0 THEN 1 ELSE 3 END AS INT) AS channels, CASE WHEN s_suppkey%2=0 THEN 0.5e0 ELSE 0.485e0 END AS mean, CASE WHEN s_suppkey%2=0 THEN 0.5e0 ELSE 0.225e0 END AS std, CAST(CASE WHEN s_suppkey%3=0 THEN 128 ELSE 224 END AS INT) AS side FROM supplier WHERE s_suppkey%13<>0")
def model_metadata(spark, d):
    """Models described in JSON of several ages: their settings, by name where they don't state them; first mean and last deviation of the channels."""
    k = F.col("s_suppkey")
    names = F.transform(F.sequence(F.lit(0), (F.col("s_nationkey") % 3).cast("int")), lambda i: F.concat(F.lit("class"), i.cast("string")))
    stated = F.struct(names.alias("class_names"), F.when(k % 3 == 0, 0.75).alias("confidence_threshold"), F.when(k % 3 == 0, 2).alias("in_chans"), F.when(k % 3 == 0, 128).alias("img_size"))
    lines = table(spark, d, "supplier").select(F.concat(F.when(k % 2 == 0, "das_cnn_").otherwise("net_"), k.cast("string")).alias("name"), F.when(k % 13 == 0, "{}").otherwise(F.to_json(stated)).alias("meta"))
    path = folder(spark, "models")
    lines.write.json(path)
    got = parse_models(spark.read.schema("name string, meta string").json(path))
    return got.select("name", "classes", "threshold", "channels", F.element_at("mean", 1).alias("mean"), F.element_at("std", -1).alias("std"), "side")


@query("csv_metadata", "SELECT concat('ev', event_id, '$', user_id) AS trace_name, CASE WHEN event_type='error' THEN 'noise' ELSE 'earthquake_local' END AS category, CASE WHEN event_id%9<>0 THEN floor(value*1e2+0.5e0)/1e2 END AS magnitude, props AS note FROM events")
def csv_metadata(spark, d):
    """Metadata of traces written as CSV with a header, quotes and separators within values included, and read back by a stated schema; numbers that aren't are null."""
    size = F.floor(F.col("value") * 1e2 + 0.5) / 1e2
    rows = table(spark, d, "events").select(F.concat(F.lit("ev"), F.col("event_id").cast("string"), F.lit("$"), F.col("user_id").cast("string")).alias("trace_name"), F.when(F.col("event_type") == "error", "noise").otherwise("earthquake_local").alias("category"), F.when(F.col("event_id") % 9 == 0, "None").otherwise(size.cast("string")).alias("magnitude"), F.col("props").alias("note"))
    path = folder(spark, "metadata")
    rows.write.option("header", True).option("escape", '"').csv(path)
    got = spark.read.schema("trace_name string, category string, magnitude string, note string").option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    return got.withColumn("magnitude", F.col("magnitude").try_cast("double"))


@query("report_lines", sql("samples", body=f"""{CENTROIDS}, {PREDICTED}, h AS (SELECT label AS cls, count(*) AS support, sum(CASE WHEN label=pred THEN 1 ELSE 0 END) AS hits FROM p GROUP BY 1), g AS (SELECT pred AS cls, count(*) AS predicted FROM p GROUP BY 1),
x AS (SELECT h.cls, support, coalesce(CAST(hits AS DOUBLE)/predicted, 0.0e0) AS pr, CAST(hits AS DOUBLE)/support AS re FROM h LEFT JOIN g USING (cls))
SELECT printf('%12s %9.3f %9.3f %9.3f %9d', 'class'||cls, floor(pr*1e3+0.5e0)/1e3, floor(re*1e3+0.5e0)/1e3, floor((CASE WHEN pr+re=0 THEN 0.0e0 ELSE 2*pr*re/(pr+re) END)*1e3+0.5e0)/1e3, support) AS line FROM x"""))
def report_lines(spark, d):
    """The classification report as lines of text, three digits, written to files and read back."""
    path = folder(spark, "report")
    name = F.concat(F.lit("class"), F.col("class").cast("string"))
    report(predicted(spark, d)).select(F.format_string("%12s %9.3f %9.3f %9.3f %9d", name, "precision", "recall", "f1", "support").alias("line")).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")

"""Classification by nearest centroid, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import with_number
from ..registry import query
from ..tables import class_log, r4, sql, table, traces


def centroids(df: DataFrame) -> DataFrame:
    """label and centroid (an array) of each class: sums by place are partial aggregates. There are few classes."""
    long = df.select(F.col("frame_key").alias("label"), F.posexplode("samples").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def distances(df: DataFrame) -> DataFrame:
    """Adds d: an array of (distance, class) to each class's centroid, in order of class. The centroids are the fitted model: a few rows, which go into the plan."""
    fitted = sorted(centroids(df).collect())
    model = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(list(centroid)).alias("centroid")) for label, centroid in fitted)) if fitted else F.array().cast("array<struct<label:int,centroid:array<double>>>")
    far = lambda c: F.sqrt(F.aggregate(F.zip_with("samples", c["centroid"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v))
    return df.select("trace_id", F.col("frame_key").alias("label"), F.transform(model, lambda c: F.struct(far(c).alias("dist"), c["label"].alias("class"))).alias("d"))


def scored(spark, d) -> DataFrame:
    return distances(traces(spark, d))


def predicted(spark, d) -> DataFrame:
    return scored(spark, d).select("trace_id", "label", F.array_min("d")["class"].alias("pred"))


_C = "c AS (SELECT frame_key AS cls, i, avg(x) AS m FROM samples GROUP BY ALL), dist AS (SELECT trace_id, frame_key AS label, cls, sqrt(sum((x-m)*(x-m))) AS dist FROM samples JOIN c USING (i) GROUP BY ALL)"
_P = "p AS (SELECT trace_id, label, cls AS pred FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dist, cls) AS r FROM dist) WHERE r=1)"


@query("argmax_class", sql("samples", body=f"{_C}, {_P} SELECT trace_id, label, pred FROM p"))
def argmax_class(spark, d):
    """The class of the nearest centroid."""
    return predicted(spark, d)


@query("softmax_confidence", sql("samples", body=f"{_C}, e AS (SELECT trace_id, cls, exp(-dist) AS e FROM dist) SELECT trace_id, CAST(arg_max(cls, e) AS INT) AS pred, floor(max(e)/sum(e)*1e4+0.5e0)/1e4 AS confidence FROM e GROUP BY 1"))
def softmax_confidence(spark, d):
    """The nearest class and its share of all classes' softmax."""
    e = F.transform("d", lambda x: F.exp(-x["dist"]))
    return scored(spark, d).select("trace_id", F.array_min("d")["class"].alias("pred"), r4(F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)).alias("confidence"))


@query("batch_classify", sql("samples", body=f"{_C}, {_P} SELECT CAST(c_custkey AS BIGINT) AS id, pred IS NULL AS missing, pred FROM customer LEFT JOIN p ON trace_id=c_custkey"))
def batch_classify(spark, d):
    """Classes of the traces asked for; missing ones are reported."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    p = predicted(spark, d).select(F.col("trace_id").alias("id"), "pred")
    return asked.join(p, "id", "left").select("id", F.col("pred").isNull().alias("missing"), "pred")


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "pred").agg(F.count("*").alias("n"))


def report(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each class of (label, pred), three digits; classes never predicted have zeros."""
    c = confusion(df)
    by_label = c.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    by_pred = c.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    r3 = lambda x: F.floor(x * 1e3 + 0.5) / 1e3
    both = by_label.join(by_pred, "class", "left").withColumn("p", F.coalesce(F.col("hits") / F.col("predicted"), F.lit(0.0))).withColumn("r", F.col("hits") / F.col("support"))
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return both.select("class", r3(F.col("p")).alias("precision"), r3(F.col("r")).alias("recall"), r3(f1).alias("f1"), "support")


@query("classification_report", sql("samples", body=f"""{_C}, {_P}, h AS (SELECT label AS cls, count(*) AS support, sum(CASE WHEN label=pred THEN 1 ELSE 0 END) AS hits FROM p GROUP BY 1), g AS (SELECT pred AS cls, count(*) AS predicted FROM p GROUP BY 1),
x AS (SELECT h.cls, support, coalesce(CAST(hits AS DOUBLE)/predicted, 0.0e0) AS pr, CAST(hits AS DOUBLE)/support AS re FROM h LEFT JOIN g USING (cls))
SELECT cls AS class, floor(pr*1e3+0.5e0)/1e3 AS precision, floor(re*1e3+0.5e0)/1e3 AS recall, floor((CASE WHEN pr+re=0 THEN 0.0e0 ELSE 2*pr*re/(pr+re) END)*1e3+0.5e0)/1e3 AS f1, CAST(support AS BIGINT) AS support FROM x"""))
def classification_report(spark, d):
    return report(predicted(spark, d))


@query("confusion_normalized", sql("samples", body=f"{_C}, {_P}, n AS (SELECT label, pred, count(*) AS n FROM p GROUP BY ALL) SELECT label, pred, floor(n/sum(n) OVER (PARTITION BY label)*1e4+0.5e0)/1e4 AS share FROM n"))
def confusion_normalized(spark, d):
    """Confusion matrix with rows that sum to one; it has a row for each pair of classes at most."""
    c = confusion(predicted(spark, d))
    return c.select("label", "pred", r4(F.col("n") / F.sum("n").over(Window.partitionBy("label"))).alias("share"))


_EPOCH = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, event_id, value/(value+50.0e0) AS acc FROM events)"


def epochs(spark, d) -> DataFrame:
    """Users as runs, their events in order as epochs, a scaled value as accuracy."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / (F.col("value") + 50.0)).alias("acc"))
    return with_number(e, "user_id", "event_id", "epoch")


@query("epoch_metrics", f"WITH {_EPOCH} SELECT CAST(epoch AS BIGINT) AS epoch, floor(sum(acc*(event_id%5+1))/sum(event_id%5+1)*1e4+0.5e0)/1e4 AS accuracy, CAST(sum(event_id%5+1) AS BIGINT) AS n FROM e GROUP BY 1")
def epoch_metrics(spark, d):
    """Mean accuracy of each epoch, weighted by batch sizes."""
    n = F.col("event_id") % 5 + 1
    return epochs(spark, d).groupBy("epoch").agg(r4(F.sum(F.col("acc") * n) / F.sum(n)).alias("accuracy"), F.sum(n).cast("long").alias("n"))


@query("best_epoch", f"WITH {_EPOCH}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY acc DESC, epoch) AS r FROM e) SELECT user_id, CAST(epoch AS BIGINT) AS epoch, floor(acc*1e4+0.5e0)/1e4 AS accuracy FROM r WHERE r=1")
def best_epoch(spark, d):
    """The first epoch of each run with its best accuracy."""
    best = epochs(spark, d).groupBy("user_id").agg(F.max_by(F.struct("epoch", "acc"), F.struct("acc", -F.col("epoch"))).alias("b"))
    return best.select("user_id", "b.epoch", r4(F.col("b.acc")).alias("accuracy"))


_RUNS = "r AS (SELECT user_id, concat('run_', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS name, max(value/(value+50.0e0)) AS acc, count(*) AS epochs, min(ts) AS started FROM events GROUP BY 1)"


def runs(spark, d) -> DataFrame:
    v = F.col("value")
    g = table(spark, d, "events").groupBy("user_id").agg(F.max(v / (v + 50.0)).alias("acc"), F.count("*").alias("epochs"), F.min("ts").alias("started"))
    return g.withColumn("name", F.concat(F.lit("run_"), F.lpad(F.col("user_id").cast("string"), 6, "0")))


@query("run_history", f"WITH {_RUNS} SELECT name, floor(acc*1e4+0.5e0)/1e4 AS accuracy, CAST(epochs AS BIGINT) AS epochs, coalesce(CAST(toxic AS INT), -1) AS report FROM r LEFT JOIN labels ON doc_id=user_id")
def run_history(spark, d):
    """Runs with a sidecar's value, where there is one, newest name first."""
    side = table(spark, d, "labels").select(F.col("doc_id").alias("user_id"), F.col("toxic").cast("int").alias("t"))
    return runs(spark, d).join(side, "user_id", "left").select("name", r4(F.col("acc")).alias("accuracy"), "epochs", F.coalesce("t", F.lit(-1)).alias("report")).orderBy(F.desc("name"))


@query("best_run", f"WITH {_RUNS} SELECT name, floor(acc*1e4+0.5e0)/1e4 AS accuracy FROM r ORDER BY acc DESC, name DESC LIMIT 1")
def best_run(spark, d):
    return runs(spark, d).orderBy(F.desc("acc"), F.desc("name")).limit(1).select("name", r4(F.col("acc")).alias("accuracy"))


@query("latest_run", f"WITH {_RUNS} SELECT name FROM r ORDER BY started DESC, name DESC LIMIT 1")
def latest_run(spark, d):
    return runs(spark, d).agg(F.max_by("name", F.struct("started", "name")).alias("name"))


@query("energy_summary", "SELECT user_id AS device, floor(avg(value)*1e2+0.5e0)/1e2 AS watts, floor(avg(value)*(epoch(max(ts))-epoch(min(ts)))/3600.0e0*1e2+0.5e0)/1e2 AS watt_hours, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def energy_summary(spark, d):
    """Mean power of each device, its energy over the time it was read, and how often that was."""
    hours = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6 / 3600.0
    r2 = lambda x: F.floor(x * 1e2 + 0.5) / 1e2
    return table(spark, d, "events").groupBy(F.col("user_id").alias("device")).agg(r2(F.avg("value")).alias("watts"), r2(F.avg("value") * hours).alias("watt_hours"), F.count("*").alias("n"))


@query("latest_reading", "SELECT user_id AS device, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1")
def latest_reading(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("device")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("ml_train_eval")
def ml_train_eval(spark, d):
    """A multinomial logistic regression on traces, trained on one part of a fixed split and evaluated on the other."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from .labels import hashed

    data = traces(spark, d).select("trace_id", F.col("frame_key").cast("double").alias("label"), array_to_vector(F.col("samples").cast("array<double>")).alias("features"), (hashed(F.col("trace_id")) % 10 < 8).alias("train"))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(data.where("train"))
    p = model.transform(data.where("not train"))
    return report(p.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred")))

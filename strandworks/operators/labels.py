"""Labelled sets: mapping of categories, union of sources, splits, weights, and joins with a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..tables import class_log, sql, table

CLASSES = ("clean", "noise", "mixed")


def hashed(key: Column) -> Column:
    """A spread-out number below 2^32 of an integer key, the same in any engine: (key * 2654435761) mod 2^32 by halves, so that no product passes 63 bits."""
    low32 = F.pmod(key.cast("long"), F.lit(1 << 32))
    high, low = F.shiftright(low32, 16), low32.bitwiseAND(0xFFFF)
    return ((high * 2654435761 % 65536) * 65536 + low * 2654435761) % 4294967296


def source_class(source: Column) -> Column:
    """The class of a source by its number; null for numbers from 15 on, which belong to no class."""
    n = F.regexp_extract(source, r"(\d+)", 1).cast("int")
    return F.when(n < 5, "clean").when(n < 10, "noise").when(n < 15, "mixed")


_CLS = "CASE WHEN n<5 THEN 'clean' WHEN n<10 THEN 'noise' WHEN n<15 THEN 'mixed' END"
_MAPPED = f"m AS (SELECT doc_id, source, {_CLS} AS class FROM (SELECT doc_id, source, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS n FROM documents))"


def mapped(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", source_class(F.col("source")).alias("class"))


@query("category_map_join", f"WITH {_MAPPED} SELECT coalesce(class, '(dropped)') AS class, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1")
def category_map_join(spark, d):
    """Documents of each class of source, and how many belong to none."""
    return mapped(spark, d).groupBy(F.coalesce("class", F.lit("(dropped)")).alias("class")).agg(F.count("*").alias("n"))


@query("combined_dataset", f"WITH {_MAPPED}, u AS (SELECT doc_id AS id, 'documents' AS origin, class FROM m WHERE class IS NOT NULL UNION ALL SELECT doc_id, 'labels', CASE WHEN toxic=1 THEN 'noise' ELSE 'clean' END FROM labels) SELECT id, origin, class, concat(origin, '_', class, '_', CAST(id AS VARCHAR)) AS name FROM u")
def combined_dataset(spark, d):
    """Two labelled sources as one, under names that can't clash."""
    a = mapped(spark, d).where("class is not null").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "class")
    b = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("labels").alias("origin"), F.when(F.col("toxic") == 1, "noise").otherwise("clean").alias("class"))
    return a.unionByName(b).withColumn("name", F.concat_ws("_", "origin", "class", F.col("id").cast("string")))


@query("label_index", "SELECT DISTINCT source AS class, CAST(dense_rank() OVER (ORDER BY source)-1 AS INT) AS label FROM documents")
def label_index(spark, d):
    """Class names in order, numbered from 0: those in ranges of names are numbered in each range, and moved by what is before it, from a table with a row a range."""
    classes = table(spark, d, "documents").select(F.col("source").alias("class")).distinct()
    cut = classes.withColumn("range", F.substring("class", 1, 2))
    within = F.row_number().over(Window.partitionBy("range").orderBy("class"))
    before = cut.groupBy("range").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return cut.join(before.withColumnRenamed("range", "r"), F.col("range").eqNullSafe(F.col("r"))).select("class", (within + F.col("before") - 1).cast("int").alias("label"))


@query("class_counts", f"WITH {_MAPPED} SELECT c.class, CAST(count(doc_id) AS BIGINT) AS n, count(doc_id)=0 AS missing FROM (VALUES ('clean'),('noise'),('mixed'),('other')) c(class) LEFT JOIN m USING (class) GROUP BY 1")
def class_counts(spark, d):
    """Documents of each class asked for, with those that have none."""
    counts = mapped(spark, d).groupBy("class").agg(F.count("*").alias("n"))
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, [*CLASSES, "other"]))).alias("class"))
    return asked.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("class_total", f"WITH {_MAPPED} SELECT coalesce(class, 'total') AS class, CAST(count(*) AS BIGINT) AS n FROM m WHERE class IS NOT NULL GROUP BY ROLLUP(class)")
def class_total(spark, d):
    return mapped(spark, d).where("class is not null").rollup("class").agg(F.count("*").alias("n")).select(F.coalesce("class", F.lit("total")).alias("class"), "n")


@query("class_weights", f"WITH {_MAPPED} SELECT doc_id, floor(1.0e0/count(*) OVER (PARTITION BY class)*1e6+0.5e0)/1e6 AS weight FROM m WHERE class IS NOT NULL")
def class_weights(spark, d):
    """Weights that make classes count the same; counts come by a join, so a large class isn't one task's window."""
    m = mapped(spark, d).where("class is not null")
    counts = m.groupBy("class").agg(F.count("*").alias("n"))
    return m.join(F.broadcast(counts), "class").select("doc_id", (F.floor(1.0 / F.col("n") * 1e6 + 0.5) / 1e6).alias("weight"))


@query("stratified_split", f"WITH {_MAPPED}, r AS (SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY (doc_id*2654435761)%4294967296, doc_id) AS r, count(*) OVER (PARTITION BY class) AS n FROM m WHERE class IS NOT NULL) SELECT doc_id, class, CASE WHEN r<=floor(n*0.8e0) THEN 'train' WHEN r<=floor(n*0.9e0) THEN 'validation' ELSE 'test' END AS split FROM r")
def stratified_split(spark, d):
    """80/10/10 of each class by a fixed shuffle. Ranks come from histograms of the hash: rows of a class are cut into buckets, ranked within, and moved by what is before."""
    m = mapped(spark, d).where("class is not null").withColumn("h", hashed(F.col("doc_id"))).withColumn("bucket", F.floor(F.col("h") / (1 << 24)).cast("int"))
    counts = m.groupBy("class", "bucket").agg(F.count("*").alias("k"))
    by = Window.partitionBy("class")  # at most 256 buckets a class
    before = counts.select("class", "bucket", F.coalesce(F.sum("k").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(by).alias("n"))
    r = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("h", "doc_id")) + F.col("before")
    return m.join(before, ["class", "bucket"]).select("doc_id", "class", F.when(r <= F.floor(F.col("n") * 0.8), "train").when(r <= F.floor(F.col("n") * 0.9), "validation").otherwise("test").alias("split"))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY (doc_id*2654435761)%4294967296, doc_id LIMIT 50")
def seeded_sample(spark, d):
    """50 documents without replacement, by a fixed shuffle."""
    return table(spark, d, "documents").select("doc_id").orderBy(hashed(F.col("doc_id")), "doc_id").limit(50)


@query("first_per_category", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r<=2")
def first_per_category(spark, d):
    """The first two documents of each source, by stretches of ids: the first two of a source in each stretch, then of those the first two, so a large source isn't sorted in one task and the table is read once."""
    docs = table(spark, d, "documents").select("source", "doc_id")
    first_two = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))).where("r <= 2").drop("r")
    return first_two(first_two(docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))), "source", "part"), "source").drop("part")


@query("insert_if_absent", "SELECT doc_id, source, 'old' AS state FROM documents WHERE doc_id%3<>0 UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE doc_id%3=0")
def insert_if_absent(spark, d):
    """Rows of a new delivery that aren't there yet, added to those that are."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    there = docs.where("doc_id % 3 <> 0")
    fresh = docs.join(there.select("doc_id"), "doc_id", "left_anti")
    return there.withColumn("state", F.lit("old")).unionByName(fresh.withColumn("state", F.lit("new")))


@query("new_files", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def new_files(spark, d):
    """Documents that labels haven't seen."""
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


def last_of(log: DataFrame) -> DataFrame:
    """The last record of each file name."""
    return log.groupBy("filename").agg(F.max_by(F.struct("log_id", "predicted_class", "confidence"), "log_id").alias("r")).select("filename", "r.*")


_LAST = "l AS (SELECT filename, log_id, predicted_class, confidence FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY log_id DESC) AS r FROM class_log) WHERE r=1)"


@query("log_last_wins", sql("class_log", body=_LAST + " SELECT filename, log_id, predicted_class, confidence FROM l"))
def log_last_wins(spark, d):
    return last_of(class_log(spark, d))


@query("log_lookup_left", sql("class_log", body=_LAST + " SELECT CAST(c_custkey AS BIGINT) AS c_custkey, coalesce(predicted_class, 'unknown') AS predicted_class FROM customer LEFT JOIN l ON filename=concat('sig_', CAST(c_custkey AS VARCHAR), '.png')"))
def log_lookup_left(spark, d):
    """The last class of each customer's file; unknown where there is none."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.concat(F.lit("sig_"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("filename"))
    return c.join(last_of(class_log(spark, d)), "filename", "left").select("c_custkey", F.coalesce("predicted_class", F.lit("unknown")).alias("predicted_class"))


@query("label_remap", sql("class_log", body="SELECT log_id, CASE predicted_class WHEN 'click' THEN 'event' WHEN 'view' THEN 'noise' ELSE predicted_class END AS class FROM class_log"))
def label_remap(spark, d):
    """Classes under another model's names; those without one keep theirs."""
    names = spark.range(1).select(F.explode(F.create_map(F.lit("click"), F.lit("event"), F.lit("view"), F.lit("noise"))).alias("predicted_class", "new"))
    return class_log(spark, d).join(F.broadcast(names), "predicted_class", "left").select("log_id", F.coalesce("new", "predicted_class").alias("class"))


@query("classification_log", sql("class_log", body="SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, filename, concat('pending/', predicted_class, '/', filename) AS source_path, predicted_class, confidence, confidence<0.6e0 AS uncertain FROM class_log"))
def classification_log(spark, d):
    """The log's rows as they are appended."""
    return class_log(spark, d).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "filename", F.concat_ws("/", F.lit("pending"), "predicted_class", "filename").alias("source_path"), "predicted_class", "confidence", (F.col("confidence") < 0.6).alias("uncertain"))


_DECIDE = "CASE WHEN log_id%11=0 THEN 'reject' WHEN log_id%5=0 THEN 'correct' WHEN log_id%3=0 THEN 'skip' ELSE 'confirm' END"


def reviewed(spark, d) -> DataFrame:
    n = F.col("log_id")
    log = class_log(spark, d).withColumn("decision", F.when(n % 11 == 0, "reject").when(n % 5 == 0, "correct").when(n % 3 == 0, "skip").otherwise("confirm"))
    state = F.when(F.col("decision").isin("confirm", "correct"), "verified").when(F.col("decision") == "reject", "rejected").otherwise("pending")
    return log.select("log_id", "decision", state.alias("state"), F.when(F.col("decision") == "correct", "other").otherwise(F.col("predicted_class")).alias("class"))


@query("review_apply", sql("class_log", body=f"r AS (SELECT log_id, predicted_class, {_DECIDE} AS decision FROM class_log) SELECT log_id, decision, CASE WHEN decision IN ('confirm','correct') THEN 'verified' WHEN decision='reject' THEN 'rejected' ELSE 'pending' END AS state, CASE WHEN decision='correct' THEN 'other' ELSE predicted_class END AS class FROM r"))
def review_apply(spark, d):
    """Where each record goes by its reviewer's decision, and under which class."""
    return reviewed(spark, d)


@query("review_summary", sql("class_log", body=f"SELECT {_DECIDE} AS decision, CAST(count(*) AS BIGINT) AS n FROM class_log GROUP BY 1"))
def review_summary(spark, d):
    return reviewed(spark, d).groupBy("decision").agg(F.count("*").alias("n"))

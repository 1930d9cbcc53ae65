"""Shared helpers: input tables, the shared work folder, shipping code to Python workers, native let-binding."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators between words, everywhere in this subpackage: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: Rows and bytes that a Python worker works on at once: texts may be long.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20
_folders: WeakKeyDictionary = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where they share the driver's disk. A cluster gets it by ``--py-files`` as usual; the extra path does no harm there."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def short(batches, rows: int = BATCH_ROWS, most: int = BATCH_BYTES):
    """Arrow batches cut into slices (no copies) of at most so many rows, and so many bytes unless a row alone has more."""
    for batch in batches:
        n = batch.num_rows
        if n <= rows and batch.nbytes <= most:
            yield batch
            continue
        a = 0
        while a < n:
            k = min(rows, n - a)
            while k > 1 and batch.slice(a, k).nbytes > most:
                k = (k + 1) // 2
            yield batch.slice(a, k)
            a += k


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, in full. In local mode one of our own where that is unset; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = Path(tempfile.mkdtemp(prefix="strandworks-")).as_uri()
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; nothing is ever written to it twice."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_folders.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """pyarrow's file system for a URI of the shared folder, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def sampled(key: Column, share) -> Column:
    """Whether a row belongs to a sample of the given share (a number or a Column), by 62 bits of a hash of its key: no table is so large that the share becomes none."""
    bound = F.lit(sample_bound(share)) if isinstance(share, float) else share
    return F.shiftrightunsigned(key, 2) < bound


def sample_bound(share: float) -> int:
    return max(1, int(min(1.0, share) * (1 << 62)))


def with_salt(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, spread: Column) -> tuple[DataFrame, DataFrame]:
    """rows and groups (distinct keys and how many rows have them) with a column salt for a join by keys and salt, in which no task gets a group of more than a thousandth of all rows.

    Only groups of more rows than that are dealt out, into parts by their measured count. There are fewer than 1000 of them whatever the tables hold, so they are broadcast.
    """
    share = max(1, total // 1000)
    hot = groups.where(F.col(count) > share).select(*keys, F.ceil(F.col(count) / F.lit(share)).cast("int").alias("salts"))
    rows = rows.join(F.broadcast(hot), keys, "left")
    rows = rows.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(spread, F.col("salts"))).otherwise(0).cast("int")).drop("salts")
    salts = F.when(F.col(count) > share, F.ceil(F.col(count) / F.lit(share)).cast("int") - 1).otherwise(0)
    return rows, groups.withColumn("salt", F.explode(F.sequence(F.lit(0), salts)))


def let(value: Column, body) -> Column:
    """body(value) with value computed once however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The array of words of a text (null or no word: empty)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the decimal id; a null id counts as the text 'null'."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("null")), "UTF-8"))


def id_bounds(df: DataFrame, key: str, parts: int) -> list:
    """Values of an integer key that cut its distinct values into about so many even stretches; the last is the largest.

    Reads the key alone. parts follows the number of partitions, so the list stays small whatever the rows.
    """
    grid = [i / parts for i in range(1, parts + 1)]
    got = df.select(F.percentile_approx(key, F.array(*map(F.lit, grid)), 100 * parts), F.max(key)).first()
    return sorted({*(got[0] or []), got[1]} - {None})


def stretch_of(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds lie below key, by binary search; 0 for a null key."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    values = F.array(*map(F.lit, bounds))

    def step(at: Column, width: Column) -> Column:
        below = (at + width <= len(bounds)) & (F.try_element_at(values, at + width) < key)
        return F.when(below, at + width).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)

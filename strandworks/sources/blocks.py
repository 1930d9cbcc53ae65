"""Waveforms in files with a block index, for lookups of single keys: only the blocks that hold a wanted key are read.

A file has records in order of their keys, in blocks. At its end stand the blocks' first keys and places, a Bloom filter of all keys, and a trailer. The list of files has each one's range of keys; ranges don't overlap.
A lookup sends each wanted key to the file whose range has it, asks the filter, and reads the key's block once for all keys in it.
"""

from __future__ import annotations

import bisect
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import stretch
from ..functions.scalar import row_of_key
from ..operators.lapped import worker_path
from ..registry import query
from ..streaming.streams import folder
from ..tables import sql, table, traces
from .segy import opened

#: Records of a block, bits of the filter for each key, and hash functions.
BLOCK, BITS, HASHES = 64, 10, 7
COOKIE = 0x424C4B31
_RECORD = np.dtype([("key", "<i8"), ("n", "<i4")])
LISTED = "uri string, first long, last long, records long"


def bloom_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key (keys x HASHES), by two mixes of it."""
    x = keys.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        a = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        b = ((x ^ (x >> np.uint64(29))) * np.uint64(0x81DADEF4BC2DD44D)) | np.uint64(1)
        a, b = a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(31)) | np.uint64(1)
        return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def write_file(uri: str, records, block: int = BLOCK) -> tuple[int, int, int]:
    """Writes records (key, values) that come in order of distinct keys; returns first and last key and how many there are."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    firsts, places, keys, at = [], [], [], 0
    with fs.open_output_stream(path) as out:
        for k, (key, values) in enumerate(records):
            if keys and key <= keys[-1]:
                raise ValueError(f"key {key} comes after {keys[-1]}")
            if k % block == 0:
                firsts.append(key)
                places.append(at)
            raw = np.array([(key, len(values))], _RECORD).tobytes() + np.asarray(values, "<f4").tobytes()
            out.write(raw)
            at += len(raw)
            keys.append(key)
        bits = max(64, BITS * len(keys))
        marked = np.zeros(bits, bool)
        marked[bloom_bits(np.array(keys, np.int64), bits).ravel()] = True
        out.write(np.array([firsts, [*places]], "<i8").tobytes() + np.packbits(marked).tobytes() + struct.pack("<qqqq", at, len(firsts), bits, COOKIE))
    return keys[0], keys[-1], len(keys)


def found_in(uri: str, wanted: list[int]) -> tuple[dict[int, np.ndarray], int]:
    """The values of the wanted keys that a file has, and how many of its bytes were read. Raises ValueError for a file without the trailer."""
    fs, path = opened(uri)
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        if size < 32:
            raise ValueError(f"{uri} is cut short")
        at, n, bits, cookie = struct.unpack("<qqqq", f.read_at(32, size - 32))
        if cookie != COOKIE or at + 16 * n + (bits + 7) // 8 + 32 != size:
            raise ValueError(f"{uri} has no block index")
        index = f.read_at(size - 32 - at, at)
        firsts, places = (x.tolist() for x in np.frombuffer(index, "<i8", 2 * n).reshape(2, n))
        marked = np.unpackbits(np.frombuffer(index, np.uint8, offset=16 * n))
        read, out, blocks = 32 + len(index), {}, {}
        for key, maybe in zip(wanted, marked[bloom_bits(np.array(wanted, np.int64), bits)].all(1).tolist()):
            if maybe and (k := bisect.bisect_right(firsts, key) - 1) >= 0:
                blocks.setdefault(k, set()).add(key)
        for k, keys in sorted(blocks.items()):
            raw = f.read_at((places[k + 1] if k + 1 < n else at) - places[k], places[k])
            read += len(raw)
            place = 0
            while place < len(raw):  # a block's records
                key, count = struct.unpack_from("<qi", raw, place)
                if key in keys:
                    out[key] = np.frombuffer(raw, "<f4", count, place + 12)
                place += 12 + 4 * count
    return out, read


def write_blocks(df: DataFrame, key: str, values: str, path: str, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """Writes key and values (array of floats) to files by ranges of keys; returns their list (LISTED), which is a table in the shared folder. Of rows that share a key the greatest counts; null keys and values are left out."""
    spark = df.sparkSession
    worker_path(spark)
    one = df.where(F.col(key).isNotNull() & F.col(values).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.col(values).cast("array<float>")).alias("values"))

    def write(batches):
        import pyarrow as pa

        rows = ((k, v) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        first = next(rows, None)
        if first is not None:
            uri = f"{path}/{uuid.uuid4().hex}.blk"

            def each():
                yield first
                yield from rows

            got = write_file(uri, each(), block)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((uri, *got), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], [c.split()[0] for c in LISTED.split(", ")])

    listed = one.repartitionByRange(*([parts] if parts else []), "key").sortWithinPartitions("key").mapInArrow(write, LISTED)
    kept = folder(spark, "block-files")
    listed.write.parquet(kept)
    return spark.read.schema(LISTED).parquet(kept)


def look_up(wanted: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """key, values (null: missing) and bytes_read (told once for each file that was opened) of each distinct key that is wanted, but null ones.

    The list of files is a row a file of many records, so it goes to the driver; keys are dealt to files by it, and a file is one task's work. Keys outside all ranges open no file.
    """
    spark = wanted.sparkSession
    worker_path(spark)
    files = sorted((r["first"], r["last"], r["uri"]) for r in listed.collect())
    keys = wanted.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    n = stretch(F.col("key"), [f[1] for f in files])  # the first file whose last key isn't below
    names = spark.createDataFrame([(k, first, uri) for k, (first, _, uri) in enumerate(files)], "file int, first long, uri string")
    dealt = keys.withColumn("file", n.cast("int")).join(F.broadcast(names), "file", "left")
    there = F.col("uri").isNotNull() & (F.col("key") >= F.col("first"))

    def run(batches):
        import pyarrow as pa

        def asked(uri, some):
            got, read = found_in(uri, some)
            values = [got.get(k) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([None if v is None else v.tolist() for v in values], pa.list_(pa.float32())), pa.array([read] + [0] * (len(some) - 1), pa.int64())], ["key", "values", "bytes_read"])

        now, some = None, []
        for batch in batches:
            for uri, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if uri != now or len(some) == 65_536:
                    if some:
                        yield asked(now, some)
                    now, some = uri, []
                some.append(k)
        if some:
            yield asked(now, some)

    schema = "key long, values array<float>, bytes_read long"
    read = dealt.where(there).select("uri", "key").repartition("uri").sortWithinPartitions("uri", "key").mapInArrow(run, schema)
    return read.unionByName(dealt.where(~F.coalesce(there, F.lit(False))).select("key", F.lit(None).cast("array<float>").alias("values"), F.lit(0).cast("long").alias("bytes_read")))


@query("waveform_blocks", sql("traces", body="SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, trace_id IS NULL AS missing, frame_no, floor(CAST(samples[1] AS DOUBLE)*1e4+0.5e0)/1e4 + 0.0e0 AS first_sample FROM orders LEFT JOIN traces ON trace_id=o_custkey"))
def waveform_blocks(spark, d):
    """Orders with the waveform of the key bucket$row that their customer's number makes, parsed and looked up in files with a block index; missing ones are kept and marked."""
    listed = write_blocks(traces(spark, d), "trace_id", "samples", folder(spark, "waveforms"))
    named = F.concat(F.lit("bucket"), (F.col("o_custkey") % 7).cast("string"), F.lit("$"), F.col("o_custkey").cast("string"), F.lit(",:3,:6000"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), row_of_key(named).alias("key"))
    got = look_up(o, "key", listed)
    first = F.element_at("values", 1).cast("double")
    return o.join(got, "key", "left").select("o_orderkey", F.col("values").isNull().alias("missing"), F.when(F.col("values").isNotNull(), F.floor(F.col("key") / 32).cast("int")).alias("frame_no"), (F.floor(first * 1e4 + 0.5) / 1e4 + F.lit(0.0)).alias("first_sample"))

"""Files of compressed frames that are read by ranges: a Spark data source named syz, written and read by many tasks.

A file has frames of one volume: a cookie and the number of table bytes (4 bytes each), a text header of 3200 and a binary header of 400 bytes as trace files have, the tables of the codes, then frame after
frame: lengths of headers and traces (4 bytes each), headers, traces. At its end stand an index (number, place and sizes of each frame) and a trailer that says where the index begins.

Each write leaves a list of its files; only listed files count, so what lost attempts leave behind is never read. Filters on volume and frame_no are pushed down: by the lists to files, and by each file's
index to frames, whose bytes alone are read then.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators.lapped import worker_path
from ..plans import frames
from ..registry import query
from ..streaming.streams import folder
from ..tables import N1, N2, r4, traces
from .segy import BINARY, TEXT, file_header, opened, parse_header

#: The fixed first word of a file, and the last one of our own trailer.
COOKIE, END_COOKIE = 35478349, 35478350
_WORDS, _TRAILER = struct.Struct(">ii"), struct.Struct(">qqi")
_ENTRY = np.dtype([("frame_no", ">i8"), ("at", ">i8"), ("traces", ">i4"), ("samples", ">i4"), ("header_bytes", ">i4"), ("trace_bytes", ">i4")])
#: A file of a volume is ended once it has so many bytes.
MOST_BYTES = 1 << 30
BOUNDED = ("volume", "frame_no")


def enable(spark: SparkSession) -> None:
    """Registers the source with a session; filters reach Python sources only where the session allows it, so that is set too."""
    worker_path(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SyzSource)


def _allows(name: str, value, kind: type, wanted) -> bool:
    """Whether a whole number passes a filter (kind and wanted)."""
    if wanted is None:
        return False
    if kind is In:
        return value in wanted
    return {EqualTo: value == wanted, EqualNullSafe: value == wanted, GreaterThan: value > wanted, GreaterThanOrEqual: value >= wanted, LessThan: value < wanted, LessThanOrEqual: value <= wanted}[kind]


@dataclass
class SyzFile(InputPartition):
    uri: str
    volume: int


@dataclass
class SyzWritten(WriterCommitMessage):
    files: list


class SyzReader(DataSourceReader):
    def __init__(self, path: str, grids: bool):
        self.path, self.grids, self.filters = path, grids, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in BOUNDED or type(f) not in (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNotNull):
                yield f
            elif type(f) is not IsNotNull:  # neither column is ever null
                self.filters.append((name, type(f), f.value))

    def _passes(self, name: str, value: int) -> bool:
        return all(_allows(name, value, kind, wanted) for n, kind, wanted in self.filters if n == name)

    def partitions(self):
        """A file each; those of other volumes, and those whose first and last frames rule them out, aren't opened."""

        def may(f):
            low, high = f["first"], f["last"]
            tests = {EqualTo: lambda w: low <= w <= high, EqualNullSafe: lambda w: low <= w <= high, GreaterThan: lambda w: high > w, GreaterThanOrEqual: lambda w: high >= w, LessThan: lambda w: low < w, LessThanOrEqual: lambda w: low <= w, In: lambda w: any(v is not None and low <= v <= high for v in w)}
            return self._passes("volume", f["volume"]) and all(w is not None and tests[kind](w) for n, kind, w in self.filters if n == "frame_no")

        return [SyzFile(f"{self.path}/{f['name']}", f["volume"]) for f in listed(self.path) if may(f)]

    def read(self, partition):
        import pyarrow as pa

        if not isinstance(partition, SyzFile):  # no file is wanted
            return
        fs, path = opened(partition.uri)
        size = fs.get_file_info(path).size
        if size < _WORDS.size + TEXT + BINARY + _TRAILER.size:
            raise ValueError(f"{partition.uri} is cut short")
        with fs.open_input_file(path) as f:
            begin = f.read_at(_WORDS.size + TEXT + BINARY, 0)
            cookie, table_bytes = _WORDS.unpack_from(begin)
            if cookie != COOKIE:
                raise ValueError(f"{partition.uri} begins with {cookie}, so it has no compressed frames")
            index_at, n, last = _TRAILER.unpack(f.read_at(_TRAILER.size, size - _TRAILER.size))
            if last != END_COOKIE or index_at + n * _ENTRY.itemsize + _TRAILER.size != size:
                raise ValueError(f"{partition.uri} is cut short")
            index = np.frombuffer(f.read_at(n * _ENTRY.itemsize, index_at), _ENTRY)
            once = len(begin) + _TRAILER.size + n * _ENTRY.itemsize  # bytes read beside frames, told with the first row
            codes = None
            if self.grids:
                codes = frames.Tables.of(f.read_at(table_bytes, len(begin))).codes()
                once += table_bytes
            rows = []
            for e in index[[self._passes("frame_no", int(v)) for v in index["frame_no"]]]:
                rows.append(self._frame(f, partition, e, codes, once))
                once = 0
                if len(rows) == 16:
                    yield self._batch(pa, rows)
                    rows = []
            if rows:
                yield self._batch(pa, rows)

    def _frame(self, f, partition, e, codes, once: int) -> tuple:
        at, header_bytes, trace_bytes = int(e["at"]), int(e["header_bytes"]), int(e["trace_bytes"])
        if codes is None:
            raw = f.read_at(32, at + _WORDS.size + header_bytes)
            fields = grid = None
        else:
            raw = f.read_at(_WORDS.size + header_bytes + trace_bytes, at)
            if _WORDS.unpack_from(raw) != (header_bytes, trace_bytes):
                raise ValueError(f"{partition.uri} has other sizes at {at} than its index says")
            grid, fields = frames.restored_frame(raw[_WORDS.size + header_bytes :], raw[_WORDS.size : _WORDS.size + header_bytes], codes)
        head, _ = frames.frame_head(raw if codes is None else raw[_WORDS.size + header_bytes :])
        return partition.volume, int(e["frame_no"]), int(e["traces"]), int(e["samples"]), not head.raw, head.distortion, header_bytes, trace_bytes, fields, None if grid is None else grid.ravel(), len(raw) + once

    @staticmethod
    def _batch(pa, rows):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.float64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])


READ = "volume long, frame_no long, traces int, samples int, coded boolean, distortion float, header_bytes long, trace_bytes long, fields array<array<bigint>>, grid array<double>, bytes_read long"


def _lists(path: str) -> list[str]:
    from pyarrow import fs as pafs

    fs, base = opened(path)
    there = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(i.base_name for i in there if i.base_name.startswith("files-") and i.base_name.endswith(".json"))


def listed(path: str) -> list[dict]:
    """name, volume, first and last frame, frames and bytes of each file that a write has listed, in order."""
    fs, base = opened(path)
    out = []
    for name in _lists(path):
        with fs.open_input_stream(f"{base}/{name}") as f:
            out += json.loads(f.read())
    return sorted(out, key=lambda f: (f["volume"], f["first"], f["name"]))


class SyzWriter(DataSourceArrowWriter):
    def __init__(self, path: str, tables: bytes, overwrite: bool, most_bytes: int, traces_: int, interval: int):
        self.path, self.tables, self.most_bytes, self.traces, self.interval = path, tables, most_bytes, traces_, interval
        self.replaced = _lists(path) if overwrite else []

    def write(self, iterator):
        """Files of this task's frames, in order of volume and frame as they come: a new one for each volume, and for what a full one doesn't hold."""
        fs, base = opened(self.path)
        fs.create_dir(base, recursive=True)
        done, out, entries, volume, at = [], None, [], None, 0

        def ended():
            index = np.array(entries, _ENTRY)
            out.write(index.tobytes() + _TRAILER.pack(at, len(entries), END_COOKIE))
            out.close()
            done.append({"name": name, "volume": volume, "first": int(index["frame_no"].min()), "last": int(index["frame_no"].max()), "frames": len(entries), "bytes": at + index.nbytes + _TRAILER.size})

        for batch in iterator:
            for v, frame, n2, n1, head, payload in zip(*(batch.column(c).to_pylist() for c in ("volume", "frame_no", "traces", "samples", "head", "payload"))):
                if v is None or frame is None:
                    raise ValueError("a frame in a file needs a volume and a number")
                if out is None or v != volume or at > self.most_bytes:
                    if out:
                        ended()
                    name, volume, entries = f"SOURCE_{v}-{uuid.uuid4().hex}.syz", v, []
                    out = fs.open_output_stream(f"{base}/{name}")
                    begin = _WORDS.pack(COOKIE, len(self.tables)) + file_header(min(self.traces or n2, 32767), self.interval, min(n1, 32767)) + self.tables
                    out.write(begin)
                    at = len(begin)
                entries.append((frame, at, n2, n1, len(head), len(payload)))
                out.write(_WORDS.pack(len(head), len(payload)) + head + payload)
                at += _WORDS.size + len(head) + len(payload)
        if out:
            ended()
        return SyzWritten(done)

    def commit(self, messages):
        fs, base = opened(self.path)
        fs.create_dir(base, recursive=True)
        old = [f["name"] for f in listed(self.path)] if self.replaced else []
        with fs.open_output_stream(f"{base}/files-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        for name in [*self.replaced, *old]:
            fs.delete_file(f"{base}/{name}")

    def abort(self, messages):
        fs, base = opened(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{base}/{f['name']}")


class SyzSource(DataSource):
    """Options: path; to read: grids (false: heads of frames only); to write: tables (hex), most_bytes, traces_per_frame, interval (microseconds)."""

    @classmethod
    def name(cls):
        return "syz"

    def schema(self):
        return READ

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("the path of the files must be given")
        return path.rstrip("/")

    def reader(self, schema):
        return SyzReader(self._path(), self.options.get("grids", "true").lower() == "true")

    def writer(self, schema, overwrite):
        lacking = {"volume", "frame_no", "traces", "samples", "head", "payload"} - set(schema.names)
        if lacking:
            raise ValueError(f"frames to write need the columns {sorted(lacking)}")
        get = lambda k, default: int(self.options.get(k, default))
        return SyzWriter(self._path(), bytes.fromhex(self.options.get("tables", "")), overwrite, get("most_bytes", MOST_BYTES), get("traces_per_frame", 0), get("interval", 4000))


def write_frames(packed: DataFrame, tables: frames.Tables, path: str, overwrite: bool = False, parts: int | None = None, most_bytes: int = MOST_BYTES) -> None:
    """Writes frames in bytes (as plans.frames.compress makes them) to files, dealt out by ranges of volume and frame, so that a large volume is many files of many tasks."""
    enable(packed.sparkSession)
    ranged = packed.repartitionByRange(*([parts] if parts else []), "volume", "frame_no").sortWithinPartitions("volume", "frame_no")
    ranged.write.format("syz").mode("overwrite" if overwrite else "append").option("tables", tables.bytes().hex()).option("most_bytes", most_bytes).save(path)


def read_frames(spark: SparkSession, path: str, grids: bool = True) -> DataFrame:
    """Frames of files (READ). Without grids only the heads of frames are read: fields and grid are null."""
    enable(spark)
    return spark.read.format("syz").option("grids", str(grids).lower()).load(path)


def begin_of(uri: str) -> tuple[int, float, int]:
    """Traces a frame, interval in milliseconds and samples a trace, as a file's headers state them."""
    fs, base = opened(uri)
    with fs.open_input_file(base) as f:
        begin = f.read_at(_WORDS.size + TEXT + BINARY, 0)
    if len(begin) < _WORDS.size or _WORDS.unpack_from(begin)[0] != COOKIE:
        raise ValueError(f"{uri} has no compressed frames")
    n2, interval, n1 = parse_header(begin[_WORDS.size :])
    return n2, interval / 1000, n1


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """name, volume, frames, bytes, traces_per_frame, interval_ms and samples of each file, from its first bytes; a file without the cookie is an error."""
    worker_path(spark)
    rows = [(f["name"], f["volume"], f["frames"], f["bytes"]) for f in listed(path)]  # a row a file

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [begin_of(f"{path}/{name}") for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int32())))], FILES_NAMES)

    df = spark.createDataFrame(rows, "name string, volume long, frames long, bytes long")
    return df.repartition(max(1, min(len(rows), 64))).mapInArrow(run, FILES)


FILES = "name string, volume long, frames long, bytes long, traces_per_frame int, interval_ms double, samples int"
FILES_NAMES = [x.split()[0] for x in FILES.split(", ")]


def written(spark: SparkSession, d: str, volume, **how) -> str:
    """A new folder of files of the traces' frames, in volumes by an expression."""
    path = folder(spark, "syz")
    framed = frames.gathered(traces(spark, d).withColumn("volume", volume), ["trace_id", "frame_key"])
    packed, tables = frames.compress(framed, limit=frames.LIMIT, **how)
    write_frames(packed, tables, path)
    return path


@query("src_syz_header", "SELECT CAST(label AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS frames, CAST(max(n) AS INT) AS most_traces, 64 AS samples FROM (SELECT label, floor(vec_id/32.0e0) AS f, count(*) AS n FROM embeddings WHERE label BETWEEN 2 AND 5 AND floor(vec_id/32.0e0)>=4 GROUP BY 1, 2) GROUP BY 1")
def src_syz_header(spark: SparkSession, d: str) -> DataFrame:
    """Frames from the fifth on of volumes 2 to 5, by the heads of frames in files of compressed ones."""
    got = read_frames(spark, written(spark, d, F.col("frame_key")), grids=False).where("volume between 2 and 5 and frame_no >= 4")
    return got.groupBy("volume").agg(F.count("*").alias("frames"), F.max("traces").alias("most_traces"), F.max("samples").alias("samples"))


_RANGE = "frame_no%2=1 AND frame_no BETWEEN 3 AND 11"


@query("syz_frame_range", frames.chain(*frames.CODEC_SQL, body=f"SELECT CAST(1 AS BIGINT) AS volume, CAST(frame_no AS BIGINT) AS frame_no, CAST(live AS INT) AS traces, CAST({N1} AS INT) AS samples, bad=0 AS coded, floor(CASE WHEN bad=1 THEN (SELECT sum(x*x) FROM u WHERE u.frame_no=f.frame_no) ELSE (SELECT sum(z*z) FROM z WHERE z.frame_no=f.frame_no) END*1e4+0.5e0)/1e4 AS energy, (SELECT sum(trace_id) FROM (SELECT DISTINCT frame_no, trace_id FROM samples) t WHERE t.frame_no=f.frame_no)::BIGINT AS ids FROM f WHERE live={N2} AND {_RANGE}"))
def syz_frame_range(spark: SparkSession, d: str) -> DataFrame:
    """Whole frames 3 to 11 of volume 1, out of files of compressed frames: traces restored, and the header field that counts traces. Other frames' bytes aren't read."""
    path = written(spark, d, F.col("frame_no") % 2, shape=frames.FIXED)
    got = read_frames(spark, path).where(f"volume = 1 and frame_no between 3 and 11 and traces = {N2}")
    energy = F.aggregate("grid", F.lit(0.0), lambda a, x: a + x * x)
    return got.select("volume", "frame_no", "traces", "samples", "coded", r4(energy).alias("energy"), F.aggregate(F.col("fields")[1], F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query("syz_files", "SELECT CAST(f%3 AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS frames, CAST(sum(n) AS BIGINT) AS traces, 4.0e0 AS interval_ms, CAST(64 AS INT) AS samples FROM (SELECT CAST(floor(vec_id/32.0e0) AS INT) AS f, count(*) AS n FROM embeddings GROUP BY 1) GROUP BY 1")
def syz_files(spark: SparkSession, d: str) -> DataFrame:
    """Volumes of files of compressed frames: their frames by the lists, traces by the indexes, interval and samples by the files' headers."""
    path = written(spark, d, F.col("frame_no") % 3)
    files = files_of(spark, path).groupBy("volume").agg(F.sum("frames").alias("frames"), F.max("interval_ms").alias("interval_ms"), F.max("samples").alias("samples"))
    return files.join(read_frames(spark, path, grids=False).groupBy("volume").agg(F.sum("traces").alias("traces")), "volume").select("volume", "frames", "traces", "interval_ms", "samples")

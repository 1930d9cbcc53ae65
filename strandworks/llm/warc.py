"""Operator 5: WARC archives of pages, written with revisits, segments and chunked framing, and read back with segments put together.

Writing: records of equal payloads (SHA-1 and length) become one response, that with the largest page_id, and revisits that refer to it. The response's block is an HTTP
message with chunked framing; a block longer than SEGMENT bytes goes out as a first record and continuation records that name its identifier, are numbered, and
end with the total length. Every record is a gzip member of its own.

Reading: whole records are decoded where they are read. First segments and continuations are grouped by the origin's identifier, put in order of
their numbers, checked to be without gaps and of the stated total length, and then decoded like any other block.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a block from which it is segmented, and of a chunk of the HTTP framing.
SEGMENT, CHUNK = 16_384, 4_096
DATE = "2020-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over. Raises ValueError where it is cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def page_id_of(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:x-page:").split(":")[0].rstrip(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def page_records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page: a response, in segments where it is long, or a revisit."""
    payload = (html or "").encode()
    digest = base32_sha1(payload)
    urn = lambda i: f"<urn:x-page:{'' if i is None else i}:{digest}>"
    headers = [("WARC-Record-ID", urn(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record("revisit", [*headers, profile, ("WARC-Refers-To", urn(refers_to))], http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record("response", headers, block)
        return
    yield record("response", [*headers, ("WARC-Segment-Number", "1")], block[:segment])
    for k, at in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment >= len(block) else []
        origin = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", urn(page_id)), ("WARC-Segment-Number", str(k))]
        yield record("continuation", [*origin, *last], block[at : at + segment])


def parse(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and blocks of a gzipped archive's records, reading a stretch of it at a time."""
    inflate, raw, have = zlib.decompressobj(31), b"", bytearray()

    def more() -> bool:
        nonlocal inflate, raw
        while True:
            if inflate.eof:
                raw, inflate = inflate.unused_data + raw, zlib.decompressobj(31)
            if not raw:
                raw = stream.read(size)
                if not raw:
                    return False
            got, raw = inflate.decompress(raw, size), b""
            if not inflate.eof:
                raw = inflate.unconsumed_tail
            if got:
                have.extend(got)
                return True

    while True:
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not more():
                if have.strip():
                    raise ValueError("an archive ends within a record's headers")
                return
        version, *lines = bytes(have[:end]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        stop = end + 4 + int(headers["content-length"])
        while len(have) < stop + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield headers, bytes(have[end + 4 : stop])
        del have[: stop + 4]


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers (lower-case names) and payload of a block, without its chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    return headers, unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of segments (number, total length or null, bytes), in any order. Raises ValueError for gaps or a wrong length."""
    segments = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[2] for s in segments)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1][1] != len(block):
        raise ValueError("segments are missing or don't have the stated total length")
    return block


def described(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a whole record, its digest checked."""
    http, payload = http_payload(block)
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        return page_id_of(headers["warc-record-id"]), int(http["content-length"]), stated, "revisit", page_id_of(headers["warc-refers-to"])
    if base32_sha1(payload) != stated:
        raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have the stated digest")
    return page_id_of(headers["warc-record-id"]), len(payload), stated, headers["warc-type"], None


def with_refers_to(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: for payloads of at least least_bytes that are equal, the largest page_id, on all rows but that."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"), F.length(payload).alias("bytes"))
    counted = keyed.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = common.stored(counted, "payload-groups")
    rows, dealt = common.with_salt(keyed, groups, ["sha", "bytes"], "n", pages.count(), F.xxhash64("page_id", "url"))
    other = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(dealt.drop("n"), ["sha", "bytes", "salt"], "left").select("page_id", "url", "html", other.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Writes an archive a task to the folder; returns the manifest (uri, records). Attempts write files of their own; only those in the manifest count."""

    common.prepare(pages.sparkSession)

    def write(batches):
        import pyarrow as pa

        fs, path = common.filesystem(folder)
        out, n, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in common.short(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                for r in page_records(*row, segment=segment):
                    z = zlib.compressobj(4, wbits=31)
                    out.write(z.compress(r) + z.flush())
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    return common.stored(pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "uri string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page in the archives, segmented ones put together.

    Archives are read once: whole records are described and segments passed on, as rows of one table.
    """
    import pyarrow as pa

    common.prepare(manifest.sparkSession)
    segment = "origin string, number int, total long, digest string, block binary"
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def batched(rows, schema, most=256):
        names, types = zip(*((n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))))

        def batch(chunk):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk), types)], list(names))

        chunk = []
        for row in rows:
            chunk.append(row)
            if len(chunk) == most:
                yield batch(chunk)
                chunk = []
        if chunk:
            yield batch(chunk)

    def read(batches):
        def rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    fs, path = common.filesystem(uri)
                    with fs.open_input_stream(path, compression=None) as stream:
                        for h, b in parse(stream):
                            if "warc-segment-number" in h:
                                total = h.get("warc-segment-total-length")
                                yield *[None] * 5, h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]), total and int(total), h.get("warc-payload-digest"), b
                            else:
                                yield *described(h, b), *[None] * 5

        yield from batched(rows(), f"{RECORD}, {segment}")

    def join(batches):
        def rows():
            for batch in common.short(batches):
                for origin, copies, digest, parts in zip(*(c.to_pylist() for c in batch.columns)):
                    block = reassemble([(p["number"], p["total"], p["block"]) for p in parts])
                    for _ in range(copies):
                        yield described({"warc-type": "response", "warc-record-id": origin, "warc-payload-digest": digest}, block)

        yield from batched(rows(), RECORD)

    files = manifest.select("uri").repartition(max(1, manifest.count()))
    records = common.stored(files.mapInArrow(read, f"{RECORD}, {segment}"), "warc-records")
    # rows that repeat a page repeat its segments too: one of each is enough, and the first says how often
    each = records.where("number is not null").groupBy("origin", "number").agg(F.count("*").alias("copies"), F.first("total").alias("total"), F.first("digest").alias("digest"), F.first("block").alias("block"))
    grouped = each.groupBy("origin").agg(F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"), F.max("digest").alias("digest"), F.collect_list(F.struct("number", "total", "block")).alias("parts"))
    joined = grouped.select("origin", F.coalesce("copies", F.lit(1)).alias("copies"), "digest", "parts").mapInArrow(join, RECORD)
    return records.where("number is null").select(joined.columns).unionByName(joined)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; null urls have no target header; rows that repeat page_id and payload are records of their own.
    """
    common.prepare(spark)
    manifest = write_archives(with_refers_to(common.table(spark, sf_dir, "pages")), common.work_dir(spark, "warc"))
    return read_archives(manifest)


#: Base 32 by two hex digits at a time: the j-th letter's five bits begin 5 j % 4 bits into the digit 5 j // 4.
_HEX_AT = "(strpos('0123456789abcdef', substr(s, {}, 1)) - 1)"
_LETTER = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * {_HEX_AT.format('5 * j // 4 + 1')} + {_HEX_AT.format('5 * j // 4 + 2')}) >> (3 - 5 * j % 4)) & 31), 1)"
OP5_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '0' AS s FROM pages
), m AS (
  SELECT h, max(page_id) AS first FROM p GROUP BY h
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda j: {_LETTER}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN m USING (h)
"""

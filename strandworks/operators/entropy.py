"""Huffman coding of run-length bytes: a code table from the corpus's own histogram, sizes by lookup, bytes by Arrow functions."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coding import follow
from ..registry import query
from ..tables import headers, sql
from .lapped import worker_path

END = 256


def code_table(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits) for counts of symbols; canonical codes, lengths from the tree of least weights, ties by smallest symbol."""
    heap = [(n, s, [s]) for s, n in counts.items()]
    heapq.heapify(heap)
    bits = dict.fromkeys(counts, 0 if len(counts) > 1 else 1)
    while len(heap) > 1:
        (n, s, a), (m, t, b) = heapq.heappop(heap), heapq.heappop(heap)
        for x in a + b:
            bits[x] += 1
        heapq.heappush(heap, (n + m, min(s, t), a + b))
    out, code, last = {}, 0, 0
    for length, symbol in sorted((b, s) for s, b in bits.items()):
        code <<= length - last
        out[symbol], last = (code, length), length
        code += 1
    return out


class Codes:
    """Codes of symbols, made of their counts; bytes are encoded by array operations and decoded by a table of the next bits."""

    def __init__(self, counts: dict[int, int]):
        self.table = code_table(counts)
        self.code, self.bits = np.zeros(END + 1, np.uint64), np.zeros(END + 1, np.int64)
        for s, (code, bits) in self.table.items():
            self.code[s], self.bits[s] = code, bits
        self.longest = int(self.bits.max())
        self.order = np.array(sorted(self.table, key=lambda s: self.table[s][::-1]))
        self.firsts = np.array([self.table[s][0] << (self.longest - self.table[s][1]) for s in self.order.tolist()], np.uint64)

    def encode(self, data: bytes) -> bytes:
        """The codes of bytes and of the end, first bits first, packed from the low bits of each byte up."""
        s = np.append(np.frombuffer(data, np.uint8), END)
        bits = self.bits[s]
        if not bits.all():
            raise ValueError("a byte has no code")
        ends = np.cumsum(bits)
        left = np.repeat(ends, bits) - 1 - np.arange(ends[-1])  # bits of the code after this one
        return np.packbits((np.repeat(self.code[s], bits) >> left.astype(np.uint64)).astype(np.uint8) & 1, bitorder="little").tobytes()

    def decode(self, data: bytes) -> bytes:
        """What code would begin at each place is found for all places at once; then those that follow one another from the first."""
        raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        padded = np.append(raw, np.zeros(self.longest, np.uint8)).astype(np.uint64)
        ahead = np.zeros(len(raw), np.uint64)  # the next bits at each place
        for k in range(self.longest):
            ahead = ahead << np.uint64(1) | padded[k : k + len(raw)]
        # canonical codes, left-aligned, are in order: the last that isn't larger is the one
        found = self.order[np.searchsorted(self.firsts, ahead, side="right") - 1]
        symbols = found[follow(np.arange(len(found)) + self.bits[found])]
        (end,) = np.nonzero(symbols == END)
        if not len(end):
            raise ValueError("the codes have no end")
        return symbols[: end[0]].astype(np.uint8).tobytes()


def texts(spark, d) -> DataFrame:
    """Payloads to code: all bytes of a frame's header numbers, big-endian, trace by trace; a frame has at most 120 traces."""
    b = F.array(*(F.shiftright(h, s).bitwiseAND(255) for h in ("h0", "h1", "h2", "h3") for s in (24, 16, 8, 0)))
    h = headers(spark, d).groupBy("frame_no").agg(F.array_sort(F.collect_list(F.struct("trace_in_frame", b.alias("b")))).alias("s"))
    return h.select("frame_no", F.flatten(F.transform("s", lambda x: x["b"])).alias("bytes"))


def histogram(df: DataFrame) -> DataFrame:
    """n of each symbol, the end of each payload included: 257 rows at most."""
    return df.select(F.explode(F.concat("bytes", F.array(F.lit(END)))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def counts_of(df: DataFrame) -> dict[int, int]:
    return {r["symbol"]: r["n"] for r in histogram(df).collect()} or {END: 1}


def table_of(df: DataFrame) -> dict[int, tuple[int, int]]:
    return code_table(counts_of(df))


_H = "b AS (SELECT frame_no, (v >> s) & 255 AS symbol FROM (SELECT frame_no, unnest([h0, h1, h2, h3]) AS v FROM headers), (VALUES (0), (8), (16), (24)) t(s) UNION ALL SELECT DISTINCT frame_no, 256 FROM headers)"


@query("huffman_table", sql("headers", body=_H + " SELECT CAST(symbol AS INT) AS symbol, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1"))
def huffman_table(spark, d):
    """Counts of the symbols that the code table is made of."""
    return histogram(texts(spark, d))


@query("huffman_lengths")
def huffman_lengths(spark, d):
    """The code of each symbol."""
    t = texts(spark, d)
    rows = [(s, c, b) for s, (c, b) in table_of(t).items()]
    codes = spark.createDataFrame(rows or [], "symbol int, code int, bits int")
    return histogram(t).join(F.broadcast(codes), "symbol")


@query("huffman_bits")
def huffman_bits(spark, d):
    """Bits of each frame's code, by lookup of each symbol's length."""
    t = texts(spark, d)
    bits = F.create_map(*(F.lit(x) for s, (_, b) in (table_of(t) or {END: (0, 1)}).items() for x in (s, b)))
    return t.select("frame_no", F.aggregate(F.concat("bytes", F.array(F.lit(END))), F.lit(0), lambda a, s: a + bits[s]).cast("long").alias("bits"))


@query("huffman_checksum", sql("headers", body=_H + " SELECT CAST(count(*) AS BIGINT) AS symbols, CAST(sum(symbol) AS BIGINT) AS checksum FROM (SELECT DISTINCT symbol FROM b)"))
def huffman_checksum(spark, d):
    """Symbols of the code table and their sum, which a table read back must have too."""
    return histogram(texts(spark, d)).agg(F.count("*").alias("symbols"), F.sum("symbol").alias("checksum"))


@query("huffman_tree_checksum", sql("headers", body=_H + " SELECT CAST(count(*) AS BIGINT) AS leaves, CAST(count(*)-1 AS BIGINT) AS inner_nodes, CAST(sum(symbol)-(count(*)-1) AS BIGINT) AS checksum FROM (SELECT DISTINCT symbol FROM b)"))
def huffman_tree_checksum(spark, d):
    """Leaves and inner nodes of the code's tree, the latter found as the distinct beginnings of codes, and the leaves' symbols less the number of inner nodes."""
    codes = huffman_lengths(spark, d)
    inner = codes.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("bits") - 1), lambda k: F.struct(k.alias("k"), F.floor(F.col("code") / F.pow(F.lit(2.0), F.col("bits") - k)).alias("beginning"))))).distinct().agg(F.count("*").alias("inner_nodes"))
    leaves = codes.agg(F.count("*").alias("leaves"), F.sum("symbol").alias("symbols"))
    return leaves.join(F.broadcast(inner)).select("leaves", "inner_nodes", (F.col("symbols") - F.col("inner_nodes")).alias("checksum"))  # a row each


def improved(counts: dict[int, int], aim: dict[int, int], tries: int = 200, seed: int = 42) -> tuple[dict[int, int], list[int]]:
    """Counts changed at random, a symbol at a time, each change kept if payloads with the counts aim need no more bits by its code; and the bits after each try."""
    rng = np.random.default_rng(seed)

    def cost(c):
        codes = code_table(c)
        return sum(n * codes[s][1] for s, n in aim.items())

    symbols, best = sorted(counts), dict(counts)
    bits = [cost(best)]
    for _ in range(tries):
        s = symbols[int(rng.integers(len(symbols)))]
        changed = best | {s: max(1, int(best[s] * np.exp(rng.normal())))}
        now = cost(changed)
        if now <= bits[-1]:
            best = changed
        bits.append(min(now, bits[-1]))
    return best, bits


@query("huffman_table_search")
def huffman_table_search(spark, d):
    """A table for the corpus found from equal counts by random changes: its bits after each try. Only the 257 counts come to the driver."""
    aim = counts_of(texts(spark, d))
    bits = improved(dict.fromkeys(aim, 1), aim)[1]
    return spark.createDataFrame(list(enumerate(bits)), "attempt int, bits long")


def coded(df: DataFrame) -> DataFrame:
    """frame_no, raw and coded bytes, and whether decoding gives the payload back."""
    worker_path(df.sparkSession)
    codes = Codes(counts_of(df))  # of 257 entries at most

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [bytes(v) for v in batch.column(1).to_pylist()]
            out = [codes.encode(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(out, pa.binary()), pa.array([codes.decode(o) == r for o, r in zip(out, raw)], pa.bool_())], ["frame_no", "raw", "coded", "same"])

    return df.mapInArrow(run, "frame_no int, raw long, coded binary, same boolean")


@query("huffman_bytes")
def huffman_bytes(spark, d):
    return coded(texts(spark, d)).select("frame_no", "raw", F.hex("coded").alias("coded"))


@query("huffman_roundtrip", sql("headers", body="SELECT frame_no, CAST(16*count(*) AS BIGINT) AS raw, true AS same FROM headers GROUP BY 1"))
def huffman_roundtrip(spark, d):
    return coded(texts(spark, d)).select("frame_no", "raw", "same")

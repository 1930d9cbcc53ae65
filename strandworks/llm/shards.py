"""Operator 13: contiguous shards of near equal bytes, in DataFrame functions alone.

Rows are put in order of doc_id and cut into stretches. Each stretch has its own running sums of sizes; the totals of all stretches, summed in their order, say
how many bytes lie before each, and so before every row of the table. The table is cut wherever that passes another equal part of all bytes, at the row's
end that is nearer: a shard's bytes differ from an equal part by the size of one document at most, however sizes are spread.

Only ids, sizes and sums go through the shuffle, not texts, unless the texts are to be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
#: Bytes that a row takes beside its text, and the most stretches: their bounds are in the plan, their totals in one small table.
OVERHEAD, MOST_STRETCHES = 16, 4096


def stretches(docs: DataFrame, key: str) -> Column:
    """A number for each row, ascending with the key (nulls last), that few rows share: at most about one in as many as there are stretches.

    A value of the key (or null) that many rows have gets several numbers, as many as quantiles fall on it, and its rows are dealt among them.
    """
    parts = min(MOST_STRETCHES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grid = F.array(*(F.lit(i / parts) for i in range(1, parts + 1)))
    found, top, rows, keyed = docs.select(F.percentile_approx(key, grid, 100 * parts), F.max(key), F.count("*"), F.count(key)).first()
    quantiles = [*(found or []), *([top] if keyed else [])]
    bounds = sorted(set(quantiles))
    several = [n if n > 1 else 0 for n in map(quantiles.count, bounds)]
    firsts = [0]
    for n in several:
        firsts.append(firsts[-1] + 1 + n)
    turn = F.monotonically_increasing_id()
    nulls = F.lit(firsts[-1]) + F.pmod(turn, F.lit(1 + (rows - keyed) * parts // max(1, rows)))
    if not bounds:
        return nulls.cast("int")
    k = common.stretch_of(F.col(key), bounds)
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    own = common.let(k, lambda i: at(firsts, i) + F.when((at(several, i) > 0) & (at(bounds, i) == F.col(key)), 1 + F.pmod(turn, F.greatest(at(several, i), F.lit(1)))).otherwise(0))
    return F.when(F.col(key).isNull(), nulls).otherwise(own).cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; with whole also the row itself, as a struct named row.

    size is the text's UTF-8 bytes (null: none) and the overhead. Shards are stretches of the rows in order of doc_id, null ids last; rows that share an id come in order of checksum
    and size, but for an id that many rows have: those come in any order. Slots count a shard's rows in that order from 0. A document larger than an equal part of all bytes leaves
    shards beside it empty. An empty table gives no rows. Sums are longs: all bytes times twice the number of shards must be below 2^63.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = ["doc_id", (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), stretches(docs.select("doc_id"), "doc_id").alias("stretch")]
    rows = docs.select(*columns, *([F.struct("*").alias("row")] if whole else []))
    order = Window.partitionBy("stretch").orderBy("doc_id", "text_crc32", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = common.stored(rows.withColumn("before", before).withColumn("number", F.row_number().over(order) - 1), "shard-rows")
    # a row a stretch
    upto = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("stretch").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select("stretch", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("bytes"))
    middle = 2 * (F.col("bytes_before") + F.col("before")) + F.col("size")
    cut = placed.join(F.broadcast(totals), "stretch").withColumn("shard", F.call_function("div", middle * shards, 2 * F.col("bytes")).cast("int"))
    cut = cut.withColumn("number", F.col("rows_before") + F.col("number"))
    firsts = cut.groupBy("shard").agg(F.min("number").alias("first"))  # a row a shard
    out = cut.join(F.broadcast(firsts), "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("number") - F.col("first")).alias("slot"), *(["row"] if whole else []))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Writes all columns of the documents and slot as Parquet, in a folder shard=N for each shard, sorted by slot within files; returns the manifest (shard, rows, bytes), by sizes as above.

    A column named slot or shard is replaced. This shuffles the texts once, by stretches of doc_id.
    """
    got = sharded(docs, shards, whole=True)
    kept = [c for c in docs.columns if c not in ("slot", "shard")]
    got.select(*(F.col("row")[c].alias(c) for c in kept), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return got.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of all documents by bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not key)."""
    got = sharded(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 by bytes: the remainder of a byte is eight halvings, each with the polynomial's bits where the last bit was set.
_STEPS = "x"
for _ in range(8):
    _STEPS = f"list_transform([{_STEPS}], lambda x: xor(x >> 1, (x & 1) * 3988292384))[1]"
OP13_SQL = f"""
WITH r AS (
  SELECT list({_STEPS} ORDER BY x) AS table FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS x)
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size FROM documents
), c AS (
  SELECT doc_id, size, list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda a, b: xor(a >> 8, r.table[xor(a & 255, b) + 1]), CAST(4294967295 AS BIGINT)) AS crc FROM d, r
), p AS (
  SELECT doc_id, size, xor(crc, 4294967295) AS text_crc32, CAST(sum(size) OVER w - size AS HUGEINT) AS before, sum(size) OVER () AS total, row_number() OVER w AS number FROM c WINDOW w AS (ORDER BY doc_id NULLS LAST, crc, size ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT *, CAST(40 * (2 * before + size) // (2 * total) AS INT) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(number - min(number) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""

"""Operator 4: document fingerprints by winnowing, in DataFrame functions alone.

Units are words of up to 16 code points; of longer runs without a space, every code point is a unit, so that in texts without spaces an edit changes only what is near it.
A gram of 4 units has a cyclic polynomial hash, which rolls: it is made of the hashes of its two halves. Of each window of 16 grams the least hash is picked, the rightmost of equal ones, and kept with its place.
Any run of 16 + 4 - 1 = 19 equal units in two texts thus shares a pick. Texts with fewer grams than a window have one window, and those
with fewer units than a gram one gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import let

GRAM, WINDOW, UNIT_CHARS = 4, 16, 16
UNIT = f"(?<!{common.NOT_SPACE}){common.NOT_SPACE}{{1,{UNIT_CHARS}}}(?!{common.NOT_SPACE})|{common.NOT_SPACE}"
#: Bits of a pick: 32 of the hash, then 31 of the place counted down, so that the least has the rightmost place.
PLACE_BITS = 31
_LAST = (1 << PLACE_BITS) - 1


def _rolled(values: Column, n: int) -> Column:
    """Hashes of runs of 2n values from those of runs of n."""
    rest = lambda v: F.greatest(F.size(v) - n, F.lit(0))
    turn = lambda x: F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))
    return let(values, lambda v: F.zip_with(F.slice(v, F.lit(1), rest(v)), F.slice(v, F.lit(n + 1), rest(v)), lambda a, b: turn(a).bitwiseXOR(b)))


def picks(text: Column) -> Column:
    """The picks of a text in order, as an array of longs. Null or without a unit: empty."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))

    def grams(u: Column) -> Column:
        return F.when(F.size(u) < GRAM, F.array(F.xxhash64(F.array_join(u, " ")))).otherwise(_rolled(_rolled(F.transform(u, lambda x: F.xxhash64(x)), 1), 2))

    def placed(u: Column) -> Column:
        return F.transform(grams(u), lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 32), PLACE_BITS).bitwiseOR(F.lit(_LAST) - i))

    def least(p: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(p) - WINDOW + 1), lambda i: F.array_min(F.slice(p, i, F.lit(WINDOW))))
        return F.when(F.size(p) <= WINDOW, F.array(F.array_min(p))).otherwise(F.array_distinct(each))

    return let(units, lambda u: F.when(F.size(u) == 0, F.array().cast("array<long>")).otherwise(let(placed(u), least)))


def hashes(picked: Column) -> Column:
    """The distinct hashes of picks."""
    return F.array_distinct(F.transform(picked, lambda p: F.shiftright(p, PLACE_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two texts' picks; 1 where neither has any."""
    return let(hashes(a), lambda x: let(hashes(b), lambda y: let(F.size(F.array_union(x, y)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / n))))


def as_string(picked: Column) -> Column:
    """hash:place of each pick, the hash in hex, joined by commas."""
    return F.array_join(F.transform(picked, lambda p: F.concat(F.lower(F.hex(F.shiftright(p, PLACE_BITS))), F.lit(":"), (F.lit(_LAST) - p.bitwiseAND(_LAST)).cast("string"))), ",")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (doc_id, columns) with next_<column> of the row that follows in descending (doc_id, text); the first follows the last.

    Rows are dealt by stretches of doc_id whose bounds are ids of the table; a row that ends a stretch is also a guest in the one above, and the largest id
    a guest at the end of the lowest, so each stretch finds all its neighbours by itself. Null ids come last; repeated rows follow one another.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = common.id_bounds(docs, "doc_id", parts)
    dealt = docs.withColumn("stretch", common.stretch_of(F.col("doc_id"), bounds))
    if bounds:
        inner = F.array(*map(F.lit, bounds[:-1])) if len(bounds) > 1 else F.array().cast("array<long>")
        above = F.when(F.array_contains(inner, F.col("doc_id")), F.array(F.struct((F.col("stretch") + 1).alias("at"), F.lit(1).alias("guest"))))
        wrapped = F.when(F.col("doc_id") == bounds[-1], F.array(F.struct(F.lit(0).alias("at"), F.lit(1).alias("guest"))))
        none = F.array().cast("array<struct<at:int,guest:int>>")
        seats = F.concat(F.array(F.struct(F.col("stretch").alias("at"), F.lit(0).alias("guest"))), F.coalesce(above, none), F.coalesce(wrapped, none))
        dealt = dealt.withColumn("seat", F.explode(seats)).select("doc_id", *columns, F.col("seat.at").alias("stretch"), F.col("seat.guest").alias("guest"))
    else:
        dealt = dealt.withColumn("guest", F.lit(0))
    order = Window.partitionBy("stretch").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    following = lambda c: F.lead(c).over(order) if bounds else F.coalesce(F.lead(c).over(order), F.first(c).over(order))
    return dealt.select("doc_id", *columns, "guest", *(following(c).alias(f"next_{c}") for c in columns)).where("guest = 0").drop("guest")


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third replaced by the beginning of the next document's. Null text: empty. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    picked = docs.select("doc_id", text.alias("text")).withColumn("picks", picks(F.col("text")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    result = let(
        edited,
        lambda e: let(
            picks(e),
            lambda p: F.struct(F.sha2(F.encode(e, "UTF-8"), 256).alias("edited_sha256"), as_string(p).alias("edited_fingerprint"), likeness(F.col("picks"), p).alias("near_edited")),
        ),
    )
    out = with_next(picked, ["text", "picks"]).withColumn("edited", result)
    return out.select("doc_id", n.cast("long").alias("n_chars"), "edited.edited_sha256", as_string(F.col("picks")).alias("fingerprint"), "edited.edited_fingerprint", "edited.near_edited", likeness(F.col("picks"), F.col("next_picks")).alias("near_next"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return compare_edited(common.table(spark, sf_dir, "documents"))

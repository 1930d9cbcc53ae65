"""Random numbers that depend on a key, a stream and nothing else: the same in any partitioning, in Spark and in DuckDB.

A key is folded to 32 bits and mixed by two rounds of shifts and products; no product passes 63 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The odd multiplier of a round, and the step between streams.
TIMES, STREAM = 0x45D9F3B, 0x9E3779B1
_LOW = 0xFFFFFFFF


def _round(x: Column) -> Column:
    return (x.bitwiseXOR(F.shiftright(x, 16)) * TIMES).bitwiseAND(_LOW)


def mix(key: Column) -> Column:
    """A spread-out number below 2^32 of a whole number."""
    k = key.cast("long")
    x = _round(_round(k.bitwiseXOR(F.shiftrightunsigned(k, 32)).bitwiseAND(_LOW)))
    return x.bitwiseXOR(F.shiftright(x, 16))


def uniform(key: Column, stream) -> Column:
    """A number above 0 and below 1; stream: a whole number (or Column) that tells a key's numbers apart."""
    stream = F.lit(stream) if isinstance(stream, int) else stream
    return (mix(mix(key) + stream.cast("long") * STREAM) + 0.5) / 4294967296.0


def normal(key: Column, stream: Column) -> Column:
    """A standard normal number, by Box and Muller's transform of streams 2 k and 2 k + 1."""
    stream = stream.cast("long")
    return F.sqrt(-2 * F.log(uniform(key, 2 * stream))) * F.cos(2 * np.pi * uniform(key, 2 * stream + 1))


def beta(key: Column, shape: float, stream: int, tries: int = 40) -> Column:
    """A number of the symmetric Beta distribution, by Jöhnk's rejection: the first pair of powers of uniform numbers whose sum is at most 1.

    For shapes up to 1 more than half of all pairs will do, so none of the tries does with a chance below 1e-12; it is 0.5 then.
    """
    pair = lambda k: F.struct(F.pow(uniform(key, k * 2 + stream), F.lit(1 / shape)).alias("x"), F.pow(uniform(key, k * 2 + 1 + stream), F.lit(1 / shape)).alias("y"))
    good = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), pair), lambda p: (p["x"] + p["y"] <= 1) & (p["x"] + p["y"] > 0))
    first = F.try_element_at(good, F.lit(1))
    return F.coalesce(first["x"] / (first["x"] + first["y"]), F.lit(0.5))


#: DuckDB's twins, as macros for the beginning of a statement are not to be had: text with the argument put in.
def mix_sql(key: str) -> str:
    fold = f"(xor({key}, ({key} >> 32) & 4294967295) & 4294967295)"
    one = f"list_reduce([{fold}, 0, 0], lambda x, i: (xor(x, x >> 16) * {TIMES}) & {_LOW})"
    return f"list_transform([{one}], lambda x: xor(x, x >> 16))[1]"


def uniform_sql(key: str, stream: str) -> str:
    return f"((({mix_sql(f'({mix_sql(key)} + CAST({stream} AS BIGINT) * {STREAM})')}) + 0.5e0) / 4294967296.0e0)"


def normal_sql(key: str, stream: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(key, f'(2*({stream}))')})) * cos(2 * pi() * {uniform_sql(key, f'(2*({stream})+1)')}))"

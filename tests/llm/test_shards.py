"""Operator 13: shards by prefix sums of bytes."""

import random
import zlib

import pytest

from llm_data import ROWS, SCHEMA, documents, empty
from oracle import assert_same, connect
from strandworks.llm import common, queries, shards


def expected(rows, n):
    """(doc_id, size, crc, shard, slot) of rows (doc_id, text), by one running sum."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    order = sorted((d is None, d or 0, zlib.crc32(t), len(t) + 16) for d, t in raw)
    total, before, out, counts = sum(o[3] for o in order), 0, [], {}
    for null, d, crc, size in order:
        shard = n * (2 * before + size) // (2 * total)
        out.append((None if null else d, size, crc, shard, counts.setdefault(shard, 0)))
        counts[shard] += 1
        before += size
    return out


def test_oracle(spark, small):
    assert_same(queries.QUERIES["op13_sharding"](spark, small), connect(small), queries.ORACLE_SQL["op13_sharding"])


@pytest.mark.parametrize("n", [1, 7, 40])
def test_odd_rows(spark, n):
    got = [tuple(r) for r in shards.sharded(documents(spark), n).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected([r[:2] for r in ROWS], n)))
    assert shards.sharded(empty(spark), n).count() == 0


@pytest.mark.parametrize("hot", [None, 500, -(1 << 63), (1 << 63) - 1])
def test_an_id_of_a_third_of_all_rows(spark, hot):
    rng = random.Random(3)
    rows = [(hot if rng.random() < 0.4 else rng.randrange(1000), "x" * rng.randrange(40), "en", "s", 0) for _ in range(3000)]
    df = documents(spark, rows).repartition(5)
    got = shards.sharded(df, 9).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len(t) + 16, zlib.crc32(t.encode())) for d, t, *_ in rows)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order, key=lambda d: (d is None, d or 0))
    by = {s: [r for r in got if r["shard"] == s] for s in range(9)}
    part = sum(r["size"] for r in got) / 9
    for of in by.values():
        assert sorted(r["slot"] for r in of) == list(range(len(of)))
        assert abs(sum(r["size"] for r in of) - part) <= 56
    # the hot id's rows are dealt over many stretches
    dealt = df.withColumn("at", shards.stretches(df, "doc_id")).groupBy("at").count().collect()
    assert max(r["count"] for r in dealt) < 400


def test_all_rows_have_one_id(spark):
    for d in (None, 4):
        rows = [(d, "same", "en", "s", 0)] * 500
        got = shards.sharded(documents(spark, rows).repartition(3), 5).collect()
        assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(5) for k in range(100)]


def test_written_shards(spark):
    folder = common.work_dir(spark, "shards")
    manifest = shards.write_shards(documents(spark), folder, 3)
    back = spark.read.parquet(folder)
    want = expected([r[:2] for r in ROWS], 3)
    assert sorted((str(r["doc_id"]), zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in back.collect()) == sorted((str(d), crc, s, k) for d, _, crc, s, k in want)
    assert {r["shard"]: (r["rows"], r["bytes"]) for r in manifest.collect()} == {s: (len(x := [w for w in want if w[3] == s]), sum(w[1] for w in x)) for s in {w[3] for w in want}}
    assert set(SCHEMA.replace(" long", "").replace(" string", "").split(", ")) <= set(back.columns)

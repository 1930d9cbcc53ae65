"""Sketches of spans of days against exact figures; covers of spans against plain counting."""

import random
from datetime import datetime, timedelta

import pytest

from strandworks.operators import sketches
from strandworks.streaming.streams import folder


def test_covers_are_exact_and_short():
    rng = random.Random(3)
    for first, last in [(0, 0), (7, 8), (0, 511), (-9, 3), *((a, a + rng.randrange(3000)) for a in (rng.randrange(-2000, 20_000) for _ in range(200)))]:
        got = sketches.cover(first, last)
        days = sorted(d for level, b in got for d in range(b * sketches.WIDTH**level, (b + 1) * sketches.WIDTH**level))
        assert days == list(range(first, last + 1))
        assert len(got) <= 2 * (sketches.WIDTH - 1) * sketches.LEVELS + (last - first) // sketches.WIDTH**sketches.LEVELS + 1
    assert sketches.cover(5, 4) == []


SCHEMA = "ts timestamp, key string, who long, value double, n int"


def test_spans_late_days_and_odd_rows(spark):
    rng = random.Random(5)
    start = datetime(2024, 3, 1, 12)
    rows = [(start + timedelta(days=rng.randrange(100)), rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(3000)]), rng.choice([None, float("nan"), rng.gauss(0, 5), rng.random()]), 1) for _ in range(20_000)]
    rows += [(None, "a", 1, 1.0, 1), (start, "only nulls", None, None, 1), (start, "only nulls", None, float("nan"), 1)]
    path = folder(spark, "sketches-test")
    # the same rows in two parts, of which the second has days that the first has too
    for part in (rows[::2], rows[1::2]):
        sketches.write(sketches.by_day(spark.createDataFrame(part, SCHEMA), "ts", ["key"], "who", "value"), ["key"], path)
    day = (start - datetime(1970, 1, 1)).days
    spans = {0: (day, day + 99), 1: (day + 13, day + 71), 2: (day + 50, day + 50), 3: (day + 500, day + 600)}
    got = {(r["span"], r["key"]): r for r in sketches.estimates(sketches.over(spark, path, ["key"], spans), ["key"], {"q": 0.5}).collect()}
    seen = set()
    for s, (a, b) in spans.items():
        for key in {r[1] for r in rows}:
            of = [r for r in rows if r[0] and r[1] == key and a <= (r[0] - datetime(1970, 1, 1)).days <= b]
            if not of:
                assert (s, key) not in got
                continue
            seen.add((s, key))
            g, who, values = got[s, key], {r[2] for r in of} - {None}, [r[3] for r in of if r[3] is not None and r[3] == r[3]]
            assert g["n"] == len(of) and abs(g["distinct"] - len(who)) <= max(1, sketches.DISTINCT_OFF * len(who))
            if values:
                below, upto = (sum(v < g["q"] for v in values) / len(values), sum(v <= g["q"] for v in values) / len(values))
                assert below - sketches.RANK_OFF <= 0.5 <= upto + sketches.RANK_OFF
            else:
                assert g["q"] is None
    assert seen == set(got)


def test_empty_table_and_clashing_keys(spark):
    empty = spark.createDataFrame([], SCHEMA)
    path = folder(spark, "sketches-empty")
    sketches.write(sketches.by_day(empty, "ts", ["key"], "who", "value"), ["key"], path)
    assert sketches.over(spark, path, ["key"], {0: (0, 9)}).count() == 0
    assert sketches.over(spark, path, ["key"], {}).count() == 0
    with pytest.raises(ValueError, match="n"):
        sketches.by_day(empty, "ts", ["n"], "who", "value")

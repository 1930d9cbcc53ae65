"""Random numbers by key, weighted draws, mixup, and as-of joins against plain loops; the counter's state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import draws as numbers
from strandworks.learning import draws
from strandworks.operators import asof, labels
from strandworks.streaming import stateful
from strandworks.streaming.streams import folder


def test_numbers_are_spread_out(spark):
    ids = spark.range(20_000).select(numbers.uniform(F.col("id"), 1).alias("u"), numbers.uniform(F.col("id"), 2).alias("v"), numbers.normal(F.col("id"), F.lit(7)).alias("z"), numbers.beta(F.col("id"), 0.4, 100).alias("b"), numbers.uniform(-F.col("id") * (1 << 40), 1).alias("w")).toPandas()
    for c in "uvw":
        assert ids[c].between(0, 1).all() and abs(ids[c].mean() - 0.5) < 0.01 and np.abs(np.histogram(ids[c], 20, (0, 1))[0] - 1000).max() < 160
    assert abs(np.corrcoef(ids["u"], ids["v"])[0, 1]) < 0.03 and abs(np.corrcoef(ids["u"][1:], ids["u"][:-1])[0, 1]) < 0.03
    assert abs(ids["z"].mean()) < 0.03 and abs(ids["z"].std() - 1) < 0.03
    # the variance of Beta(a, a) is 1 / (4 (2 a + 1))
    assert abs(ids["b"].mean() - 0.5) < 0.01 and abs(ids["b"].var() - 1 / (4 * 1.8)) < 0.005


def test_hashed_takes_all_ids(spark):
    ids = [0, 1, 3_470_000_000, 2**62, 2**63 - 1, -1, -(2**63), 2**32, 2**32 - 1]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(labels.hashed(F.col("i"))).collect()
    assert [r[0] for r in got] == [i * 2654435761 % 2**32 for i in ids]


def test_alias_tables():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        w = rng.random(n) ** 4 + 1e-12
        keep, other = draws.alias_table(w.copy())
        chance = keep / n
        np.add.at(chance, other, (1 - keep) / n)
        assert np.allclose(chance, w / w.sum(), atol=1e-12) and keep.min() >= 0


@pytest.mark.parametrize("stretch", [draws.STRETCH_ROWS, 16])
def test_weighted_draws(spark, monkeypatch, stretch):
    monkeypatch.setattr(draws, "STRETCH_ROWS", stretch)
    weights = {k: float(k % 7) for k in range(200)}
    rows = [(k, w, "x") for k, w in weights.items()] + [(500, None, "n"), (501, -1.0, "n"), (502, float("nan"), "n"), (503, float("inf"), "n")]
    df = spark.createDataFrame(rows, "k int, w double, draws string")
    n = 60_000
    got = {r["k"]: r["draws"] for r in draws.drawn(df, F.col("w"), n).collect()}
    assert sum(got.values()) == n and set(got) <= {k for k, w in weights.items() if w > 0}
    share = {k: w / sum(weights.values()) for k, w in weights.items()}
    assert all(abs(got.get(k, 0) - n * s) <= 6 * (n * s * (1 - s)) ** 0.5 for k, s in share.items())
    chi = sum((got.get(k, 0) - n * s) ** 2 / (n * s) for k, s in share.items() if s)
    assert 90 < chi < 260  # 170 degrees of freedom
    again = {r["k"]: r["draws"] for r in draws.drawn(df.repartition(7), F.col("w"), n).collect()}
    other = {r["k"]: r["draws"] for r in draws.drawn(df, F.col("w"), n, 43).collect()}
    assert again == got and other != got
    assert draws.drawn(df.where("w < 0"), F.col("w"), n).count() == 0 and draws.drawn(df, F.col("w"), 0).count() == 0


def test_equal_rows_weigh_together(spark):
    df = spark.createDataFrame([(1,)] * 3000 + [(2,)] * 1000 + [(None,)] * 4000, "k int").repartition(5)
    got = {r["k"]: r["draws"] for r in draws.drawn(df, F.lit(1.0), 8000).collect()}
    assert sum(got.values()) == 8000 and abs(got[1] - 3000) < 300 and abs(got[None] - 4000) < 300
    even = {r["k"]: r["draws"] for r in draws.balanced(df, "k").collect()}
    assert sum(even.values()) == 4000 and abs(even[1] - 2000) < 200 and None not in even


def test_mixup(spark):
    rows = [(k, [float(k)] * (4 + k % 2), k % 3) for k in range(1200)] + [(None, [1.0], 0), (9999, None, 0)]
    df = spark.createDataFrame(rows, "id long, x array<float>, y int").withColumns({c: F.lit("z") for c in ("k", "v", "b", "share")})
    got = draws.mixed_up(df, "id", "x", "y").collect()
    assert sorted(r["id"] for r in got) == list(range(1200))
    partners = []
    for r in got:
        other = round((r["x"][0] - r["share"] * r["id"]) / (1 - r["share"])) if r["share"] < 0.999 else None
        assert r["label"] == r["id"] % 3 and (other is None or r["other"] == other % 3) and 0 <= r["share"] <= 1
        partners.append(other)
    found = [p for p in partners if p is not None]
    assert len(set(found)) == len(found) and sum(p == k + 1 for k, p in zip(sorted(range(1200)), partners)) < 30  # each is one row's partner, not its neighbour's
    assert [(r["x"], r["other"]) for r in draws.mixed_up(df.where("id = 5"), "id", "x", "y").collect()] == [([5.0] * 5, 2)]


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("tolerance", [None, 4])
def test_as_of(spark, direction, tolerance):
    rng = random.Random(5)
    some = lambda n, hot: [(rng.choice([1, 2, None]) if rng.random() > hot else 7, rng.choice([None, *range(60), -(2**40), 2**40]), k) for k in range(n)]
    left, right = some(200, 0.6), some(120, 0.6)
    got = asof.as_of(spark.createDataFrame(left, "device int, at long, id int").withColumn("match", F.lit(0)).repartition(3), spark.createDataFrame(right, "device int, at long, view int"), "device", "at", direction, tolerance)
    want = []
    for d, t, i in left:
        options = []
        for e, u, v in right:
            if d is not None and d == e and t is not None and u is not None and (tolerance is None or abs(t - u) <= tolerance):
                if (u <= t and direction != "forward") or (u >= t and direction != "backward"):
                    options.append((abs(t - u), u, -v))
        best = min(options, default=None)
        want.append((i, best and (best[1], -best[2])))
    assert sorted((r["id"], r["match"] and (r["match"]["at"], r["match"]["view"])) for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError):
        asof.as_of(got, got, "device", "at", "sideways")


def test_as_of_without_rows(spark):
    left, right = spark.createDataFrame([(1, 5)], "d int, t long"), spark.createDataFrame([], "d int, t long, v int")
    assert [tuple(r) for r in asof.as_of(left, right, "d", "t").collect()] == [(1, 5, None)]
    assert asof.as_of(left.where("false"), right, "d", "t").count() == 0


def test_counts_outlive_a_restart(spark):
    other = stateful.counting_session(spark)
    inbox, out, state = folder(spark, "verified"), folder(spark, "triggers"), folder(spark, "state")
    day = lambda k: f"2024-01-{1 + k:02d} 12:00:00"

    def deliver(rows):
        spark.createDataFrame(rows, "class string, t string").select("class", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(inbox)
        stateful.count_verified(other.readStream.schema("class string, ts timestamp").parquet(inbox), out, state, threshold=5, idle_days=3)
        return sorted((tuple(r) for r in spark.read.schema(stateful.RESULT).parquet(out).collect()), key=str)

    assert deliver([("a", day(0))] * 4 + [(None, day(0))] * 5) == [(None, "trigger", 1, 0)]
    assert ("a", "trigger", 1, 3) in deliver([("a", day(1))] * 4)  # the first run's four count
    third = deliver([("a", day(1))] * 8)
    assert [r for r in third if r[0] == "a"] == [("a", "trigger", 1, 3), ("a", "trigger", 2, 6), ("a", "trigger", 3, 1)]
    deliver([("b", day(20))])
    last = deliver([("b", day(21))])
    assert [r for r in last if r[1] == "idle" and r[0] == "a"] == [("a", "idle", 3, 1)]
    assert ("a", "trigger", 1, 0) in deliver([("a", day(21))] * 5)  # forgotten: counted from the start

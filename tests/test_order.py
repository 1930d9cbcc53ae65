"""Numbers within groups, dealt by stretches."""

from strandworks.functions.order import with_number


def test_numbers_within_groups(spark):
    rows = [(k * 7 % 1009, None if k % 10 == 0 else "hot" if k % 3 else f"g{k % 5}") for k in range(1009)]
    got = {r["k"]: r["n"] for r in with_number(spark.createDataFrame(rows, "k long, g string").repartition(7), "g", "k", "n").collect()}
    want, seen = {}, {}
    for k, g in sorted(rows, key=lambda r: r[0]):
        want[k] = seen[g] = seen.get(g, 0) + 1
    assert got == want


def test_numbers_of_no_rows(spark):
    assert with_number(spark.createDataFrame([], "k long, g string"), "g", "k", "n").collect() == []

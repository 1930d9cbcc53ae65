import pytest

from strandworks.operators import headers


@pytest.mark.parametrize(
    "used,want",
    [
        ([v for v in range(0, 2501) if v not in (2100, 2300)], [2100, 2300, 2501, 2502, 2503]),
        (list(range(1, 4001)), [4001, 4002, 4003, 4004, 4005]),
        ([3, 3, 10, -7, 2**31 - 1], [1, 2, 4, 5, 6]),
        ([], [1, 2, 3, 4, 5]),
        ([None, 1], [2, 3, 4, 5, 6]),
    ],
)
def test_absent_values_have_no_bound(spark, used, want):
    df = spark.createDataFrame([(v,) for v in used], "value long")
    assert [r[0] for r in headers.absent(df, 5).collect()] == want

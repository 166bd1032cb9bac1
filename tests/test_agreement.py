import math

import pytest
from nichegrid.operators import agreement
from pyspark.sql import functions as F


def expected(xs, ys):
    """The mean over all overlaps that can be, by log-factorials."""
    total, f, out = sum(xs), lambda n: math.lgamma(n + 1), 0.0
    for x in xs:
        for y in ys:
            for n in range(max(1, x + y - total), min(x, y) + 1):
                p = f(x) + f(y) + f(total - x) + f(total - y) - f(total) - f(n) - f(x - n) - f(y - n) - f(total - x - y + n)
                out += n / total * math.log(n * total / (x * y)) * math.exp(p)
    return out


def labelled(spark, xs, ys):
    """Rows with these margins, the labels of b dealt without regard to those of a."""
    a = [i for i, n in enumerate(xs) for _ in range(n)]
    b = [i for i, n in enumerate(ys) for _ in range(n)]
    step = next(s for s in range(len(b) // 3 + 1, len(b) + 2) if math.gcd(s, len(b)) == 1)
    return spark.createDataFrame([(x, b[i * step % len(b)]) for i, x in enumerate(a)], "a long, b long")


@pytest.mark.parametrize(
    "xs, ys",
    [([1], [1]), ([5, 1], [3, 3]), ([2, 2, 2], [1] * 6), ([40, 60], [99, 1]), ([3000, 2000, 1], [2500, 2501]), ([4990, 5, 5], [4000, 990, 10]), ([700] * 7, [1225] * 4)],
)
def test_expected_information(spark, xs, ys):
    """Also where overlaps far from their mean are left out."""
    got = agreement.expected_information(labelled(spark, xs, ys)).first()["emi"]
    assert got == pytest.approx(expected(xs, ys), rel=1e-9, abs=1e-12)


def test_terms_grow_with_the_root_of_the_rows(spark):
    """Labellings of a million rows: the expected information is nearly (r - 1)(c - 1) / 2N."""
    rows = spark.range(1_000_000).select((F.col("id") % 4).alias("a"), (F.xxhash64("id") % 3).alias("b"))
    assert agreement.expected_information(rows).first()["emi"] == pytest.approx(3 * 4 / 2e6, rel=1e-3)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "a long, b long")
    assert agreement.expected_information(rows).first()["emi"] == 0
    assert agreement.adjusted_information(rows).first()["ami"] == 1

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import order, stats


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_numbers_of_rows(spark, n):
    ids = random.Random(n).sample(range(-(10**12), 10**12), n)
    got = order.numbered(spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5), F.col("id"), "nth").collect()
    assert {r.id: r.nth for r in got} == {i: k for k, i in enumerate(sorted(ids), 1)}


def test_ranges_are_even_and_in_order(spark):
    df = spark.range(20000).select((F.col("id") * 1.5).alias("x"))
    place, n = order.ranges(df, F.col("x"))
    sizes = df.select(place.alias("r"), "x").groupBy("r").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("r").collect()
    assert len(sizes) == n == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(s.n for s in sizes) < 2 * 20000 / n and all(a.hi < b.lo for a, b in zip(sizes, sizes[1:], strict=False))


def test_nulls_are_first_and_nan_last(spark):
    rows = [(1.0, 1), (None, 2), (math.nan, 4), (math.inf, 8), (-0.5, 16)]
    got = order.running_sum(spark.createDataFrame(rows, "x double, n int"), F.col("x"), F.col("n"), "upto").collect()
    assert {r.n: r.upto for r in got} == {2: 2, 16: 18, 1: 19, 8: 27, 4: 31}


def test_empirical_distribution_with_a_hot_value(spark):
    draw = random.Random(3)
    values = [draw.choice([5, draw.randrange(1000)]) for _ in range(3000)]
    got = stats.empirical_distribution(spark.createDataFrame([(v,) for v in [*values, None]], "v int"), "v").collect()
    assert {r.v: (r.n, r.share) for r in got} == {v: (values.count(v), sum(x <= v for x in values) / 3000) for v in set(values)}
    assert stats.empirical_distribution(spark.createDataFrame([(None,)], "v int"), "v").collect() == []

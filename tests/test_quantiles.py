"""Quantiles by narrowing against Spark's exact percentile."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import features, metrics, quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def made(rnd, n):
    heavy = lambda: rnd.choice([1.0, 1.0, 2.0, rnd.random()])
    return [(rnd.gauss(0, 1), heavy(), rnd.randint(0, 3), 10.0 ** rnd.randint(-300, 300), None if i % 3 else rnd.random(), float("nan") if i % 5 == 0 else float(i)) for i in range(n)]


@pytest.mark.parametrize("few", [1, 50, 20_000])
def test_all_columns_narrow_to_the_exact_values(spark, few):
    columns = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(made(random.Random(few), 3000), "a double, b double, c int, d double, e double, f double").repartition(6).cache()
    got = quantiles.quantiles(df, columns, SHARES, few)
    for c in columns:
        rows = df.filter(~F.isnan(F.col(c).cast("double")))
        want = rows.agg(F.percentile(c, F.array(*map(F.lit, SHARES)))).first()[0]
        assert got[c] == pytest.approx(want, rel=1e-12, abs=1e-300), c
    df.unpersist()


def test_sizes_near_nothing(spark):
    df = spark.createDataFrame([(1.0, None, 7)], "x double, none double, y int")
    assert quantiles.quantiles(df, ["x", "none", "y"], [0.25, 0.5]) == {"x": [1.0, 1.0], "none": [None, None], "y": [7.0, 7.0]}
    assert quantiles.quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert quantiles.quantiles(two, ["x"], [0.25, 0.5], few=1) == {"x": [1.25, 1.5]}
    assert quantiles.ranked_values(two, [("x", 0), ("x", 1), ("x", 2)]) == {("x", 0): 1.0, ("x", 1): 2.0, ("x", 2): None}


def test_scaling_and_description_keep_their_results(spark):
    df = spark.createDataFrame([(float(i % 7), 5.0, None) for i in range(100)], "x double, same double, none double")
    q = features.fit_robust(df, ["x", "same", "none"]).first()
    assert list(q.x) == [1.0, 3.0, 5.0] and list(q.same) == [5.0] * 3 and q.none is None
    scaled = features.robust_scale(df, features.fit_robust(df, ["x", "same"]), ["x", "same"])
    assert {r.same for r in scaled.collect()} == {0.0} and scaled.agg(F.max("x")).first()[0] == 0.75
    told = metrics.describe(df, "x").first()
    assert (told.n, told.q1, told.median, told.q3, told.most) == (100, 1.0, 3.0, 5.0, 6.0)

"""Least squares against numpy, where normal equations fail too, and kernel ridge against its dual."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import regress


def frame(spark, columns, parts=5):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns)).repartition(parts)


def dense(x, y):
    """Coefficients, errors and sum of squares by numpy's own QR in one piece."""
    a = np.column_stack([np.ones(len(y)), x])
    q, r = np.linalg.qr(a)
    b = np.linalg.solve(r, q.T @ y)
    left = float(((y - a @ b) ** 2).sum())
    inverse = np.linalg.inv(r)
    return b, np.sqrt(left / (len(y) - a.shape[1]) * (inverse**2).sum(1)), left


def test_nearly_dependent_columns_keep_their_digits(spark):
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=400)
    b = a + 1e-9 * rnd.normal(size=400)
    y = 1 + 2 * a + 3 * b + 1e-12 * rnd.normal(size=400)
    x = np.column_stack([np.ones(400), a, b])
    xx = x.T @ x
    normal = np.linalg.lstsq(xx, x.T @ y, rcond=None)[0]
    assert abs(normal[2] - 3) > 0.1  # products have lost it
    got = regress.ols(frame(spark, {"a": a, "b": b, "y": y}), "y", ["a", "b"])
    want, _, _ = dense(np.column_stack([a, b]), y)
    assert abs(got["b"] - 3) < 1e-2 and abs(got["a"] - want[1]) < 1e-2 and got["r2"] > 0.999999


def test_summary_equals_numpy(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(157, 3)) * [1, 100, 0.01] + [0, 5000, 1]
    y = x @ [0.5, 0.02, -30] + 4 + rnd.normal(size=157)
    df = frame(spark, {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, float("nan"))], df.schema))
    rows, whole = regress.ols_summary(df, "y", ["a", "b", "c"])
    rows, whole = rows.collect(), whole.first()
    b, e, left = dense(x, y)
    spread = ((y - y.mean()) ** 2).sum()
    for r, want, error in zip(rows, b, e):
        assert r.coefficient == pytest.approx(want, rel=1e-9) and r.error == pytest.approx(error, rel=1e-9) and r.t == pytest.approx(want / error, rel=1e-8)
        assert r.low < r.coefficient < r.high and (r.high - r.low) / 2 / r.error == pytest.approx(1.975590, abs=1e-5)  # t of 153 at 2.5 %
    assert [r.name for r in rows] == ["const", "a", "b", "c"] and (whole.n, whole.df_model, whole.df_resid) == (157, 3, 153)
    assert whole.r2 == pytest.approx(1 - left / spread) and whole.adjusted_r2 == pytest.approx(1 - left / 153 / (spread / 156))
    assert whole.f == pytest.approx((spread - left) / 3 / (left / 153)) and whole.aic == pytest.approx(157 * (math.log(2 * math.pi * left / 157) + 1) + 8)


def test_tails():
    # exact forms: t with 1 and 2 degrees, F with 2 and 2
    for t in (0.1, 1.0, 3.0, 40.0):
        assert regress.t_tail(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-12)
        assert regress.t_tail(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)
        assert regress.f_tail(t, 2, 2) == pytest.approx(1 / (1 + t), rel=1e-12)
        assert regress.t_quantile(regress.t_tail(t, 7), 7) == pytest.approx(t, rel=1e-9)
    assert regress.t_tail(2.0, 10**6) == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-5)


def test_dependent_columns_few_rows_and_none(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1) for i in range(10)], "a double, b double, y double")
    rows, whole = regress.ols_summary(df, "y", ["a", "b"])
    assert whole.first().df_model == 1 and sum(r.coefficient * {"const": 0, "a": 1, "b": 2}[r.name] for r in rows.collect()) == pytest.approx(3)
    rows, whole = regress.ols_summary(df.limit(2), "y", ["a"])
    assert whole.first().df_resid == 0 and all(r.error is None for r in rows.collect())
    rows, whole = regress.ols_summary(df.limit(0), "y", ["a"])
    assert whole.first().n == 0
    assert regress.triangle(df.limit(0), [F.col("a")])[1] == 0


def test_influence_equals_the_hat_matrix(spark):
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=(40, 2)), rnd.normal(size=40)
    a = np.column_stack([np.ones(40), x])
    hat = a @ np.linalg.inv(a.T @ a) @ a.T
    residual = y - hat @ y
    s2, h = residual @ residual / 37, np.diag(hat)
    df = frame(spark, {"nth": np.arange(40), "a": x[:, 0], "b": x[:, 1], "y": y})
    for r in regress.influence(df, "y", ["a", "b"]).collect():
        i = int(r.nth)
        assert r.residual == pytest.approx(residual[i], abs=1e-10) and r.leverage == pytest.approx(h[i], abs=1e-12)
        assert r.cooks_d == pytest.approx(residual[i] ** 2 / (3 * s2) * h[i] / (1 - h[i]) ** 2, rel=1e-8)


@pytest.mark.parametrize("degree, gamma, shift, strength", [(3, None, 1.0, 1.0), (2, 0.7, 0.5, 0.1), (1, 1.0, 2.0, 3.0)])
def test_kernel_ridge_equals_its_dual_solution(spark, degree, gamma, shift, strength):
    rnd = np.random.default_rng(4)
    x, y = rnd.normal(size=(60, 3)), rnd.normal(size=60)
    g = 1 / 3 if gamma is None else gamma
    kernel = (g * x @ x.T + shift) ** degree
    dual = np.linalg.solve(kernel + strength * np.eye(60), y)
    asked = rnd.normal(size=(20, 3))
    want = (g * asked @ x.T + shift) ** degree @ dual
    weights = regress.fit_kernel_ridge(frame(spark, {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}), "y", ["a", "b", "c"], strength, degree, gamma, shift)
    rows = frame(spark, {"nth": np.arange(20), "a": asked[:, 0], "b": asked[:, 1], "c": asked[:, 2]})
    rows = rows.withColumn("features", F.lit("kept"))
    got = regress.predict_kernel_ridge(rows, weights, ["a", "b", "c"], degree, gamma, shift).collect()
    assert all(abs(r.prediction - want[int(r.nth)]) < 1e-8 and r.features == "kept" for r in got)
    none = spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double")
    assert regress.predict_kernel_ridge(none, weights, ["a", "b", "c"], degree, gamma, shift).first().prediction is None

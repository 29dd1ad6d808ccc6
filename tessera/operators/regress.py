"""Least squares by orthogonal triangles, influence, and ridge on a polynomial kernel.

A tall matrix is reduced to the triangle of its QR decomposition: each task
folds its rows, in blocks, into one triangle of as many rows as there are
columns; some tasks fold the triangles of many; and what is left is folded on
the driver. Products of columns are never formed, so columns that are nearly
dependent keep the digits that normal equations lose. Only triangles move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import free_name

BLOCK = 4096  # rows folded at once


def ols_single(df: DataFrame, y: Column, x: Column) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def _folded(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The triangle of all rows of the batches, in one row, and the number of rows."""
    top, rows = np.zeros((0, width)), 0
    for batch in batches:
        at = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        rows += int(np.sum(batch.column(1).to_numpy(zero_copy_only=False)))
        for i in range(0, len(at), BLOCK):
            top = np.linalg.qr(np.vstack([top, at[i : i + BLOCK]]), mode="r")
    if len(top):
        yield pa.RecordBatch.from_arrays([pa.array([top.ravel()], pa.list_(pa.float64())), pa.array([rows], pa.int64())], names=["r", "n"])


def triangle(df: DataFrame, columns: list[Column]) -> tuple[np.ndarray, int]:
    """R of the QR decomposition of the columns, and the number of rows; rows with a NULL or NaN are left out."""
    width = len(columns)
    values = [c.cast("double") for c in columns]
    whole = F.array(*values)
    right = df.select(whole.alias("r"), F.lit(1).cast("bigint").alias("n")).filter(~F.exists("r", lambda x: x.isNull() | F.isnan(x)))
    fold = lambda rows: rows.mapInArrow(lambda batches: _folded(batches, width), "r array<double>, n bigint")
    tasks = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    told = fold(fold(right).repartition(tasks)).collect()  # a triangle for each of these tasks
    top = np.zeros((0, width))
    for row in told:
        top = np.linalg.qr(np.vstack([top, np.array(row.r).reshape(-1, width)]), mode="r")
    full = np.zeros((width, width))
    full[: len(top)] = top
    return full, sum(row.n for row in told)


def _fitted(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Coefficients (constant first), triangle of the constant and the variables, last column of the whole triangle, and rows."""
    r, n = triangle(df, [F.lit(1.0), *(F.col(c) for c in xs), F.col(y)])
    k = len(xs) + 1
    return np.linalg.lstsq(r[:k, :k], r[:k, k], rcond=None)[0], r[:k, :k], r[:, k], n


def ols(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients by name (``const`` first) and r2."""
    beta, top, right, _ = _fitted(df, y, xs)
    left = _left_over(top, beta, right)
    spread = float((right[1:] ** 2).sum())
    return dict(zip(["const", *xs], beta.tolist())) | {"r2": 1 - left / spread if spread else float("nan")}


def _left_over(top: np.ndarray, beta: np.ndarray, right: np.ndarray) -> float:
    """Sum of squared residuals."""
    k = len(beta)
    return float(right[k] ** 2 + ((right[:k] - top @ beta) ** 2).sum())


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * total / a


def t_tail(t: float, freedom: int) -> float:
    """Probability of a Student t at least as far from 0."""
    return _beta_share(freedom / 2, 0.5, freedom / (freedom + t * t))


def f_tail(f: float, between: int, within: int) -> float:
    """Probability of an F at least as large."""
    return _beta_share(within / 2, between / 2, within / (within + between * f))


def t_quantile(tail: float, freedom: int) -> float:
    """The t that has ``tail`` outside of it on both sides together."""
    low, high = 0.0, 1.0
    while t_tail(high, freedom) > tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, freedom) > tail else (low, mid)
    return (low + high) / 2


def ols_summary(df: DataFrame, y: str, xs: list[str], confidence: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Fit with a constant: a row for each coefficient (name, coefficient, error, t, p, low, high), and one row about the whole.

    The whole has n, df_model, df_resid, r2, adjusted_r2, f, f_p, log_likelihood,
    aic, bic and condition. Dependent columns share their effect (least norm) and
    count by the rank. Without rows to spare errors are NULL.
    """
    spark = df.sparkSession
    beta, top, right, n = _fitted(df, y, xs)
    left, spread = _left_over(top, beta, right), float((right[1:] ** 2).sum())
    singular = np.linalg.svd(top, compute_uv=False)
    rank = int((singular > singular.max(initial=0) * 1e-13).sum())
    free, model = n - rank, rank - 1
    s2 = left / free if free > 0 else float("nan")
    inverse = np.linalg.pinv(top, rcond=1e-13)
    errors = np.sqrt(s2 * (inverse**2).sum(axis=1))
    edge = t_quantile(1 - confidence, free) if free > 0 else float("nan")
    rows = []
    for name, b, e in zip(["const", *xs], beta.tolist(), errors.tolist()):
        t = b / e if e else float("nan")
        rows.append((name, b, e, t, t_tail(t, free) if free > 0 and e else float("nan"), b - edge * e, b + edge * e))
    blank = lambda row: tuple(None if isinstance(v, float) and not math.isfinite(v) else v for v in row)
    r2 = 1 - left / spread if spread else float("nan")
    f = (spread - left) / model / s2 if model > 0 and s2 else float("nan")
    likelihood = -n / 2 * (math.log(2 * math.pi * left / n) + 1) if n and left > 0 else float("nan")
    whole = (
        n, model, free, r2, 1 - (1 - r2) * (n - 1) / free if free > 0 else float("nan"), f, f_tail(f, model, free) if math.isfinite(f) else float("nan"),
        likelihood, 2 * rank - 2 * likelihood, math.log(n) * rank - 2 * likelihood if n else float("nan"), float(singular.max(initial=0) / singular.min(initial=np.inf)) if singular.min(initial=0) > 0 else float("nan"),
    )
    about = "n bigint, df_model bigint, df_resid bigint, r2 double, adjusted_r2 double, f double, f_p double, log_likelihood double, aic double, bic double, condition double"
    return (
        spark.createDataFrame([blank(r) for r in rows], "name string, coefficient double, error double, t double, p double, low double, high double"),
        spark.createDataFrame([blank(whole)], about),
    )


def influence(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Rows with ``residual``, ``leverage`` and ``cooks_d``. Only a triangle of the variables' size reaches the driver."""
    beta, top, right, n = _fitted(df, y, xs)
    inverse, k = np.linalg.pinv(top, rcond=1e-13), len(xs) + 1
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    fitted = sum((F.lit(float(b)) * c for b, c in zip(beta, columns)), F.lit(0.0))
    # the leverage is the squared length of a row in the basis of the triangle
    along = (sum((F.lit(float(inverse[i, j])) * columns[i] for i in range(k)), F.lit(0.0)) for j in range(k))
    leverage = sum((a * a for a in along), F.lit(0.0))
    s2 = max(_left_over(top, beta, right) / max(1, n - k), 1e-300)
    out = df.withColumn("residual", F.col(y).cast("double") - fitted).withColumn("leverage", leverage)
    return out.withColumn("cooks_d", F.pow("residual", 2) / (k * s2) * F.col("leverage") / F.pow(1 - F.col("leverage"), 2))


def partial_slope(df: DataFrame, y: str, x: str, others: list[str]) -> DataFrame:
    """Slope of y on x when both are freed of the others: residuals regressed on residuals."""
    first, second = ols(df, y, others), ols(df, x, others)
    free = lambda c, b: F.col(c).cast("double") - sum((F.lit(b[o]) * F.col(o) for o in others), F.lit(b["const"]))
    return ols_single(df, free(y, first), free(x, second))


def kernel_features(xs: list[str], degree: int = 3, gamma: float | None = None, shift: float = 1.0) -> list[Column]:
    """The feature map of the kernel (gamma * x.z + shift) ** degree: its products are the kernel's values.

    One column for each monomial of at most ``degree`` factors, weighted by the
    root of its multinomial coefficient and of the powers of gamma and shift.
    """
    gamma = 1 / len(xs) if gamma is None else gamma
    out = []
    for order in range(degree + 1):
        for factors in combinations_with_replacement(range(len(xs)), order):
            times = [factors.count(i) for i in range(len(xs))]
            ways = math.factorial(degree) // math.prod(map(math.factorial, [degree - order, *times]))
            weight = math.sqrt(ways * shift ** (degree - order) * gamma**order)
            column = F.lit(weight)
            for i in factors:
                column = column * F.col(xs[i]).cast("double")
            out.append(column)
    return out


def fit_kernel_ridge(df: DataFrame, y: str, xs: list[str], strength: float = 1.0, degree: int = 3, gamma: float | None = None, shift: float = 1.0) -> list[float]:
    """Weights of the feature map whose predictions are the kernel ridge's; no constant is added.

    Ridge is solved as least squares with rows of root strength below the
    triangle. There are (variables + degree over degree) weights, however many
    rows; rows with a NULL are left out.
    """
    features = kernel_features(xs, degree, gamma, shift)
    r, _ = triangle(df, [*features, F.col(y)])
    k = len(features)
    below = np.vstack([r[:k, :k], math.sqrt(strength) * np.eye(k)])
    return np.linalg.lstsq(below, np.concatenate([r[:k, k], np.zeros(k)]), rcond=None)[0].tolist()


def predict_kernel_ridge(df: DataFrame, weights: list[float], xs: list[str], degree: int = 3, gamma: float | None = None, shift: float = 1.0, out: str = "prediction") -> DataFrame:
    """``df`` with the prediction, NULL where a variable is; an expression, so nothing is shuffled."""
    features = free_name(df, "features")
    told = df.withColumn(features, F.array(*kernel_features(xs, degree, gamma, shift)))
    terms = (F.col(features)[i] * F.lit(w) for i, w in enumerate(weights))
    return told.withColumn(out, sum(terms, F.lit(0.0))).drop(features)

"""Metrics of regression and classification, each one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .quantiles import quantiles


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """mse, rmse, mae and r2 in one pass."""
    y, p = F.col(truth), F.col(predicted)
    error = F.avg(F.pow(y - p, 2))
    return df.agg(error.alias("mse"), F.sqrt(error).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), (1 - error / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"))


def classification_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and f1; a ratio without cases is 0."""
    of = lambda y, p: F.count_if((truth == y) & (predicted == p))
    counts = df.agg(of(False, False).alias("tn"), of(False, True).alias("fp"), of(True, False).alias("fn"), of(True, True).alias("tp"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.select(
        "tn", "fp", "fn", "tp",
        zero(ratio(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
        zero(ratio(tp, tp + fp)).alias("precision"),
        zero(ratio(tp, tp + fn)).alias("recall"),
        zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def log_loss(df: DataFrame, truth: Column, probability: Column, eps: float = 2.220446049250313e-16) -> DataFrame:
    p = F.least(F.greatest(probability, F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.when(truth, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, extremes and exact quartiles."""
    q1, median, q3 = (F.lit(q).cast("double") for q in quantiles(df, [column], [0.25, 0.5, 0.75])[column])
    told = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("least"), F.max(column).alias("most"))
    return told.select("n", "mean", "sd", "least", q1.alias("q1"), median.alias("median"), q3.alias("q3"), "most")


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, and the values that are there in each column."""
    return df.agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"n_{c}") for c in df.columns))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)

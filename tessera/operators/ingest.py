"""Incremental ingest: what is new, what failed and what to try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet, one for each key."""
    return incoming.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def failures(log: DataFrame, key: str, failed: Column, succeeded: Column, order: str, reason: str) -> DataFrame:
    """attempts, last_at and last_reason of keys that failed and didn't succeed later: one aggregate by key."""
    at = F.col(order)
    state = log.groupBy(key).agg(
        F.count_if(failed).alias("attempts"), F.max(F.when(failed, at)).alias("last_at"),
        F.max_by(F.substring(F.col(reason).cast("string"), 1, 240), F.when(failed, at)).alias("last_reason"), F.max(F.when(succeeded, at)).alias("_done"),
    )
    return state.filter((F.col("attempts") > 0) & (F.col("_done").isNull() | (F.col("_done") < F.col("last_at")))).drop("_done")


def stored_attempts(value: Column) -> Column:
    """Attempts as they stand in a file: a whole number, 1 where there is none or less."""
    return F.greatest(F.coalesce(F.trim(value).try_cast("int"), F.lit(1)), F.lit(1))


def retry_pick(state: DataFrame, key: str, most_attempts: int, remaining: int, batch: int = 20) -> DataFrame:
    """Failures to try again: fewest attempts first."""
    return state.filter(F.col("attempts") < most_attempts).orderBy("attempts", key).limit(min(batch, remaining))


def candidates(retry: DataFrame, fresh: DataFrame, key: str, cap: int) -> DataFrame:
    """Retries, then fresh keys that aren't among them, up to the cap."""
    rest = fresh.select(key).distinct().join(retry.select(key), key, "left_anti")
    both = retry.select(key, F.lit(0).alias("priority")).unionByName(rest.withColumn("priority", F.lit(1)))
    return both.orderBy("priority", key).limit(cap)


def listing_status(image_count: Column, error: Column, least: int = 2) -> Column:
    return F.when(error.isNotNull(), "failed").when(image_count < least, "low_quality").otherwise("ok")


def request_stats(responses: DataFrame, status: str = "status") -> DataFrame:
    return responses.agg(F.count("*").alias("responses"), F.count_if(F.col(status) == 503).alias("status_503"), F.count_if(F.col(status) == 429).alias("status_429"))


def next_delay(delay: float, many_503: bool, least: float = 1.0, most: float = 5.0) -> float:
    """Seconds between pages: longer after refusals, else slowly shorter."""
    return min(most, delay * 1.5) if many_503 else max(least, delay * 0.9)

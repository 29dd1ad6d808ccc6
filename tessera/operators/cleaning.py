"""Cleaning of listings and their images: filters, outliers, repairs, counts and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as NULL in all floating columns, so that comparisons drop what pandas drops."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in floats})


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=subset)


def with_zscore(df: DataFrame, column: str, out: str = "zscore") -> DataFrame:
    """Population z-score; NULL for a constant column. One aggregate row is broadcast."""
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    scored = df.crossJoin(F.broadcast(stats)).withColumn(out, (F.col(column) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    return scored.drop("_mean", "_sd")


def outlier_cut(df: DataFrame, column: str, most: float = 3.0) -> DataFrame:
    return with_zscore(df, column, "_z").filter(F.abs("_z") <= most).drop("_z")


def outliers(df: DataFrame, column: str, most: float = 3.0) -> DataFrame:
    return with_zscore(df, column, "_z").filter(F.abs("_z") > most).drop("_z")


def not_equal(column: Column, value) -> Column:
    """Inequality that keeps NULL, as pandas does."""
    return ~column.eqNullSafe(F.lit(value))


def drop_keys(df: DataFrame, key: str, keys: DataFrame | list) -> DataFrame:
    """Rows whose key isn't listed; a NULL key stays. ``keys`` is a frame that has the key, or a list for a few."""
    if not isinstance(keys, DataFrame):
        kind = df.schema[key].dataType.simpleString()
        keys = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in keys], f"`{key}` {kind}"))
    return df.join(keys.select(key), key, "left_anti").select(*df.columns)


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, least: int = 1) -> DataFrame:
    """Parents that have at least so many children."""
    keys = children.groupBy(F.col(child_key).alias(parent_key)).count().filter(F.col("count") >= least) if least > 1 else children.select(F.col(child_key).alias(parent_key))
    return parents.join(keys, parent_key, "left_semi")


def of_parents(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def fill_coordinates(listings: DataFrame, places: DataFrame) -> DataFrame:
    """Both coordinates from the table of addresses where either is missing; of a repeated address the smallest pair."""
    whole = places.filter("latitude is not null and longitude is not null").select("address", F.struct("latitude", "longitude").alias("at"))
    known = whole.groupBy("address").agg(F.min("at").alias("at")).select("address", F.col("at.latitude").alias("_lat"), F.col("at.longitude").alias("_lon"))
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    joined = listings.join(known, "address", "left")
    filled = joined.withColumns({"latitude": F.when(missing, F.col("_lat")).otherwise(F.col("latitude")), "longitude": F.when(missing, F.col("_lon")).otherwise(F.col("longitude"))})
    return filled.select(*listings.columns)


def clean_listings(listings: DataFrame, images: DataFrame, least_images: int = 5, price: str = "price_man_yen") -> tuple[DataFrame, DataFrame]:
    """Complete listings with enough images, repaired and without price outliers, and their images."""
    kept = nan_to_null(listings).dropna("any").filter(F.col("image_count") >= least_images)
    kept = kept.withColumn("floors_total", numeric.fix_floating(F.col("floor_number"), F.col("floors_total")))
    layout = text.parse_layout(F.col("layout"))
    kept = kept.withColumns({"rooms_num": layout["rooms_num"], "base_layout": layout["base_layout"]}).drop("layout")
    kept = outlier_cut(kept, price)
    return kept, of_parents(images, kept, "source_id", "source_id")

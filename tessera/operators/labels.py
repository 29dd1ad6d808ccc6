"""Human labels over images: overlay, upsert and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ingest


def _settled(rows: DataFrame) -> list[Column]:
    """An order by all columns, so that what comes first doesn't depend on partitions."""
    return [F.col(c).desc_nulls_last() for c, kind in rows.dtypes if "map<" not in kind]


def overlay(rows: DataFrame, labels: DataFrame, key: str, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows with the labels of their key, empty where there are none; an empty key has none.

    The first row of each key in ``order`` is the label that counts; without an
    order all columns settle it.
    """
    known = labels.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    known = ingest.last_wins(known, [key], order or _settled(labels))
    known = known.select(key, *(F.col(c).cast("string").alias(f"_{c}") for c in columns))
    base = {c: F.col(c).cast("string") if c in rows.columns else F.lit("") for c in columns}
    joined = rows.join(known, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), base[c], F.lit("")) for c in columns}).drop(*(f"_{c}" for c in columns))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Table with changed rows in place of those of equal key; columns missing on either side are empty.

    Of changes with equal keys the first in ``order`` counts; without an order
    all their columns settle it, so the result doesn't depend on partitions.
    """
    changes = ingest.last_wins(changes, [key], order or _settled(changes))
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def first_unlabelled(rows: DataFrame, label: Column, order: str, start: int = 0) -> DataFrame:
    """First row without a label at or after ``start``, else from the beginning."""
    return rows.filter(F.trim(F.coalesce(label, F.lit(""))) == "").orderBy((F.col(order) < start).cast("int"), order).limit(1)


def progress(rows: DataFrame, label: Column) -> DataFrame:
    done = F.count_if(F.trim(F.coalesce(label, F.lit(""))) != "")
    return rows.agg(done.alias("labelled"), F.count("*").alias("total"), (done / F.nullif(F.count("*"), F.lit(0))).alias("share"))


def choices(rows: DataFrame, column: str) -> DataFrame:
    """Distinct labels in use, sorted."""
    used = F.trim(F.col(column))
    return rows.filter(used != "").select(used.alias(column)).distinct().orderBy(column)

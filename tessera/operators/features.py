"""Features of the price model. Fitted state is a small table of parameters, one row or one row a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric
from ..session import cut, free_name
from .quantiles import quantiles

PERIODS = ("pre 1981", "1981 to 2000", "post 2000")
LAYOUTS = ("R", "K", "DK", "LDK")


def building_period(year: Column) -> Column:
    return numeric.cut(year, [0, 1980, 2000], list(PERIODS))


def fit_robust(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: exact quartiles of each column, NULL for a column without values."""
    found = quantiles(df, columns, [0.25, 0.5, 0.75])
    row = [None if found[c][0] is None else found[c] for c in columns]
    return df.sparkSession.createDataFrame([row], ", ".join(f"`{c}` array<double>" for c in columns))


def robust_scale(df: DataFrame, quartiles: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """(x - median) / (q3 - q1); a range of 0 counts as 1."""
    renamed = quartiles.select(*(F.col(c).alias(f"_q_{c}") for c in columns))
    spread = lambda c: F.coalesce(F.nullif(F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0], F.lit(0.0)), F.lit(1.0))
    scaled = df.crossJoin(F.broadcast(renamed)).withColumns({f"{prefix}{c}": (F.col(c) - F.col(f"_q_{c}")[1]) / spread(c) for c in columns})
    return scaled.drop(*renamed.columns)


def fit_target_encoding(df: DataFrame, category: str, target: str) -> DataFrame:
    """Encoding of each category, shrunk to the mean by its own and the whole variance."""
    whole = df.filter(F.col(target).isNotNull()).agg(F.avg(target).alias("_mean"), F.var_pop(target).alias("_var"))
    by = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count(target).alias("n"), F.avg(target).alias("mean"), F.var_pop(target).alias("var"))
    share = F.coalesce(F.col("n") * F.col("_var") / F.nullif(F.col("n") * F.col("_var") + F.col("var"), F.lit(0.0)), F.lit(1.0))
    return by.crossJoin(F.broadcast(whole)).select(category, "n", (share * F.col("mean") + (1 - share) * F.col("_mean")).alias("encoding"))


def target_encode(df: DataFrame, encoding: DataFrame, category: str, default: Column, out: str) -> DataFrame:
    """Encoded category; ``default`` (the mean of training) for those not seen. Spark broadcasts the table if it is small."""
    return df.join(encoding.select(category, F.col("encoding").alias(out)), category, "left").withColumn(out, F.coalesce(F.col(out), default))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """NULL as the most frequent value, the smallest of equals."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    mode = counts.agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("_mode"))
    return df.crossJoin(F.broadcast(mode)).withColumn(column, F.coalesce(F.col(column), F.col("_mode"))).drop("_mode")


def ordinal(column: Column, categories: tuple[str, ...]) -> Column:
    """Place in the list, -1 for others."""
    out = F.when(column == categories[0], 0)
    for i, c in enumerate(categories[1:], 1):
        out = out.when(column == c, i)
    return out.otherwise(-1)


def split_by_hash(df: DataFrame, key: str, test_share: float = 0.3) -> DataFrame:
    """``is_test`` for exactly the ceiling of the share of rows, those of smallest md5 of the key.

    The rank at which training begins is found from counts of leading md5
    digits, so that only the rows of one bucket are ranked, and never all rows
    in one task.
    """
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 4))
    counts = dict(hashed.groupBy("_b").count().collect())  # 65,536 rows at most
    need, total, edge = 0, sum(counts.values()), ""
    need = int(-(-total * round(test_share * 1e9) // 1e9)) if total else 0
    for b in sorted(counts):
        edge = b
        if counts[b] >= need:
            break
        need -= counts[b]
    nth = F.row_number().over(W.partitionBy("_b").orderBy("_h", key))
    inside = hashed.filter(F.col("_b") == edge).withColumn("is_test", nth <= need)
    outside = hashed.filter(F.col("_b") != edge).withColumn("is_test", F.col("_b") < edge)
    return outside.unionByName(inside).drop("_h", "_b")


def fold_ids(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """``fold`` of contiguous, unshuffled folds in the order of the key; the first ones are one row larger.

    Rows are counted in ranges of the key, so ranks come from windows over
    ranges, not over the table.
    """
    nth = free_name(df, "nth")
    ranked = global_rank(df, [F.col(key)], nth)
    total = df.count()
    small, larger = divmod(total, folds)
    at = F.col(nth) - 1
    edge = larger * (small + 1)
    fold = F.when(at < edge, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - edge) / F.lit(max(small, 1))))
    return ranked.withColumn("fold", fold.cast("int")).drop(nth)


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1-based rank over all rows: ranges of the order, places in each range, and offsets from the ranges' counts.

    The rows are written once, as other ranges may be drawn when they are made
    again; give keys alone where rows are wide. One row for each range reaches
    the driver and is joined back.
    """
    spark = df.sparkSession
    part, place, first = (free_name(df, n) for n in ("part", "place", "first"))
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    marked = cut(parts.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("bigint"), 33)))
    before, starts = 0, []
    for p, n in sorted(marked.groupBy(part).count().collect()):
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, f"`{part}` int, `{first}` bigint")
    return marked.join(F.broadcast(offsets), part).withColumn(out, F.col(place) + F.col(first) + 1).drop(part, place, first)


def batch_numbers(df: DataFrame, order: list[Column], first: int, size: int) -> DataFrame:
    """``batch``: 0 for the first rows, then batches of equal size."""
    nth = free_name(df, "nth")
    at = F.col(nth)
    return global_rank(df, order, nth).withColumn("batch", F.when(at <= first, 0).otherwise(1 + F.floor((at - first - 1) / size)).cast("int")).drop(nth)


def even_batches(df: DataFrame, order: list[Column], batches: int) -> DataFrame:
    """``batch`` of even batches in the order, from 0; their ends are those of ``batch_cuts``."""
    nth = free_name(df, "nth")
    ends = batch_cuts(df.count(), batches)
    batch = sum(((F.col(nth) > end).cast("int") for end in ends[:-1]), F.lit(0))
    return global_rank(df, order, nth).withColumn("batch", batch).drop(nth)


def batch_cuts(rows: int, batches: int) -> list[int]:
    """Ends of even batches, truncated."""
    return [int(rows / batches + i * (rows - rows / batches) / max(1, batches - 1)) for i in range(batches)]

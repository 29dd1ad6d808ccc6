"""Scores of images: models injected as batch functions, sentinels without inference, means by room."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps
from ..session import free_name
from ..sources import files

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
ATTRIBUTES = ("luxury", "brightness", "condition")
ROOMS = ("bathroom", "bedroom", "kitchen", "living room", "toilet")
FLOOR_PLAN = "floor plan"


def infer(images: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    """Run a model over batches of images. The scorer loads its model once for a task; write the result before filtering by it."""
    return images.mapInPandas(scorer, schema)


def stub_scorer(column: str, attributes: tuple[str, ...] = ATTRIBUTES) -> Scorer:
    """Scores from a hash of path and attribute, where no model is at hand."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import json

        for batch in batches:
            told = [json.dumps({a: int(hashlib.md5(f"{p}{a}".encode()).hexdigest()[:8], 16) / 2**32 for a in attributes}) for p in batch[column]]
            yield batch.assign(scores=told)

    return score


def tolerant(score: Callable[[pd.DataFrame], pd.Series], out: str = "scores", attempts: int = 6, wait: float = 60.0, rows: int = 16, sleep: Callable[[float], None] = time.sleep) -> Scorer:
    """A scorer that outlives failures: a slice of ``rows`` that fails is scored row by row, and a row that fails is tried again, up to ``attempts`` times with growing waits.

    A row that fails to the end gets NULL. A good row is scored twice at most,
    and only where a row of its slice failed.
    """

    def alone(row: pd.DataFrame):
        for nth in range(attempts):
            try:
                return list(score(row))[0]
            except Exception:  # whatever a model or its service raises
                if nth + 1 < attempts:
                    sleep(wait * 2**nth)
        return None

    def told(part: pd.DataFrame) -> list:
        try:
            return list(score(part))
        except Exception:
            return [alone(part.iloc[[i]]) for i in range(len(part))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            scores = [x for at in range(0, len(batch), rows) for x in told(batch.iloc[at : at + rows])]
            yield batch.assign(**{out: pd.Series(scores, dtype=object)})

    return run


# Fixed value: what the guard for stand-in images answers.
DEFAULT_UNSURE = 2


def labelling_scorer(classify: Callable[[pd.DataFrame], list[dict[str, float]]], out: str = "room_type") -> Scorer:
    """The label of largest score for each image, the first of equals in the model's order; NULL where the model fails."""
    best = lambda told: max(told, key=told.get) if told else None
    return tolerant(lambda rows: [best(x) for x in classify(rows)], out, attempts=1)


def default_image_scorer(classify: Callable[[pd.DataFrame], list[int]], out: str = "default_image") -> Scorer:
    """Whether an image is a stand-in: 0, 1, or 2 where the model isn't sure or fails."""
    inner = tolerant(classify, out, attempts=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in inner(batches):
            known = [int(v) if v in (0, 1) else DEFAULT_UNSURE for v in batch[out]]
            yield batch.assign(**{out: known})

    return run


def embedding_scorer(embed: Callable[[pd.DataFrame], list], out: str = "embedding") -> Scorer:
    """The vector of each image at unit length; an empty one where the model fails or gives zeros."""
    inner = tolerant(embed, out, attempts=1)

    def unit(v) -> list[float]:
        x = np.asarray([] if v is None else v, np.float64).ravel()
        length = float(np.sqrt((x**2).sum()))
        return (x / length).astype(np.float32).tolist() if length and np.isfinite(length) else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in inner(batches):
            yield batch.assign(**{out: pd.Series([unit(v) for v in batch[out]], dtype=object)})

    return run


def score_in_parts(images: DataFrame, path: str, key: str, score: Callable[[DataFrame], DataFrame], parts: int = 16) -> DataFrame:
    """Scores written part by part, so that a later run goes on behind the last whole part.

    The input is dealt once, by the hash of the key, and each part reads its
    own rows alone; a later run must have the same input.
    """
    spark, dealt, part = images.sparkSession, f"{path}/_dealt", free_name(images, "part")
    if not files.exists(spark, f"{dealt}/_SUCCESS"):
        numbered = images.withColumn(part, F.pmod(F.xxhash64(key), F.lit(parts)))
        numbered.repartition(part, F.pmod(F.xxhash64(*(c for c, kind in images.dtypes if "map<" not in kind)), F.lit(8))).write.mode("overwrite").partitionBy(part).parquet(dealt)
    for n in range(parts):
        if not files.exists(spark, f"{path}/p{n}/_SUCCESS"):
            mine = f"{dealt}/{part}={n}"
            rows = spark.read.schema(images.schema).parquet(mine) if files.exists(spark, mine) else images.limit(0)
            score(rows).write.mode("overwrite").parquet(f"{path}/p{n}")
    return spark.read.parquet(*(f"{path}/p{n}" for n in range(parts)))


def score_images(images: DataFrame, scorer: Scorer, schema: str, exists: str = "true", valid: str = "true", keys: tuple[str, ...] = maps.KEYS) -> DataFrame:
    """``scores`` (a JSON map) of each image.

    Only images that need a model reach it: floor plans, missing and invalid
    files get their sentinel by a filter, as a condition around a Python
    function wouldn't keep rows from it. ``schema`` is that of the scorer.
    """
    guard = F.expr(f"CASE WHEN room_type = '{FLOOR_PLAN}' THEN {maps.FLOOR_PLAN} WHEN NOT ({exists}) THEN {maps.MISSING_FILE} WHEN NOT ({valid}) THEN {maps.INVALID_IMAGE} END")
    marked = images.withColumn("_sentinel", guard)
    constant = F.to_json(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array_repeat(F.col("_sentinel").cast("double"), len(keys))))
    skipped = marked.filter("_sentinel is not null").withColumn("scores", constant).drop("_sentinel")
    return infer(marked.filter("_sentinel is null").drop("_sentinel"), scorer, schema).unionByName(skipped)


def to_score(images: DataFrame, done: DataFrame, key: str, keys: tuple[str, ...] = maps.KEYS) -> DataFrame:
    """Images without a complete score among those done."""
    complete = done.filter(maps.is_complete(maps.parse_scores(F.col("scores")), keys)).select(key)
    return images.join(complete, key, "left_anti")


def room_means(scores: DataFrame, key: str, room: str, attributes: list[str]) -> DataFrame:
    """Means of all attributes for each parent and room, in one pass; rows without a key or room are left out."""
    return scores.filter(F.col(key).isNotNull() & F.col(room).isNotNull()).groupBy(key, room).agg(*(F.avg(a).alias(a) for a in attributes))


def pivot_rooms(means: DataFrame, key: str, room: str, attributes: list[str], rooms: tuple[str, ...] = ROOMS) -> DataFrame:
    """One row for each parent with ``<attribute>_<room>`` columns; the rooms are fixed, so the schema is too."""
    one = lambda a, r: F.max(F.when(F.col(room) == r, F.col(a))).alias(f"{a}_{r}".replace(" ", "_"))
    return means.groupBy(key).agg(*(one(a, r) for a in attributes for r in rooms))


def listing_scores(listings: DataFrame, images: DataFrame, key: str, room: str, attributes: list[str], rooms: tuple[str, ...] = ROOMS, least: int = 5, floor_plan: str = FLOOR_PLAN) -> DataFrame:
    """Listings with enough images joined to the mean scores of their rooms.

    One aggregate by parent gives count and means together, so images are
    shuffled once and there is no second pass for the count.
    """
    mean = lambda a, r: F.avg(F.when(F.col(room) == r, F.col(a))).alias(f"{a}_{r}".replace(" ", "_"))
    scored = images.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_images"), F.count(F.when(F.col(room) != floor_plan, 1)).alias("_rooms"), *(mean(a, r) for a in attributes for r in rooms))
    return listings.join(scored.filter((F.col("_images") >= least) & (F.col("_rooms") > 0)).drop("_images", "_rooms"), key)

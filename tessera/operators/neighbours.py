"""Nearest-neighbour regression for all numbers of neighbours in one pass, exact.

Training rows fall into the cell of their nearest pivot. For each cell the
number of its rows, its radius and its smallest distances to the pivot are
known; they bound a query's distance to its ``most``-th neighbour from above, and
its distance to anything in a cell from below. A query is sent to the cells that
may hold a neighbour and to no others, so most pairs are never computed; a
cell's rows are dealt to parts of bounded size, and so are the queries that it
gets. Equal training rows are one row with its number of times; of those that
stand at one point only the ``most`` smallest labels are kept, as the others are
among nobody's nearest, and queries at one point are one query. So the search
grows with the points, not with the rows.

The neighbours' labels, nearest first and smaller labels first among equally
near ones, give the mean of the first k for every k at once.

Defined results: rows or queries with a NULL or NaN feature, and rows with a
NULL label, are left out; queries of equal keys have a result each; with fewer training rows than k the mean is of all of them; no
training rows give no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

PIVOTS = 256
ROWS = 20_000  # rows of a cell that a task holds
QUERIES = 2_000  # queries of a cell that a task holds
BLOCK = 256
SALTS = 8
SLACK = 1e-9  # relative, for rounding in the bounds


def _vector(features: list[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in features))


def _whole(df: DataFrame) -> DataFrame:
    return df.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def _least(train: DataFrame, features: list[str], label: str, most: int) -> DataFrame:
    """x, y and times of the rows of smallest labels at each point: others there are among no query's nearest ``most``.

    The rank's bound is known, so tasks leave few rows of a point before they are shuffled.
    """
    at = [f"x{i}" for i in range(len(features))]
    rows = train.select(*(F.col(f).cast("double").alias(c) for f, c in zip(features, at)), F.col(label).cast("double").alias("y"))
    rows = rows.filter(" and ".join(["y is not null", *(f"{c} is not null and not isnan({c})" for c in at)]))
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy(*at).orderBy("y"))).filter(F.col("n") <= most)
    return ranked.groupBy(*at, "y").agg(F.count("*").alias("times")).select(F.array(*at).alias("x"), "y", "times")


def _dense(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(a, b))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, from differences, not from products."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return out


def _cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the cell and the distance to its pivot of each row."""
    for batch in batches:
        x = _dense(batch.column("x"), pivots.shape[1])
        cell, away = np.zeros(len(x), np.int64), np.zeros(len(x))
        for at in range(0, len(x), BLOCK):
            d = _distances(x[at : at + BLOCK], pivots)
            cell[at : at + BLOCK] = d.argmin(1)
            away[at : at + BLOCK] = d.min(1)
        yield batch, cell, away


class Cells:
    """Rows, radius and smallest distances of each cell; a row for each pivot, so small however many rows there are."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, most: int):
        self.pivots, self.most = pivots, most

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = [np.zeros(0) for _ in pivots]
            count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
            for batch, cell, away in _cells(batches, pivots):
                times = batch.column("times").to_numpy(zero_copy_only=False)
                count += np.bincount(cell, minlength=len(pivots))
                np.maximum.at(radius, cell, away)
                for c in np.unique(cell):
                    mine = np.repeat(away[cell == c], np.minimum(times[cell == c], most))
                    near[c] = np.sort(np.concatenate([near[c], mine]))[:most]
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), pa.array(radius[met]), pa.array([near[c] for c in met], pa.list_(pa.float64()))], names=["cell", "n", "radius", "near"])

        parts = rows.select("x", "times").mapInArrow(told, "cell bigint, n bigint, radius double, near array<double>")
        least = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most)
        by = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), least.alias("near")).collect()
        self.count, self.radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        self.near = np.full((len(pivots), most), np.inf)
        for r in by:
            self.count[r.cell], self.radius[r.cell] = r.n, r.radius
            self.near[r.cell, : len(r.near)] = r.near

    def may_hold(self, x: np.ndarray) -> np.ndarray:
        """For each query, the cells that may hold one of its nearest ``most`` rows."""
        away = _distances(x, self.pivots)
        within = (away[:, :, None] + self.near[None]).reshape(len(x), -1)
        edge = np.partition(within, self.most - 1, axis=1)[:, self.most - 1] if within.shape[1] >= self.most else np.full(len(x), np.inf)
        # no row of a cell is nearer than its rim, nor nearer than half the way past the query's own pivot
        least = np.maximum(away - self.radius, (away - away.min(1, keepdims=True)) / 2)
        slack = SLACK * (1 + away.max(1, keepdims=True))
        return (self.count > 0) & (least <= edge[:, None] + slack)


def _pivots(rows: DataFrame, many: int, width: int) -> np.ndarray:
    """Distinct rows of smallest hash."""
    met = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(many).collect()
    return np.array([r.x for r in met], np.float64).reshape(-1, width)


def nearest(train: DataFrame, asked: DataFrame, features: list[str], label: str, key: str, most: int = 30, pivots: int = PIVOTS, rows_at_once: int = ROWS) -> DataFrame:
    """key, labels (of the ``most`` nearest training rows, nearest first) and compared (rows that were compared) of each query."""
    width = len(features)
    rows = cut(_least(train, features, label, most))
    given = _whole(asked.select(F.col(key).alias("name"), _vector(features).alias("x")))
    name = given.schema["name"].dataType.simpleString()
    # a point is asked for once, by a number, however many queries stand there
    points = cut(given.select("x").distinct().withColumn("key", F.monotonically_increasing_id()))
    queries, kind = points.select("key", "x"), "bigint"
    result = f"key {kind}, d double, y double, times bigint, compared bigint"
    at = _pivots(rows, pivots, width)
    if not len(at):
        return asked.sparkSession.createDataFrame([], f"`{key}` {name}, labels array<double>, compared bigint")
    cells = Cells(rows, at, most)
    parts = [max(1, math.ceil(n / rows_at_once)) for n in cells.count.tolist()]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                query, cell = np.nonzero(cells.may_hold(_dense(some.column("x"), width)))
                yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(query)), some.column("x").take(pa.array(query)), pa.array(cell)], names=["key", "x", "cell"])

    routed = cut(queries.mapInArrow(route, f"key {kind}, x array<double>, cell bigint"))
    asked_of = dict(routed.groupBy("cell").count().collect())  # one row for each cell
    groups = [max(1, math.ceil(asked_of.get(c, 0) / QUERIES)) for c in range(len(at))]
    shape = F.array(*(F.struct(F.lit(p).alias("parts"), F.lit(g).alias("groups")) for p, g in zip(parts, groups)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cell, _ in _cells(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["x", "y", "times", "cell"])

    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    placed = rows.mapInArrow(place, "x array<double>, y double, times bigint, cell bigint").withColumn("shape", F.get(shape, F.col("cell").cast("int")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("shape.parts").cast("bigint")).cast("int")).withColumn("group", F.explode(numbers(F.col("shape.groups")))).drop("shape")
    sent = routed.withColumn("shape", F.get(shape, F.col("cell").cast("int")))
    sent = sent.withColumn("group", F.pmod(F.xxhash64("key"), F.col("shape.groups").cast("bigint")).cast("int")).withColumn("part", F.explode(numbers(F.col("shape.parts")))).drop("shape")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left.column("key").combine_chunks()
        q, x = (_dense(t.column("x").combine_chunks(), width) for t in (left, right))
        y, times = right.column("y").to_numpy(), right.column("times").to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(q) if len(x) else 0, BLOCK):
            d = _squares(q[a : a + BLOCK], x)
            kept = min(most, len(x))
            edge = np.partition(d, kept - 1, axis=1)[:, kept - 1]
            for i in range(len(d)):
                near = np.flatnonzero(d[i] <= edge[i])  # all that are as near as the last
                near = near[np.lexsort((y[near], d[i, near]))][:kept]
                found.append((np.full(len(near), a + i), d[i, near], y[near], times[near]))
        who, d, label, n = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
        first = np.diff(who, prepend=-1) != 0  # rows compared are told once for each query
        return pa.table({"key": keys.take(pa.array(who)), "d": d, "y": label, "times": n, "compared": np.where(first, len(x), 0)})

    by = ("cell", "part", "group")
    met = sent.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(compare, result)
    compared = met.groupBy("key").agg(F.sum("compared").alias("compared"))
    # the rank's bound is known, so tasks keep few rows of a key before they are shuffled
    ranked = met.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("d", "y"))).filter(F.col("n") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("d", "y", F.least("times", F.lit(most)).cast("int").alias("times"))))
    labels = F.slice(F.flatten(F.transform(ordered, lambda s: F.array_repeat(s["y"], s["times"]))), 1, most)
    told = ranked.groupBy("key").agg(labels.alias("labels")).join(compared, "key")
    # dealt by salts too, as many queries may stand at one point
    told = points.join(told, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = given.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")).join(told, ["x", "salt"])
    return met.select(F.col("name").alias(key), "labels", "compared")


def knn_curve(train: DataFrame, asked: DataFrame, features: list[str], label: str, key: str, most: int = 30, pivots: int = PIVOTS) -> DataFrame:
    """key, predictions (the mean label of the k nearest, for k from 1) and compared."""
    near = nearest(train, asked, features, label, key, most, pivots)
    size = F.size("labels")
    running = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.aggregate(F.slice("labels", F.lit(1), k), F.lit(0.0), lambda s, v: s + v) / F.least(k, size))
    return near.select(key, running.alias("predictions"), "compared")


def knn_predict(train: DataFrame, asked: DataFrame, features: list[str], label: str, key: str, k: int = 5) -> DataFrame:
    """Mean label of the k nearest training rows."""
    return knn_curve(train, asked, features, label, key, k).select(key, F.element_at("predictions", -1).alias("prediction"))


def best_k(train: DataFrame, features: list[str], label: str, key: str, fold: str, most: int = 30) -> tuple[int, list[float]]:
    """The k of least mean squared error over given folds, and the error of each k: one search a fold serves all k."""
    sums, rows = np.zeros(most), 0
    for (f,) in train.select(fold).distinct().orderBy(fold).collect():
        inside, outside = train.filter(F.col(fold) == f), train.filter(F.col(fold) != f)
        told = knn_curve(outside, inside, features, label, key, most).join(inside.select(key, F.col(label).cast("double").alias("truth")), key)
        error = told.agg(F.count("*"), *(F.sum(F.pow(F.col("predictions")[i] - F.col("truth"), 2)) for i in range(most))).first()
        rows += error[0]
        sums += np.array([e or 0.0 for e in error[1:]])
    means = (sums / max(rows, 1)).tolist()
    return int(np.argmin(means)) + 1, means

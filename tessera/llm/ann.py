"""Nearest neighbours through learned partitions.

A neighbour graph over a bounded sample is cut into parts of equal size with
few edges between them. A small classifier learns to tell the parts that hold a
vector's neighbours. Every row is indexed under its most probable part; a query
goes to several most probable parts, whose rows are ranked by exact distance.
How many parts it needs is measured on sample vectors kept from training.

The number of parts grows with the table, to about ``PART_ROWS`` rows a part, up
to ``MOST_PARTS``. The sample (``SAMPLE`` rows by hash of vec_id, or
``SAMPLE_ROWS`` for each part if that is more) bounds what reaches the driver and
what is broadcast. Parts are divided into blocks of rows and of queries by
counts, so a part that holds most rows is many tasks and no group is unbounded.
A table so large that its parts exceed ``PART_ROWS`` rows at ``MOST_PARTS`` costs
distances in proportion to its rows for each query.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those whose length isn't the most frequent one
(the smaller of two as frequent); rows without a vec_id take no part; a vec_id
repeated among the queries asks once; repeated rows are candidates each, except
for their own query; ties go to the smaller vec_id; an empty table gives an
empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 4096
PARTS = 16
MOST_PARTS = 512
PART_ROWS = 8192
SAMPLE_ROWS = 32
NEIGHBOURS = 10
RECALL = 0.96
ROW_BLOCK = 8192
QUERY_BLOCK = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (sizes["n"] if sizes else 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, as indices."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = _squares(x[at : at + 512], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halves(graph: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A balanced cut of the members: a spectral order, halved, then gainful swaps."""
    place = np.full(graph.shape[0], -1)
    place[members] = np.arange(len(members))
    ends = place[graph[members]]
    source = np.repeat(np.arange(len(members)), graph.shape[1])[ends.ravel() >= 0]
    target = ends.ravel()[ends.ravel() >= 0]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    degree = np.bincount(a, minlength=len(members)) + 1e-9
    value = rng.standard_normal(len(members))
    for _ in range(60):
        value = value - (value * degree).sum() / degree.sum()
        value = 0.5 * value + 0.5 * np.bincount(a, value[b], len(members)) / degree
        value /= np.abs(value).max() + 1e-30
    side = np.ones(len(members), np.int64)
    side[np.argsort(value, kind="stable")[: len(members) // 2]] = -1
    best, cut = side.copy(), (side[a] != side[b]).sum()
    for _ in range(20):
        gain = -side * np.bincount(a, side[b], len(members))
        low, high = (np.flatnonzero(side == s) for s in (-1, 1))
        low, high = low[np.argsort(-gain[low])], high[np.argsort(-gain[high])]
        n = min(len(low), len(high))
        n = max(1, int((gain[low[:n]] + gain[high[:n]] > 0).sum() // 4)) if n else 0
        side[low[:n]], side[high[:n]] = 1, -1
        if (now := (side[a] != side[b]).sum()) < cut:
            best, cut = side.copy(), now
    return best


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Part of each node of the graph: a power of two parts; each cut is even but for one node."""
    rng, part = np.random.default_rng(seed), np.zeros(len(graph), np.int64)
    for level in range(parts.bit_length() - 1):
        now = part.copy()
        for p in range(1 << level):
            members = np.flatnonzero(part == p)
            now[members] = 2 * p + (_halves(graph, members, rng) > 0)
        part = now
    return part


class Router:
    """One hidden layer and a softmax over the parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 64, rounds: int = 40, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        self.weights = [rng.standard_normal((x.shape[1], hidden)) * (2 / x.shape[1]) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * hidden**-0.5, np.zeros(target.shape[1])]
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                z, y = (x[order[at : at + 128]] - self.mean) / self.scale, target[order[at : at + 128]]
                h = np.maximum(z @ self.weights[0] + self.weights[1], 0)
                d = (self._softmax(h @ self.weights[2] + self.weights[3]) - y) / len(z)
                back = (d @ self.weights[2].T) * (h > 0)
                step += 1
                for w, g, m, v in zip(self.weights, (z.T @ back, back.sum(0), h.T @ d, d.sum(0)), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-3 * w)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        h = np.maximum((x - self.mean) / self.scale @ self.weights[0] + self.weights[1], 0)
        return np.argsort(-(h @ self.weights[2] + self.weights[3]), axis=1, kind="stable")


def learn(x: np.ndarray, parts: int = PARTS, recall: float = RECALL, seed: int = 0) -> tuple[Router | None, int, int]:
    """Router, number of parts and parts to search for the recall, from a sample; one part if it is small."""
    while parts > 1 and len(x) < SAMPLE_ROWS * parts:
        parts //= 2
    if parts == 1:
        return None, 1, 1
    order = np.random.default_rng(seed).permutation(len(x))
    held, x = x[order[: len(x) // 8]], x[order[len(x) // 8 :]]
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(graph, parts, seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), NEIGHBOURS), part[graph].ravel()), 1 / (NEIGHBOURS + 2))
    target[np.arange(len(x)), part] += 2 / (NEIGHBOURS + 2)
    router = Router(x, target, seed=seed)
    own, routes = router.ranked(x)[:, 0], router.ranked(held)
    near = np.argpartition(_squares(held, x), NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
    rank = np.empty_like(routes)
    np.put_along_axis(rank, routes, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(rank, own[near], axis=1).ravel()
    found = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    return router, parts, int(np.searchsorted(found, recall)) + 1 if found[-1] >= recall else parts


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(rows):
        q, x, ids = np.stack(queries["embedding"].to_list()), np.stack(rows["embedding"].to_list()), rows["vec_id"].to_numpy()
        for at in range(0, len(q), 256):
            block, names = q[at : at + 256], queries["vec_id"].to_numpy()[at : at + 256]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = _squares(block, x)
            rough[np.isnan(rough)] = 0  # squares beyond doubles are told apart below
            slack = 1e-9 * ((block * block).sum(1).max() + (x * x).sum(1).max())
            for i, name in enumerate(names):
                rough[i, ids == name] = np.inf
                edge = np.partition(rough[i], min(k, len(x)) - 1)[min(k, len(x)) - 1]
                near = np.flatnonzero((rough[i] <= edge + slack) & (ids != name))
                apart = np.abs(block[i] - x[near])
                largest = np.maximum(apart.max(1), 1e-300)
                exact = np.sqrt((apart**2).sum(1)) if largest.max(initial=0) < 1e150 else largest * np.sqrt(((apart / largest[:, None]) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:k]
                out += zip([int(name)] * len(best), ids[near][best].tolist(), exact[best].tolist())
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def parts_for(rows: int) -> int:
    """A power of two of parts for so many rows."""
    return min(MOST_PARTS, max(PARTS, 1 << (max(1, -(-rows // PART_ROWS)) - 1).bit_length()))


def search(vectors: DataFrame, asked: Column, k: int = 10, sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """The k nearest rows found for each row for which ``asked`` (on vec_id) holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    parts = parts_for(rows.count()) if parts is None else parts
    sample = max(sample, SAMPLE_ROWS * parts) if parts > PARTS else sample
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(drawn):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    router, parts, probes = learn(np.stack(drawn["embedding"].to_list()), parts, recall)
    ranked = lambda x: router.ranked(x) if router else np.zeros((len(x), 1), np.int64)

    @F.pandas_udf("array<int>")
    def routes(v: pd.Series) -> pd.Series:
        return pd.Series(list(ranked(np.stack(v.to_list())).astype(np.int32))) if len(v) else pd.Series([], dtype=object)

    placed = rows.withColumn("part", routes("embedding")[0])
    counts = dict(placed.groupBy("part").count().collect())  # one row for each part
    while probes < parts and sum(sorted(counts.get(p, 0) for p in range(parts))[:probes]) <= k:
        probes += 1
    queries = rows.filter(asked).dropDuplicates(["vec_id"]).withColumn("part", F.explode(F.slice(routes("embedding"), 1, probes)))
    asks = dict(queries.groupBy("part").count().collect())
    blocks = [(p, max(1, -(-counts.get(p, 0) // ROW_BLOCK)), max(1, -(-asks.get(p, 0) // QUERY_BLOCK))) for p in range(parts)]
    of = lambda i: F.element_at(F.array(*(F.lit(b[i]) for b in blocks)), F.col("part") + 1)
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    placed = placed.withColumn("r", salt(of(1))).withColumn("q", every(of(2)))
    queries = queries.withColumn("q", salt(of(2))).withColumn("r", every(of(1)))
    found = queries.groupBy("part", "r", "q").cogroup(placed.groupBy("part", "r", "q")).applyInPandas(lambda a, b: _nearest(a, b, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

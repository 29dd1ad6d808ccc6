"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Entry (i, j) of the matrix is the number of rows that partition i sends to bin
j. Given the rows of each partition and the size of each bin, the matrix of a
uniform shuffle is hypergeometric. It is drawn top down over a binary tree of
partitions with a seed for each tree node, so that every task draws its own row
alone from the row counts; no task holds the matrix. Each partition permutes
its rows over the bins as its matrix row says, rows are exchanged, and each bin
is permuted again. Whole rows move, with all their columns. A shard is made of as
many bins as keep a bin below ``bin_rows`` rows and about ``bin_bytes`` of text,
and as all bin sizes are known, slots need no counting.

Law: ``rows``. The counts of two shards differ by one at most.

Defined results: a null text has no bytes, so its size is 8 and its crc32 0;
repeated rows and rows with a null doc_id get a slot each; texts of any length
move whole; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name

SHARDS = 24
LARGEST = 10**9  # what numpy's own draws allow


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw of any size; beyond numpy's limit by inversion around the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    if good < LARGEST and bad < LARGEST:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(n / total * good * (bad / total) * ((total - n) / max(1, total - 1)))
    reach = int(40 * spread) + 50
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    step = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[1:]) - np.log(bad - n + x[1:])
    weight = np.concatenate(([0.0], np.cumsum(step)))
    weight = np.exp(weight - weight.max()).cumsum()
    return int(x[min(len(x) - 1, int(np.searchsorted(weight, rng.random() * weight[-1], "right")))])


def _split(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` places, drawn from bins of the given sizes, each bin gives."""
    total = int(sizes.sum())
    if total < LARGEST:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    out = np.zeros_like(sizes)
    for j, size in enumerate(sizes.tolist()):
        out[j] = _draw(rng, size, total - size, n)
        total, n = total - size, n - int(out[j])
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, which: int, seed: int) -> np.ndarray:
    """Row ``which`` of the matrix with row sums ``counts`` and column sums ``sizes``."""
    start, end, column = 0, len(counts), sizes
    while end - start > 1:
        middle = (start + end) // 2
        left = _split(np.random.default_rng([seed, start, end]), column, int(counts[start:middle].sum()))
        if which < middle:
            end, column = middle, left
        else:
            start, column = middle, column - left
    return column


def bin_sizes(total: int, shards: int, bins: int) -> np.ndarray:
    """Sizes of ``bins`` bins for each shard, as even as they can be."""
    shard = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    return (shard[:, None] // bins + (np.arange(bins) < shard[:, None] % bins)).reshape(-1)


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = 1, bin_rows: int = 1 << 20, bin_bytes: int = 1 << 26) -> DataFrame:
    """All rows and columns of ``docs``, each with its ``shard`` and ``slot``; columns of these names are replaced."""
    return _placed(docs, shards, seed, bin_rows, bin_bytes)[0]


def _placed(docs: DataFrame, shards: int, seed: int, bin_rows: int, bin_bytes: int) -> tuple[DataFrame, int, int]:
    """The shuffled rows, the number of rows, and of bins in each shard."""
    docs = docs.drop("shard", "slot")
    named = [free_name(docs, x) for x in ("bin", "draw")]
    # written once, so that counts and draws see the same partitions in the same order
    rows = cut(docs)
    long = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in docs.dtypes if kind in ("string", "binary")), F.lit(0))
    counted = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*"), F.sum(long)).collect()  # one row for each partition
    counts = np.zeros(max([p for p, _, _ in counted], default=-1) + 1, np.int64)
    for p, n, _ in counted:
        counts[p] = n
    total, size = int(counts.sum()), sum(int(b or 0) for _, _, b in counted)
    bins = max(1, -(-total // (shards * bin_rows)), -(-size // (shards * bin_bytes)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, done = TaskContext.get().partitionId(), 0
        if me >= len(counts):
            return
        to = np.repeat(np.arange(shards * bins, dtype=np.int32), matrix_row(counts, bin_sizes(total, shards, bins), me, seed))
        rng = np.random.default_rng([seed, me])
        rng.shuffle(to)
        for batch in batches:
            n = batch.num_rows
            extra = [pa.array(to[done : done + n]), pa.array(rng.integers(-(1 << 63), 1 << 63, n, np.int64, endpoint=False))]
            done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *named])

    schema = T.StructType([*docs.schema.fields, T.StructField(named[0], T.IntegerType()), T.StructField(named[1], T.LongType())])
    sent = rows.mapInArrow(send, schema).repartition(shards * bins, named[0])
    to, draw = map(F.col, named)
    # the hash of the row settles equal draws; equal rows are alike in any order
    place = F.row_number().over(W.partitionBy(to).orderBy(draw, F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind)))) - 1
    shard, part = F.floor(to / bins).cast("int"), (to % bins).cast("bigint")
    room = F.lit(total // shards).cast("bigint") + (shard < total % shards).cast("bigint")
    before = part * F.floor(room / bins) + F.least(part, room % bins)
    return sent.withColumns({"shard": shard, "slot": (before + place).cast("bigint")}).drop(*named), total, bins


def write(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = 1, bin_rows: int = 1 << 20, bin_bytes: int = 1 << 26) -> None:
    """Write the rows as Parquet, a folder for each shard, a file for each of its bins with slots that follow each other, in order.

    A task holds one bin, so its size is bounded however large a shard is.
    """
    placed, total, bins = _placed(docs, shards, seed, bin_rows, bin_bytes)
    rows = max(1, -(-max(1, -(-total // shards)) // bins))  # of a bin
    part = F.least(F.floor(F.col("slot") / rows), F.lit(bins - 1))
    dealt = placed.repartitionById(shards * bins, (F.col("shard") * bins + part).cast("int"))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def summary(placed: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of the rows as they arrived in their shards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "slot")

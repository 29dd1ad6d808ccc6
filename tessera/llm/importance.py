"""Importance resampling toward a target corpus by hashed word runs.

A partition keeps a trie of words: a node is a run of words, holds how often
the run was met, and the CRC-32 of the run's bytes, which is the parent's CRC
carried on over a space and one more word. So a run is hashed once for each
partition, not once for each place. A partition adds its nodes' counts into
bucket totals; these few totals, not the tries, are merged.

A bucket's gain is the log ratio of the target's smoothed share to the corpus's.
Documents are scored by walking the paths of a trie whose nodes hold the gain of
their bucket, and drawn without replacement by Gumbel noise from a hash of
doc_id, so a run that is repeated draws the same documents.

A trie that reaches ``MOST_NODES`` is emptied (its counts are added first) and
begins again: results don't change, memory is bounded. The draw counts scores in
bins of ``BIN``; a score lies between the least gain and the largest, plus noise
between -3,114 and 22,873, so bins are few. Only rows from the edge's bin
upward are ranked, by ranges.

Defined results: a null or empty text, or one without words, has no features and
weight 0; runs don't reach over texts; a null doc_id counts as empty text in the
noise and ranks first among ties; repeated rows are scored and ranked one by
one; without a target text or without documents shares come from the smoothing
alone; fewer than 100 / ``percent`` rows long enough draw none; an empty table gives an empty result; texts of any
length are read whole; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import global_rank
from .common import by_bytes, cut, lower_words

BUCKETS = 10_000
MOST_NODES = 400_000
SLICE = 4_000_000  # bytes of text read together
BIN = 128


class Trie:
    """Runs of words as paths from the root; ``per_bucket``, if given, is what nodes carry along as their gain."""

    def __init__(self, per_bucket: np.ndarray | None = None, buckets: int = BUCKETS):
        self.per_bucket, self.buckets = per_bucket, buckets
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, bytes], int] = {}
        self.state = [0]  # CRC-32 of each node's run
        self.counts = np.zeros(1024, np.int64)

    def _child(self, parent: int, word: bytes) -> int:
        node = self.children.get((parent, word))
        if node is None:
            node = self.children[parent, word] = len(self.state)
            self.state.append(zlib.crc32(b" " + word, self.state[parent]) if parent else zlib.crc32(word))
        return node

    def walk(self, distinct: list[bytes], place: np.ndarray, starts: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of runs: the nodes met by all runs, and the text each belongs to."""
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(place))  # words from here to the text's end
        at, nodes = np.arange(len(place)), np.zeros(len(place), np.int64)
        for length in range(longest):
            some = left[at] > length
            at, nodes = at[some], nodes[some]
            steps, inverse = np.unique(nodes * len(distinct) + place[at + length], return_inverse=True)
            found = [self._child(s // len(distinct), distinct[s % len(distinct)]) for s in steps.tolist()]
            nodes = np.array(found, np.int64)[inverse]
            yield nodes, text[at]

    def count(self, nodes: np.ndarray) -> None:
        met = np.bincount(nodes, minlength=len(self.counts))
        if len(met) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(len(met), np.int64)])
        self.counts[: len(met)] += met

    def totals(self) -> np.ndarray:
        """Counts of the nodes, added by bucket."""
        met = np.flatnonzero(self.counts)
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, np.array(self.state, np.int64)[met] % self.buckets, self.counts[met])
        return out

    def gains(self) -> np.ndarray:
        """The gain that each node carries."""
        return self.per_bucket[np.array(self.state, np.int64) % self.buckets]


def bucket_totals(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features that fall into it; buckets without features are left out."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(buckets=buckets), np.zeros(buckets, np.int64)
        for part in by_bytes(batches, "text", SLICE):
            distinct, place, starts = lower_words(part.column("text"))
            for nodes, _ in trie.walk(distinct.to_pylist(), place, starts, longest):
                trie.count(nodes)
            if len(trie.state) > MOST_NODES:
                total += trie.totals()
                trie.clear()
        total += trie.totals()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], schema=schema)

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths; ``buckets`` rows at most reach the driver from each side."""
    counts = []
    for texts in (docs, target):
        by = dict(bucket_totals(texts, longest, buckets).collect())
        counts.append([by.get(b, 0) for b in range(buckets)])
    corpus, wanted = counts
    s_all, t_all = float(sum(corpus)), float(sum(wanted))
    ratio = ((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(corpus, wanted))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of the features."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(gains, buckets)
        for part in by_bytes(batches, "text", SLICE):
            distinct, place, starts = lower_words(part.column("text"))
            n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for nodes, text in trie.walk(distinct.to_pylist(), place, starts, longest):
                n += np.bincount(text, minlength=part.num_rows)
                along = np.concatenate([[0], np.cumsum(trie.gains()[nodes])])
                edges = np.searchsorted(text, np.arange(part.num_rows + 1))
                total += np.diff(along[edges])
            if len(trie.state) > MOST_NODES:
                trie.clear()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts)), pa.array(n), pa.array(weight)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: str = "2024", percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; ``rank`` is null where the row isn't drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn, those
    of the largest scores, ties to the smaller doc_id.
    """
    weighed = weigh(docs, fit_gains(docs, target, longest, buckets), longest)
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fits, level = F.col("n_words") >= least_words, F.floor(F.col("score") / BIN)
    bins = dict(scored.filter(fits).groupBy(level.alias("level")).count().collect())
    most = sum(bins.values()) * percent // 100
    edge, above = max(bins, default=0) + 1, 0
    for b in sorted(bins, reverse=True):
        if above >= most:
            break
        edge, above = b, above + bins[b]
    near = fits & (level >= edge)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight"), F.col("n_features")]
    ranked = global_rank(scored.filter(near), order, "rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.filter(~near).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")

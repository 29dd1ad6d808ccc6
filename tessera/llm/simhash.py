"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint has eight bytes. Two that differ in at most three bits differ in
at most three bytes, so they share at least five positional bytes. The index
holds, for each fingerprint, postings on sets of positional bytes chosen so
that five shared bytes always contain one whole set. Within a posting list the
shared positional bytes of a pair are tallied, pairs below five are dropped and
the rest are verified bit by bit.

Posting lists have a bound. Members of longer lists are indexed again on all
sets of five bytes, and those of lists that are still too long on every choice
of three free bits, where a list has at most eight members. So the work is
linear in the number of distinct fingerprints and no link is lost; a member of a
list that stays too long costs up to 56 * 2,024 postings at that last step.
``wide_simhash`` is the same index for a similarity of shingle sets.

Defined results: null and empty texts, and texts of white space, have the
fingerprint zero and link like any other; repeated rows stay as they are; a row
whose doc_id is null is fingerprinted and takes the smallest doc_id of its
component, null if there is none; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
LIST_BOUND = 1024
SALTS = 16
HEAVY = 1000  # a node is heavy if it has more than one in so many of all edges


def text_fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    tally, block = np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(hashes), block):
        part = np.array(hashes[at : at + block], dtype=">u8").view(np.uint8).reshape(-1, 8)
        tally += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits((tally * 2 > len(hashes)).astype(np.uint8))
    return int(bits.view(">u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    made = np.fromiter((text_fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(made.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return _fingerprint(F.coalesce(text, F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte_mask(positions) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


#: Five of eight positions always hold three of the first or of the last four.
TRIPLES = [_byte_mask(c) for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
FIVES = list(combinations(range(8), MIN_SHARED))


def _free_bits(kept: tuple[int, ...]) -> list[int]:
    bits = [b for p in range(8) if p not in kept for b in range(8 * p, 8 * p + 8)]
    return [_signed(((1 << 64) - 1) & ~sum(1 << b for b in c)) for c in combinations(bits, MAX_BITS)]


def _shared_bytes(difference: Column) -> Column:
    return sum(((difference.bitwiseAND(F.lit(_byte_mask([p])))) == 0).cast("int") for p in range(8))


def _list_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a bounded posting list, edges that connect what its links connect."""
    values = np.unique(members).view(np.uint64)
    rest = np.ones(len(values), bool)
    u, v = [], []
    for seed in range(len(values)):
        if not rest[seed]:
            continue
        rest[seed] = False
        frontier = np.array([seed])
        while len(frontier) and rest.any():
            other = np.flatnonzero(rest)
            found = np.zeros(len(other), bool)
            for at in range(0, len(frontier), 64):  # some rows of the pair table at a time
                differ = values[frontier[at : at + 64]][:, None] ^ values[other][None, :]
                tally = sum((differ >> np.uint64(8 * p) & np.uint64(0xFF) == 0).astype(np.uint8) for p in range(8))
                found |= ((tally >= MIN_SHARED) & (np.bitwise_count(differ) <= MAX_BITS)).any(axis=0)
            frontier = other[found]
            rest[frontier] = False
            u.append(frontier)
            v.append(np.full(len(frontier), seed))
    join = lambda x: values[np.concatenate(x)].view(np.int64) if x else np.zeros(0, np.int64)
    return join(u), join(v)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of each posting list; a batch of edges leaves before the next list is read."""
    for batch in batches:
        for members in batch.column(0):
            u, v = _list_links(members.values.to_numpy())
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _links_of(postings: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """Edges from posting lists (m, k, fp) up to ``bound``, and the postings of longer ones."""
    lists = postings.groupBy("m", "k").agg(F.count("*").alias("n"), F.min("fp").alias("v"), F.max("fp").alias("u")).filter("n > 1")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    pairs = lists.filter("n = 2").filter((_shared_bytes(differ) >= MIN_SHARED) & (F.bit_count(differ) <= MAX_BITS)).select("u", "v")
    longer = postings.join(lists.filter("n > 2").select("m", "k", "n"), ["m", "k"])
    lists_of = longer.filter(F.col("n") <= bound).groupBy("m", "k").agg(F.collect_list("fp").alias("fps"))
    several = lists_of.select("fps").mapInArrow(_linked, "u bigint, v bigint")
    return pairs.unionByName(several), longer.filter(F.col("n") > bound).select("m", "k", "fp")


def links(fingerprints: DataFrame, bound: int = LIST_BOUND) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp`` that connect exactly what links connect."""
    spark = fingerprints.sparkSession
    by_mask = lambda masks: F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseAND(m))
    post = lambda df, masks: df.select("fp", F.posexplode(by_mask(masks)).alias("m", "k"))
    edges, long_lists = _links_of(post(fingerprints, TRIPLES), bound)
    members = cut(long_lists.select("fp").distinct())
    if members.isEmpty():
        return edges
    more, long_lists = _links_of(post(members, [_byte_mask(c) for c in FIVES]), bound)
    edges, members = edges.unionByName(more), cut(long_lists.select("fp", "m").distinct())
    if members.isEmpty():
        return edges
    # a fixed table: the masks that free three of the 24 bits outside each set
    free = spark.createDataFrame(pd.DataFrame([(s, x) for s, c in enumerate(FIVES) for x in _free_bits(c)], columns=["m", "mask"]))
    postings = members.join(F.broadcast(free), "m").select(F.col("mask").alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp").distinct()
    if bound < 1 << MAX_BITS:
        raise ValueError(f"a list of the last index may have {1 << MAX_BITS} members, so the bound can't be {bound}")
    more, _ = _links_of(postings, bound)
    return edges.unionByName(more)


def _lows(edges: DataFrame) -> DataFrame:
    """(u, low, n): each node's smallest neighbour and number of neighbours, gathered by salted keys first."""
    some = edges.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("salt")).agg(F.min("v").alias("low"), F.count("*").alias("n"))
    return some.groupBy("u").agg(F.min("low").alias("low"), F.sum("n").alias("n"))


def _with_low(edges: DataFrame, lows: DataFrame, total: int) -> DataFrame:
    """``edges`` with the ``low`` of their ``u``; nodes with a ``HEAVY``-th of all edges are sent to every task, 2 * HEAVY at most."""
    heavy = F.col("n") * HEAVY > total + HEAVY * SALTS
    sent = F.broadcast(lows.filter(heavy).select("u", F.col("low").alias("heavy_low")))
    met = edges.join(sent, "u", "left")
    rest = met.filter("heavy_low is null").drop("heavy_low").join(lows.filter(~heavy).select("u", "low"), "u")
    return met.filter("heavy_low is not null").withColumnRenamed("heavy_low", "low").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list; root is the smallest node reachable.

    Alternating large-star and small-star steps, each a shuffle by node; the
    edges of a node that has many are neither gathered nor joined in one task.
    What an iteration leaves is checkpointed.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    state = None
    edges = cut(edges)
    total = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lows(both).select("u", F.least("low", "u").alias("low"), "n")
        large = _with_low(both, low, total).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = _lows(large)
        small = _with_low(large, low, total).filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        found = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if found == state:
            break
        state, total = found, found[0]
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def near_duplicates(docs: DataFrame, bound: int = LIST_BOUND) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``."""
    prints = cut(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    distinct = cut(distinct)
    roots = components(links(distinct.select("fp"), bound)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(classes, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

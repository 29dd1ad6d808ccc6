"""SimHash near-duplicates at a stated similarity of word shingles.

A pair whose shingle sets have a Jaccard similarity of 0.8 differs in every
seventh bit of a SimHash, too many for bytes of single bits to meet. So each
positional byte here is taken from 128 SimHash counters: the number of the
counter furthest from zero and its sign, eight bits that are far steadier. The
counters are products of the text's hashed shingles with fixed random signs.

The ``WIDTH`` bytes stand in groups of six, and the index holds postings on all
sets of three bytes of a group; a pair that shares 15 of the 42 bytes always
meets, and one that shares fewer usually does. In a posting list the shared
positional bytes of a pair are tallied, pairs below ``MIN_SHARED`` are dropped,
and what is left is verified by exact Jaccard similarity of the two sets.

Texts with equal shingle sets are one node, so copies cost nothing. A pair is
told by the first of the lists that it shares. A list gives all its pairs, as
long as they are no more than ``ALL_PAIRS`` for each member. A dense group of
near copies has more; there the members meet with their sets, all pairs that
share enough bytes and aren't connected yet are verified in place, and only
edges that connect the same nodes leave. So what moves is linear in a group's
size, and no pair of a list is left out.

A list beyond ``LIST_BOUND`` is dealt into chunks of that size, whose leaders
form the list of the next round: the first node leads, nodes that share
``MIN_SHARED`` bytes with it are held against it, the first of the others leads
next. A dense group has few leaders, so its list shrinks at once. Then members
of its largest group needn't meet again; the others meet all members, in tiles
of bounded size. That is quadratic in the worst case of a long list without a
large group, but distributed. Where more than half of a list leads, its nodes
are unrelated, and all are listed anew by one more shared byte; nodes that share
``MIN_SHARED`` bytes share five beside those of their list, so after five such
steps all members are near each other.

Shingle sets are as large as the texts. They are made for the index, made again
for the nodes that meet in it, and moved only for those.

Defined results: null and empty texts have the empty set and are alike; a text
of fewer words than a shingle has one shingle, all of it; shingles count once
for a text; they are kept as 32-bit hashes, nodes as 64-bit ones; of a group the
row of smallest doc_id stays, then of the smallest hash of the text, null ids
last; of rows alike in both one stays; texts of any length are read whole; an
empty table gives an empty result; all columns of the rows that stay are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, cut, free_name, held, parts_between, text_bytes
from .simhash import components

SHINGLE = 5
SIMILARITY = 0.8
WIDTH = 42
COUNTERS = 128
DIMENSIONS = 512
MIN_SHARED = 8
ALL_PAIRS = 2
LIST_BOUND = 1024
LEADERS = 99  # depth of a list of leaders
TILE = 1 << 24  # bytes of shingles from one side of a tile
BROADCAST_ROWS = 1_000_000  # most rows of a drop list that is sent to every task
HEAVY = 1000
SALTS = 32
SETS = [tuple(6 * g + i for i in c) for g in range(WIDTH // 6) for c in combinations(range(6), 3)]
SLICE = 1_000_000  # bytes of text hashed together


def _signs() -> np.ndarray:
    return (np.random.default_rng(7).integers(0, 2, (DIMENSIONS, WIDTH * COUNTERS)) * 2 - 1).astype(np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, all in a row, and where each text's begin and the last end."""
    data, ends = text_bytes(texts)
    data = np.frombuffer(data.tobytes().lower(), np.uint8)
    inside = (data != 32) & (data - np.uint8(9) > 4)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = ends[:-1][ends[:-1] < len(data)]
    first[edge] |= inside[edge]
    begin = np.flatnonzero(first)
    n = np.diff(np.searchsorted(begin, ends))
    distinct, place = parts_between(data[inside], np.append((np.cumsum(inside) - inside)[begin], inside.sum()))
    key = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[place]
    # a shorter text is padded after its last word, so it has one shingle
    room = np.where(n, np.maximum(n, shingle), 0)
    start = np.cumsum(room) - room
    padded = np.zeros(int(room.sum()) + shingle, np.uint64)
    padded[np.arange(len(key)) + np.repeat(start - (np.cumsum(n) - n), n)] = key
    h = np.zeros(int(room.sum()), np.uint64)
    for i in range(shingle):
        h = _mix(h * np.uint64(3) + padded[i : len(h) + i] + np.uint64(i))
    text = np.repeat(np.arange(len(n)), room)
    real = np.arange(len(h)) - start[text] <= room[text] - shingle
    joined = np.unique((text[real].astype(np.uint64) << np.uint64(32)) | h[real] >> np.uint64(32))
    return (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(joined, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(32))


def prints(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ``WIDTH`` positional bytes of each text, a row each."""
    signs = held("signs", _signs)
    h = _mix(sets.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    cell = text * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64)
    tallied = np.bincount(cell, np.where(h >> np.uint64(63), 1.0, -1.0), (len(ends) - 1) * DIMENSIONS).reshape(-1, DIMENSIONS)
    out = np.empty((len(tallied), WIDTH), np.uint8)
    for at in range(0, len(tallied), 512):
        told = (tallied[at : at + 512].astype(np.float32) @ signs).reshape(-1, WIDTH, COUNTERS)
        best = np.abs(told).argmax(2)
        out[at : at + 512] = 2 * best + (np.take_along_axis(told, best[..., None], 2)[..., 0] > 0)
    return out


def _sets(docs: DataFrame, shingle: int, schema: str, made) -> DataFrame:
    """Map the hashes and shingle sets of slices of ``docs`` to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            sets, ends = shingle_sets(batch.column("text"), shingle)
            packed = [sets[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            names = pa.array(np.fromiter(map(xxhash.xxh64_intdigest, packed), np.uint64, len(packed)).view(np.int64))
            columns = made(batch, names, packed, sets, ends)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def nodes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, hash of the text, node and positional bytes of each row."""
    made = lambda batch, names, packed, sets, ends: {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "node": names, "print": pa.array([p.tobytes() for p in prints(sets, ends)], pa.binary())}
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return _sets(keyed, shingle, "doc_id bigint, h bigint, node bigint, print binary", made)


def node_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node and shingles (32-bit hashes, packed) of each row."""
    made = lambda batch, names, packed, sets, ends: {"node": names, "shingles": pa.array(packed, pa.binary())}
    return _sets(docs.select("text"), shingle, "node bigint, shingles binary", made)


def _near(held: np.ndarray, some: np.ndarray, at: int, number: int | None = None) -> np.ndarray:
    """Whether each of ``some`` members shares enough bytes with the member ``at`` and, if the list has a number, no set of a smaller one."""
    same = held[some] == held[at]
    near = same.sum(1) >= MIN_SHARED
    if number is not None:
        group, (a, b, c) = SETS[number][0] // 6, SETS[number]
        near &= (same[:, : 6 * group].reshape(len(same), group, 6).sum(2) < 3).all(1)
        near &= ~same[:, [i for i in range(6 * group, c) if i not in (a, b)]].any(1)
    return near


def _all_pairs(node: np.ndarray, held: np.ndarray, number: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of a list that share enough bytes; None if they are more than ``ALL_PAIRS`` a member."""
    u, v, total = [node[:0]], [node[:0]], 0
    for at in range(len(node)):
        rest = np.arange(at + 1, len(node))
        met = node[rest[_near(held, rest, at, number)]]
        total += len(met)
        if total > ALL_PAIRS * len(node):
            return None
        u.append(met)
        v.append(np.full(len(met), node[at]))
    return np.concatenate(u), np.concatenate(v)


def _paired(held: np.ndarray, number: int | None = None) -> np.ndarray:
    """The members of a list that share enough bytes with another."""
    paired = np.zeros(len(held), bool)
    for at in range(len(held)):
        rest = np.arange(at + 1, len(held))
        near = rest[_near(held, rest, at, number)]
        paired[near] = True
        paired[at] |= len(near) > 0
    return paired


def _with_leaders(node: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a list's members with their leaders, and the places of the leaders."""
    u, v, rest, leads = [node[:0]], [node[:0]], np.arange(len(node)), []
    while len(rest):
        lead, rest = rest[0], rest[1:]
        near = _near(held, rest, lead)
        u.append(node[rest[near]])
        v.append(np.full(near.sum(), node[lead]))
        leads.append(lead)
        rest = rest[~near]
    return np.concatenate(u), np.concatenate(v), np.array(leads, np.int64)


def _members(members: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([m["node"] for m in members], np.int64), np.frombuffer(b"".join(m["print"] for m in members), np.uint8).reshape(-1, WIDTH)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of lists; of a dense one the members u that have a pair there, without v, and the list's key."""
    for batch in batches:
        for k, members in zip(*(c.to_pylist() for c in batch.columns)):
            node, held = _members(members)
            pairs = _all_pairs(node, held, k >> 24)
            u, v = pairs or (node[_paired(held, k >> 24)], None)
            if len(u):
                columns = [pa.array([None] * len(u) if pairs else [k] * len(u), pa.int64()), pa.array(u), pa.array(v) if pairs else pa.nulls(len(u), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "u", "v"])


def _led(bound: int):
    """Pairs (u, v) of chunks; without v the leaders of long lists, with their bytes, and the members of dense short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, depth, n, used, members in zip(*(c.to_pylist() for c in batch.columns)):
                node, held = _members(members)
                pairs = _all_pairs(node, held)
                u, v, leads = _with_leaders(node, held)
                alone = leads if n > bound else np.flatnonzero(_paired(held)) if pairs is None else leads[:0]
                u, v = pairs or (u, v)
                size = len(u) + len(alone)
                fixed = [pa.array([x] * size, t) for x, t in ((k, pa.int64()), (depth, pa.int32()), (n, pa.int64()), (used, pa.list_(pa.int32())))]
                told = [pa.array([*u.tolist(), *node[alone].tolist()], pa.int64()), pa.array([*v.tolist(), *[None] * len(alone)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*fixed, *told, pa.array([*[None] * len(u), *(held[i].tobytes() if n > bound else None for i in alone)], pa.binary())], names=["k", "depth", "n", "used", "u", "v", "print"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """``df``, sent to every task if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = np.array(SETS)
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            held = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int64)
            a, b, c = (held[:, sets[:, i]] for i in range(3))
            k = a << 16 | b << 8 | c | np.arange(len(sets)) << 24
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), len(sets))), pa.array(k.ravel())], names=["node", "k"])


def _with_node(lists: DataFrame, table: DataFrame) -> DataFrame:
    """``lists`` (node and others) with the columns of ``table``, which has one row a node; a node's rows are joined as one."""
    others = [c for c in lists.columns if c != "node"]
    return lists.groupBy("node").agg(F.collect_list(F.struct(*others)).alias("at")).join(table, "node").withColumn("at", F.explode("at")).select("at.*", "node", *(c for c in table.columns if c != "node"))


class Met:
    """What meets in the index: pairs (u, v); dense lists (k, nth, node) whose pairs are too many to be told; long lists (k, node), None if there are none."""

    def __init__(self, pairs: DataFrame, dense: DataFrame, long: DataFrame | None):
        self.pairs, self.dense, self.long = pairs, dense, long


def meetings(distinct: DataFrame, bound: int = LIST_BOUND) -> Met:
    """What meets in the index of nodes (node, print)."""
    distinct = cut(distinct.select("node", "print"))
    postings = distinct.mapInArrow(_postings, "node bigint, k bigint")
    long = cut(postings.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > bound))
    some = _few(long) if not long.isEmpty() else None
    short = postings if some is None else postings.join(some.select("k"), "k", "left_anti")
    # few postings have a partner, so they move without the bytes, and those that have one take them along
    shared = short.groupBy("k").agg(F.collect_list("node").alias("m")).filter(F.size("m") > 1).select("k", F.explode("m").alias("node"))
    lists = _with_node(shared, distinct).groupBy("k").agg(F.collect_list(F.struct("node", "print")).alias("m"))
    found = cut(lists.mapInArrow(_tallied, "k bigint, u bigint, v bigint"))
    pairs, dense = found.filter("v is not null").select("u", "v"), found.filter("v is null").select("k", F.lit(-1).alias("nth"), F.col("u").alias("node"))
    left = None
    if some is not None:
        used = F.get(F.array(*(F.array(*map(F.lit, c)) for c in SETS)), F.shiftright("k", 24).cast("int"))
        rows = postings.join(some, "k").join(distinct, "node").select("k", "node", "print", "n", F.lit(0).alias("depth"), used.alias("used"))
        more = _long_lists(rows, bound)
        pairs, dense, left = pairs.unionByName(more.pairs), dense.unionByName(more.dense), more.long
    return Met(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), dense, left)


def candidates(distinct: DataFrame, bound: int = LIST_BOUND) -> DataFrame:
    """Pairs (u, v) of nodes (node, print) that meet in the index and share enough bytes; those of dense lists with leaders only."""

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0).to_pylist():
                u, v, _ = _with_leaders(*_members(members))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    met = meetings(distinct, bound)
    lists = met.dense.join(distinct.select("node", "print"), "node").groupBy("k", "nth").agg(F.collect_list(F.struct("node", "print")).alias("m"))
    return met.pairs.unionByName(lists.select("m").mapInArrow(led, "u bigint, v bigint")).distinct()


def _long_lists(rows: DataFrame, bound: int) -> Met:
    """What meets in lists too long for a task: ``rows`` have k, node, print, n (the list's length), depth and used (positions that the list shares)."""
    pairs, dense, long, nth = [], [], [], 0
    fresh = (F.col("n") > bound) & (F.col("depth") < LEADERS)
    while True:
        chunk = F.pmod(F.xxhash64("node", F.lit(nth)), F.ceil(F.col("n") / bound))
        lists = rows.groupBy("k", "depth", "n", "used", chunk.alias("chunk")).agg(F.collect_list(F.struct("node", "print")).alias("m"))
        met = cut(lists.select("k", "depth", "n", "used", "m").mapInArrow(_led(bound), "k bigint, depth int, n bigint, used array<int>, u bigint, v bigint, print binary"))
        pairs.append(met.filter("v is not null").select("u", "v"))
        dense.append(met.filter((F.col("n") <= bound) & F.col("v").isNull()).select("k", F.lit(nth).alias("nth"), F.col("u").alias("node")))
        leads = met.filter((F.col("n") > bound) & F.col("v").isNull()).select("k", "depth", "n", "used", F.col("u").alias("node"), "print")
        left = cut(leads.groupBy("k").agg(F.count("*").alias("left")).filter("left > 1"))
        if left.isEmpty():
            long.append(rows.filter(fresh).select("k", "node"))
            break
        left, nth = _few(left), nth + 1
        leads = leads.join(left, "k")
        unrelated = (F.col("left") > bound) & (2 * F.col("left") > F.col("n")) & (F.col("depth") < MIN_SHARED - 3)
        # positions behind the last one by which the list was made, so that each set of further positions is listed once
        free = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: ~F.array_contains("used", i) & ((F.col("depth") == 0) | (i > F.element_at("used", -1))))
        long.append(rows.filter(fresh).join(left, "k", "left").filter(~F.coalesce(unrelated, F.lit(False))).select("k", "node"))
        finer = rows.join(left, "k").filter(unrelated).withColumn("at", F.explode(free))
        finer = finer.select(F.xxhash64("k", "at", F.substring(F.col("print"), F.col("at") + 1, F.lit(1))).alias("k"), "node", "print", (F.col("depth") + 1).alias("depth"), F.array_append("used", F.col("at")).alias("used"))
        finer = finer.join(finer.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), "k")
        # leaders go on as long as they get fewer; what they leave out is told by the long list
        on = ~unrelated & ((F.col("left") <= bound) | (2 * F.col("left") <= F.col("n")))
        rows = cut(leads.filter(on).select("k", "node", "print", F.col("left").alias("n"), F.lit(LEADERS).alias("depth"), "used").unionByName(finer.select("k", "node", "print", "n", "depth", "used")))
    whole = lambda parts: reduce(DataFrame.unionByName, parts)
    long = cut(whole(long))
    return Met(whole(pairs), whole(dense), None if long.isEmpty() else long)


def _tiles(lists: DataFrame, sizes: DataFrame, bound: int) -> DataFrame:
    """Lists (k, nth, node, root, minor) in parts ``tile`` of bounded rows and bytes, so that any two members meet in one, unless neither is ``minor``."""
    sized = _with_node(lists, sizes)
    some = lambda what: F.greatest(F.ceil(F.count_if(what) / bound), F.ceil(F.sum(F.when(what, F.col("size")).otherwise(0)) / TILE)).cast("int")
    parts = sized.groupBy("k", "nth").agg(some(F.col("minor")).alias("few"), some(~F.col("minor")).alias("many"))
    cells = cut(parts.filter("few > 0 and few + many > 1"))  # the others are a part each
    if cells.isEmpty():
        return lists.withColumn("tile", F.lit(0))
    met = lists.join(_few(cells), ["k", "nth"], "left")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many")).cast("bigint")).cast("int")
    number = lambda i, j: i * (F.col("few") + F.col("many")) + j
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    others = F.concat(F.transform(upto(F.col("few")), lambda j: number(F.least("mine", j), F.greatest("mine", j))), F.transform(upto(F.col("many")), lambda j: number(F.col("mine"), F.col("few") + j)))
    of = F.when(F.col("minor"), others).otherwise(F.transform(upto(F.col("few")), lambda i: number(i, F.col("few") + F.col("mine"))))
    return met.withColumn("mine", mine).withColumn("tile", F.explode(F.coalesce(of, F.array(F.lit(0))))).select(*lists.columns, "tile")


def _connected(tiles: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) that connect, in each tile of a list, what pairs connect that share enough bytes and are as similar as is asked."""

    def run(members: pa.Table) -> pa.Table:
        members = members.combine_chunks()
        k, nth = (members.column(c).to_numpy() for c in ("k", "nth"))
        number = int(k[0]) >> 24 if nth[0] == -1 else None
        held = np.frombuffer(b"".join(members.column("print").to_pylist()), np.uint8).reshape(-1, WIDTH)
        data, ends = text_bytes(pa.concat_arrays(members.column("shingles").chunks))
        sets, ends = np.frombuffer(data.tobytes(), np.uint32), ends // 4
        size, root = np.diff(ends), members.column("root").to_numpy()
        group = root.copy()
        for at in range(len(root)):
            rest = np.arange(at + 1, len(root))
            rest = rest[(group[rest] != group[at]) & (np.minimum(size[rest], size[at]) >= similarity * np.maximum(size[rest], size[at]))]
            rest = rest[_near(held, rest, at, number)]
            if not len(rest):
                continue
            mine, theirs = sets[ends[at] : ends[at + 1]], np.concatenate([sets[ends[i] : ends[i + 1]] for i in rest])
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat((mine[place] == theirs).astype(np.int64), np.cumsum(size[rest]) - size[rest])
            linked = rest[both >= similarity * (size[at] + size[rest] - both) - 1e-9]
            group[np.isin(group, group[linked])] = group[at]
        # each is told with the smallest that it is connected to, so that the lists of a group tell the same
        u, first = np.unique(root, return_index=True)
        of = group[first]
        least, place = np.unique(of, return_inverse=True)
        least = np.full(len(least), u[-1])
        np.minimum.at(least, place, u)
        v = least[place]
        return pa.table({"u": u[u != v], "v": v[u != v]})

    return _with_node(tiles, table).groupBy("k", "nth", "tile").applyInArrow(run, "u bigint, v bigint")


def _told(met: Met) -> DataFrame:
    """The nodes of all that meets."""
    told = met.pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(met.dense.select("node"))
    return (told if met.long is None else told.unionByName(met.long.select("node"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose sets are as similar as is asked; ``sets`` has node and shingles, one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                both = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    # a node that leads a large group is dealt to SALTS tasks; there are at most HEAVY such nodes for each side
    total = pairs.count()
    for side, name in (("u", "a"), ("v", "b")):
        heavy = pairs.groupBy(side).agg(F.count("*").alias("times")).filter(F.col("times") * HEAVY > total + HEAVY * SALTS).select(side, F.lit(True).alias("heavy"))
        salted = pairs.join(F.broadcast(heavy), side, "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("u", "v"), F.lit(SALTS))).otherwise(0))
        mine = sets.join(pairs.select(F.col(side).alias("node")).distinct(), "node", "left_semi").withColumnsRenamed({"node": side, "shingles": name})
        mine = mine.join(F.broadcast(heavy), side, "left").withColumn("salt", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("heavy")
        pairs = salted.drop("heavy").withColumn("salt", F.col("salt").cast("int")).join(mine, [side, "salt"]).drop("salt")
    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def groups(rows: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, bound: int = LIST_BOUND) -> DataFrame:
    """(node, root) of the nodes among ``rows`` (as ``nodes`` gives them; ``sets`` as ``node_sets`` does) that are linked to others."""
    distinct = cut(rows.groupBy("node").agg(F.min("print").alias("print")))
    met = meetings(distinct, bound)
    met.pairs = cut(met.pairs)
    sets = cut(sets.join(_few(cut(_told(met))), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))
    edges = verified(met.pairs, sets, similarity)
    if met.dense.isEmpty() and met.long is None:
        return components(edges)
    table, sizes = distinct.join(sets, "node"), sets.select("node", F.octet_length("shingles").alias("size"))
    dense = met.dense.select("k", "nth", "node", F.col("node").alias("root"), F.lit(True).alias("minor"))
    edges = edges.unionByName(_connected(_tiles(dense, sizes, bound), table, similarity))
    if met.long is None:
        return components(edges)
    # of a long list the nodes of its largest group needn't meet each other again
    edges = cut(edges)
    roots = components(edges)
    lists = met.long.distinct().join(roots, "node", "left").select("k", F.lit(-2).alias("nth"), "node", F.coalesce("root", "node").alias("root"))
    most = lists.groupBy("k", "root").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count("*").alias("roots"))
    lists = cut(lists.join(_few(cut(most.filter("roots > 1").select("k", "most"))), "k").withColumn("minor", F.col("root") != F.col("most")).drop("most"))
    return components(edges.unionByName(_connected(_tiles(lists, sizes, bound), table, similarity)))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bound: int = LIST_BOUND) -> DataFrame:
    """``docs`` with one row of each group of rows that links of the similarity connect."""
    rows = cut(nodes(docs, shingle))
    roots = groups(rows, node_sets(docs, shingle), similarity, bound)
    marks = rows.select("doc_id", "h", "node").join(roots, "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    first = marks.groupBy("root").agg(F.min(order).alias("o"))
    keep = first.select(F.col("o.doc_id").alias("doc_id"), F.col("o.h").alias("h"))
    times = cut(marks.groupBy("doc_id", "h").agg(F.count("*").alias("n")))
    kept = times.join(keep.distinct().withColumn("kept", F.lit(True)), (times["doc_id"].eqNullSafe(keep["doc_id"])) & (times["h"] == keep["h"]), "left").select(times["doc_id"], times["h"], "n", "kept")
    kept = cut(kept)
    gone, again = kept.filter("kept is null or n > 1").select("doc_id", "h"), kept.filter("kept and n > 1").select("doc_id", "h")
    key, named = free_name(docs, "h"), lambda df, k: df.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))
    keyed = docs.withColumn(key, F.xxhash64("text"))

    def met(how: str, some: DataFrame) -> DataFrame:
        # rows are not moved for a short list
        some = named(some, key)
        if some.count() <= BROADCAST_ROWS:
            some = F.broadcast(some)
        return keyed.join(some, keyed["doc_id"].eqNullSafe(some["gone_id"]) & (keyed[key] == some["gone_h"]), how)

    out = met("left_anti", gone)
    if not again.isEmpty():  # of rows alike in id and text one stays
        nth = free_name(keyed, "nth")
        repeated = met("left_semi", again).withColumn(nth, F.row_number().over(W.partitionBy("doc_id", key).orderBy(key)))
        out = out.unionByName(repeated.filter(F.col(nth) == 1).drop(nth))
    return out.select(*docs.columns)

"""Benchmark items found in documents by edit distance over words.

A document is contaminated by an item of L words if some stretch of its words is
within ``k = floor((1 - SIMILARITY) * L)`` word edits of the item. Words are
lower-cased runs of ASCII letters, digits and other non-ASCII characters.

Windows of L words are embedded by CGK random walks: a walk copies the word it
stands on and moves on by a random bit of word and step, so that a small edit
distance becomes a small Hamming distance between the copied words. Each
repetition has its own walk and samples ``SAMPLED`` positions of the embedding
as the key under which windows and items of equal length meet. What meets is
verified by the smallest edit distance of the item to any stretch around the
window, so words that are missing or added don't push the end of an item out.

How many repetitions reach the target recall is measured for each length, on
items with k edits of mixed kinds and on items without k of their words whose
windows are filled with foreign words; the trials that meet least count. Where
more than ``MOST_REPETITIONS`` would be needed, the length is searched without
keys: each item is held against all places that pass the test of word pairs.

That test puts aside what no item can match: k edits spoil at most 2k of an
item's L - 1 word pairs, so a stretch of at most L + k words must hold
L - 1 - 2k pairs that occur in items of its length. Windows that reach over the
end of a document are filled up, so shorter documents are matched too.

The index is built by tasks, in blocks of at most ``BLOCK_CHARS`` characters,
and written to the shared folder. A worker holds one block at a time; documents
are read once, whatever the number of blocks.

Defined results: items and documents that are null, empty or without a word
match nothing; items of fewer than ``1 / (1 - SIMILARITY)`` words match verbatim
alone; items of equal words count once, under their smallest item_id; items
without an id are ignored; of equally near stretches the first is told; repeated
documents and those without a doc_id are matched one by one; documents and items
of any length are read whole; an empty table on either side gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, held, new_folder, parts_between, text_bytes

SIMILARITY = 0.8
SAMPLED = 2
RECALL = 0.99
MOST_REPETITIONS = 64
TRIALS = 32
BLOCK_CHARS = 4_000_000
SLICE = 2_000_000  # bytes of documents matched together
_WORDY = np.array([c > 127 or chr(c).isalnum() for c in range(256)])


def coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of all texts, each word's place among them, and where each text's words begin and the last end."""
    data, ends = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    inside = _WORDY[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = ends[:-1][ends[:-1] < len(data)]
    first[edge] |= inside[edge]
    begin = np.flatnonzero(first)
    distinct, place = parts_between(data[inside], np.append((np.cumsum(inside) - inside)[begin], inside.sum()))
    return distinct.to_pylist(), place, np.searchsorted(begin, ends)


def words(text: str | None) -> list[bytes]:
    distinct, place, _ = coded(pa.array([text], pa.string()))
    return [distinct[i] for i in place]


def allowed(n: int, similarity: float) -> int:
    """Word edits that an item of ``n`` words may differ by."""
    return math.floor((1 - similarity) * n + 1e-9)


def _distances(item, stretch, anywhere: bool) -> list[int]:
    """Levenshtein distance of the item to each prefix of the stretch, or to its nearest suffix if it may begin anywhere.

    A row of the table is held in two bit vectors.
    """
    at: dict = defaultdict(int)
    for i, x in enumerate(item):
        at[x] |= 1 << i
    n, full = len(item), (1 << len(item)) - 1
    plus, minus, score, out = full, 0, n, [n]
    edge = 0 if anywhere else 1
    for x in stretch:
        same = at.get(x, 0)
        down = (((same & plus) + plus) ^ plus) | same | minus
        rise, fall = minus | ~(down | plus) & full, plus & down
        score += (rise >> (n - 1) & 1) - (fall >> (n - 1) & 1)
        rise, fall = (rise << 1 | edge) & full, fall << 1 & full
        plus, minus = fall | ~(down | rise) & full, rise & down
        out.append(score)
    return out


def nearest(item, stretch) -> tuple[int, int]:
    """The smallest distance of the item to any part of the stretch, and where the first such part begins."""
    told = _distances(item, stretch, True)
    least = min(told)
    end = told.index(least)
    back = _distances(item[::-1], stretch[:end][::-1], False)
    return least, end - back.index(least)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def embed(x: np.ndarray, walk: int, wanted: list[int]) -> np.ndarray:
    """CGK embedding of each row: the words that its random walk copies at the wanted steps, 0 beyond the end.

    A word's bits for 64 steps come from one hash of the word, the walk and the steps' number.
    """
    n, width = x.shape
    padded = np.concatenate([x, np.zeros((n, 1), x.dtype)], axis=1)
    at = np.arange(n) * (width + 1)
    end, flat = at + width, padded.reshape(-1)
    out, bits = np.empty((n, len(wanted)), x.dtype), None
    for step in range(wanted[-1] + 1):
        if step % 64 == 0:
            bits = _mixed(flat, walk * 1_000_003 + step // 64)
        for i, w in enumerate(wanted):
            if w == step:
                out[:, i] = flat[at]
        at += (bits[at] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64)
        np.minimum(at, end, out=at)
    return out


def _keys(x: np.ndarray, repetition: int, sampled: int) -> np.ndarray:
    """Key of each row in a repetition: a hash of sampled positions of its embedding."""
    # beyond two words' worth of steps most walks have ended
    chosen = np.sort(np.random.default_rng([repetition, x.shape[1]]).choice(2 * x.shape[1], sampled, replace=False)).tolist()
    key = np.zeros(len(x), np.uint64)
    for p, copied in zip(chosen, embed(x, repetition, chosen).T):
        key = _mixed(key ^ _mixed(copied, 7), p)
    return key


class Index:
    """Items by length, the word pairs of each length and the keys of each repetition."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 0):
        self.vocabulary: dict[bytes, int] = {}
        first: dict[tuple, int] = {}
        for item_id, text in sorted(items, key=lambda x: x[0]):
            if found := words(text):
                first.setdefault(tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found), item_id)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(x) for x in first}):
            group = [x for x in first if len(x) == n]
            self.lengths[n] = np.array(group, np.int32), np.array([first[x] for x in group], np.int64)
        self.similarity, self.size = similarity, len(self.vocabulary) + 1
        pairs: dict[int, int] = defaultdict(int)
        for nth, (x, _) in enumerate(self.lengths.values()):
            for pair in np.unique(x[:, :-1].astype(np.int64) * self.size + x[:, 1:]).tolist():
                pairs[pair] |= 1 << nth % 64  # lengths that share a bit pass each other's windows, none is lost
        self.pairs = np.array(sorted(pairs), np.int64)
        self.in_lengths = np.array([pairs[p] for p in self.pairs.tolist()], np.uint64)
        self.keys: dict[int, list[np.ndarray] | None] = {}
        for n, (x, _) in self.lengths.items():
            often = self._repetitions(n, recall, seed) if allowed(n, similarity) else 0
            self.keys[n] = [_keys(x, r, SAMPLED) for r in range(often)] if often <= MOST_REPETITIONS else None

    def _repetitions(self, n: int, recall: float, seed: int) -> int:
        """Repetitions for the recall on items of ``n`` words edited as much as is allowed."""
        rng, k = np.random.default_rng([seed, n]), allowed(n, self.similarity)
        some = np.repeat(self.lengths[n][0][rng.permutation(len(self.lengths[n][0]))[:6]], 4, axis=0)
        edited = []
        for i, row in enumerate(some):
            copy = row.tolist()
            for _ in range(k):
                kind, at = 1 if i % 2 else rng.integers(3), int(rng.integers(max(1, len(copy))))
                copy[at : at + (kind != 0)] = [] if kind == 1 else [0]
            edited.append((copy + [0] * n)[:n])
        met = np.mean([_keys(some, r, SAMPLED) == _keys(np.array(edited, np.int32), r, SAMPLED) for r in range(TRIALS)], axis=0)
        share = float(np.sort(met)[: max(1, len(met) // 4)].mean())
        if share >= 1:
            return 1
        return math.ceil(math.log(1 - recall) / math.log(1 - share)) if share > 0 else MOST_REPETITIONS + 1

    def windows(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, starts) of the windows around which an item of that length could match; id -1 parts documents."""
        out: list[tuple[int, np.ndarray]] = []
        if not len(ids):
            return out
        spots = bits = np.zeros(0, np.int64)
        if len(self.pairs):
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            pair = ids[both].astype(np.int64) * self.size + ids[both + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[place] == pair
            spots, bits = both[hit], self.in_lengths[place[hit]]
        for nth, n in enumerate(self.lengths):
            k = allowed(n, self.similarity)
            need, reach = n - 1 - 2 * k, n + k - 2
            if need <= 0:  # nothing can be put aside
                out.append((n, np.flatnonzero(ids >= 0)))
                continue
            mine = spots[(bits >> np.uint64(nth % 64) & np.uint64(1)).astype(bool)]
            if len(mine) < need:
                continue
            near = np.flatnonzero(mine[need - 1 :] - mine[: len(mine) - need + 1] <= reach)
            if not len(near):
                continue
            # the starts of a stretch that holds such a run of pairs, as where runs of starts begin and end
            change = np.zeros(len(ids) + 1, np.int32)
            np.add.at(change, np.maximum(mine[near + need - 1] - reach, 0), 1)
            np.add.at(change, mine[near] + 1, -1)
            starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            starts = starts[ids[starts] >= 0]
            if len(starts):
                out.append((n, starts))
        return out

    def _meet(self, n: int, repetition: int, x: np.ndarray) -> np.ndarray:
        """row * items + item of the windows and items with equal keys."""
        order = np.argsort(self.keys[n][repetition], kind="stable")
        known, mine = self.keys[n][repetition][order], _keys(x, repetition, SAMPLED)
        low, high = np.searchsorted(known, mine, "left"), np.searchsorted(known, mine, "right")
        rows = np.repeat(np.arange(len(x)), high - low)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return rows * len(order) + order[np.repeat(low, high - low) + within]

    def _candidates(self, n: int, starts: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, start) of what has to be verified."""
        items = self.lengths[n][0]
        if self.keys[n] is None:
            yield from ((i, s) for i in range(len(items)) for s in starts.tolist())
            return
        for at in range(0, len(starts), 1 << 14):
            part = starts[at : at + (1 << 14)]
            place = part[:, None] + np.arange(n)[None, :]
            x = np.where(place < ends[part][:, None], ids[np.minimum(place, len(ids) - 1)], 0)
            if self.keys[n]:
                met = np.unique(np.concatenate([self._meet(n, r, x) for r in range(len(self.keys[n]))]))
            else:  # no edit is allowed, so equal windows alone match
                known = {row.tobytes(): i for i, row in enumerate(items)}
                found = [(r, known.get(row.tobytes())) for r, row in enumerate(x.astype(np.int32))]
                met = np.array([r * len(items) + i for r, i in found if i is not None], np.int64)
            yield from ((pair % len(items), int(part[pair // len(items)])) for pair in met.tolist())

    def match(self, texts: pa.Array) -> list[dict[int, tuple[int, int, int]]]:
        """For each document: item_id -> (words, least distance found, start of the first stretch that has it)."""
        distinct, place, begin = coded(texts)
        number = np.fromiter((self.vocabulary.get(w, 0) for w in distinct), np.int32, len(distinct))
        ids = np.insert(number[place], begin[1:], -1)
        begins = begin + np.arange(len(begin))  # a mark stands after each document
        size = np.diff(begins)
        document, ends = np.repeat(np.arange(len(size)), size), np.repeat(begins[1:] - 1, size)
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in size]
        for n, starts in self.windows(ids):
            items, names = self.lengths[n]
            k = allowed(n, self.similarity)
            places = defaultdict(list)
            for item, start in self._candidates(n, starts, ids, ends):
                places[int(document[start]), item].append(start)
            for (doc, item), some in places.items():
                for low, high in _merged(sorted(some), n + 2 * k):
                    low, high = max(low - k, int(begins[doc])), min(high + n + k, int(begins[doc + 1]) - 1)
                    d, at = nearest(items[item].tolist(), ids[low:high].tolist())
                    best = out[doc].get(int(names[item]))
                    if d <= k and (best is None or d < best[1]):
                        out[doc][int(names[item])] = (n, d, int(low + at - begins[doc]))
        return out


def _merged(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of runs of starts that are at most ``gap`` apart."""
    low = last = starts[0]
    for s in starts[1:]:
        if s - last > gap:
            yield low, last
            low = s
        last = s
    yield low, last


def build(benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> list[str]:
    """Write an index for each block of items to the shared folder; the files' paths."""
    spark, folder = benchmark.sparkSession, new_folder(benchmark.sparkSession, "benchmark")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [b" ".join(words(t)).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(text, pa.string())], names=["item_id", "text"])

    # items of equal words are one before they are dealt to blocks
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null")
    items = items.mapInArrow(spelled, "item_id bigint, text string").filter("text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * chars // BLOCK_CHARS)) if chars > BLOCK_CHARS else 1

    def write(part: pa.Table) -> pa.Table:
        from pyarrow import fs

        block = part.column("block")[0].as_py()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{block}") as out:
            out.write(pickle.dumps(Index(list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist())), similarity, recall)))
        store.move(f"{root}/.{block}", f"{root}/{block}")
        return pa.table({"path": [f"{folder}/{block}"]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    return sorted(r.path for r in dealt.groupBy("block").applyInArrow(write, "path string").collect())


def _index(path: str) -> Index:
    """The block at ``path``; a worker keeps the one it used last."""
    from pyarrow import fs

    def read() -> Index:
        store, root = fs.FileSystem.from_uri(path)
        with store.open_input_stream(root) as data:
            return pickle.loads(data.read())

    return held(path, read)


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, n_words, distance and start (in words) of each item found in a document."""
    paths, out = build(benchmark, similarity, recall), "doc_id bigint, item_id bigint, n_words int, distance int, start bigint"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("distance", pa.int32()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            keys = batch.column("doc_id").to_pylist()
            for path in paths:
                rows = [(key, item, *m) for key, found in zip(keys, _index(path).match(batch.column("text"))) for item, m in sorted(found.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    paths = build(benchmark, similarity, recall)

    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        out: list[bool] = []
        for part in by_bytes(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]), "text", SLICE):
            kept = np.ones(part.num_rows, bool)
            for path in paths:
                kept &= [not m for m in _index(path).match(part.column("text"))]
            out += kept.tolist()
        return pd.Series(out, dtype=bool)

    return docs.filter(clean("text"))

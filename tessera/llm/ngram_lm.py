"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The filter holds the quantised counts of all training words and word pairs: an
n-gram of level q is stored with each of the levels 1 to q. Its count is found
by probing level after level until one is missing, and smoothed probabilities
interpolate what is found for the pair with the add-half estimate of the word.

The filter grows with the corpus, so it is split into parts by hash of the
n-gram, each of about ``PART_TOKENS`` training tokens, and no worker holds more
than one part at once: a block of documents sends its distinct n-grams to the
parts they belong to and gets back one level, a byte, for each. The parts also
hold the exact counts of their words, for the base score.

Texts are read once. A block is a run of neighbouring documents of about
``BLOCK_BYTES``; it becomes the keys of its distinct words and the place of each
token among them, and all later passes start from that. Words are keyed by
their 64-bit XXH64 hash. Pairs are keyed by ``SPARE_BITS`` bits more than the
number of tokens has, so at any size an unseen pair takes another one's key in
one of 2 ** SPARE_BITS cases at most.

Defined results: a null text counts as empty and has one token, the end; a null
doc_id counts as an empty text where folds are dealt; repeated rows are scored
one by one; a text of any length is scored whole, in one block; with no training
document counts are zero; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, in_fold, parts_between, text_bytes

BASE = math.sqrt(2)
BITS = 14
HASHES = 8
PAIR_WEIGHT = 0.7
BLOCK_BYTES = 12_000_000
PART_TOKENS = 2_000_000  # training tokens for each part of the filter
SPARE_BITS = 14
END = b""


def word_key(word: bytes) -> int:
    x = xxhash.xxh64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def pair_keys(before: np.ndarray, word: np.ndarray, bits: int = 64) -> np.ndarray:
    """Key of ``bits`` bits for each pair of word keys."""
    return _mix(_mix(before.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15) * (word.view(np.uint64) | np.uint64(1))) >> np.uint64(64 - bits)


def levels(counts: np.ndarray, least: float) -> np.ndarray:
    """Quantised logarithm of counts of at least ``least``, from 1."""
    return 1 + np.floor(np.log(np.maximum(counts, least) / least) / math.log(BASE) + 1e-9).astype(np.int64)


class Bloom:
    """A filter over (key, level)."""

    def __init__(self, entries: int):
        self.words = max(1, -(-entries * BITS // 64))
        self.bits = np.zeros(self.words, np.uint64)

    @staticmethod
    def hashes(keys: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
        a = _mix(keys.view(np.uint64) + np.asarray(level, np.uint64) * np.uint64(0xD1342543DE82EF95))
        return a, _mix(a + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def places(self, keys: np.ndarray, level) -> Iterator[np.ndarray]:
        a, b = self.hashes(keys, level)
        for i in range(HASHES):
            yield (a + np.uint64(i) * b) % np.uint64(self.words * 64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Bloom:
        """Store each key with all levels up to its count's."""
        flags, q = np.zeros(self.words * 64, bool), levels(counts.astype(float), 1.0)
        for level in range(1, int(q.max(initial=0)) + 1):
            for place in self.places(keys[q >= level], level):
                flags[place] = True
        self.bits |= np.packbits(flags, bitorder="little").view("<u8")
        return self

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probes go on while the next level is there."""
        out, left, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(left):
            level += 1
            a, b = self.hashes(keys[left], level)
            for i in range(HASHES):
                place = (a + np.uint64(i) * b) % np.uint64(self.words * 64)
                on = (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                left, a, b = left[on], a[on], b[on]
            out[left] = level
        return out


class Block:
    """Neighbouring documents: the keys of their distinct words, each token's place among them and each document's tokens."""

    def __init__(self, keys: np.ndarray, place: np.ndarray, size: np.ndarray):
        self.keys, self.place, self.size = keys, place, size
        self.start = np.cumsum(size) - size

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        """Words are runs of what is no ASCII white space, in lower case A-Z; each document has an end after them."""
        data, ends = text_bytes(texts)
        data = np.frombuffer(data.tobytes().lower(), np.uint8)
        inside = (data != 32) & (data - np.uint8(9) > 4)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[ends[:-1][ends[:-1] < len(data)]] |= inside[ends[:-1][ends[:-1] < len(data)]]
        begin = np.flatnonzero(first)
        size = np.diff(np.searchsorted(begin, ends))
        place_of = np.cumsum(inside) - inside  # where a byte stands once white space is left out
        distinct, place = parts_between(data[inside], np.append(place_of[begin], inside.sum()))
        keys = np.fromiter(map(word_key, [*distinct.to_pylist(), END]), np.int64, len(distinct) + 1)
        place = np.insert(place, np.cumsum(size), len(distinct))
        times = np.bincount(place, minlength=len(keys))
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return cls(keys[order], rank[place].astype(np.int32), size + 1)

    def before(self) -> np.ndarray:
        """Place of the word before each token; the end's before the first of a document."""
        end = int(np.flatnonzero(self.keys == word_key(END))[0])
        out = np.concatenate([[end], self.place[:-1]]).astype(np.int64)
        out[self.start] = end
        return out

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of each distinct pair of neighbours, and the place of each token's pair among them."""
        _, first, at = np.unique(self.before() * len(self.keys) + self.place, return_index=True, return_inverse=True)
        return pair_keys(self.keys[self.before()[first]], self.keys[self.place[first]], bits), at

    def some(self, held: np.ndarray) -> Block:
        """The documents for which ``held`` is true."""
        return Block(self.keys, self.place[np.repeat(held, self.size)], self.size[held])


class Model:
    """Levels of n-grams, turned into counts and probabilities."""

    def __init__(self, total: int, distinct: int):
        self.total, self.distinct = total, distinct

    @staticmethod
    def counts(found: np.ndarray) -> np.ndarray:
        """Estimated counts: the middle of the level found, 0 for what isn't in the filter."""
        return np.where(found > 0, BASE ** (found - 1.0) * (1 + BASE) / 2, 0.0)

    def log10(self, block: Block, words: np.ndarray, pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each token of the block after the one before it, from the levels of words and pairs."""
        single = self.counts(words)
        alone = ((single + 0.5) / (self.total + 0.5 * (self.distinct + 1)))[block.place]
        seen = single[block.before()]
        pair = np.divide(self.counts(pairs)[at], seen, out=np.zeros(len(at)), where=(seen > 0) & (single[block.place] > 0))
        weight = np.where(seen > 0, PAIR_WEIGHT, 0.0)
        return np.log10(weight * np.minimum(1.0, pair) + (1 - weight) * alone)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that their zero bytes stand together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def _of_planes(x: bytes, kind=np.int64) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(wide, -1).T).view(kind).reshape(-1)


def _packed(keys: np.ndarray) -> bytes:
    """Keys in unsigned order as differences."""
    return _planes(np.diff(keys.view(np.uint64), prepend=np.uint64(0)))


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(x, np.uint64), dtype=np.uint64).view(np.int64)


def _bounds(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each part's keys begin and end; parts are ranges of unsigned keys of ``bits`` bits, in whose order ``keys`` are."""
    high = keys.view(np.uint64) >> np.uint64(bits - 32) if bits > 32 else keys.view(np.uint64) << np.uint64(32 - bits)
    return np.searchsorted(high * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _by_part(block: Block, parts: int, bits: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], list[tuple[int, slice, slice]]]:
    """Order of words and their keys in it, the same of pairs, and the slices of both for each part that has any."""
    pair = block.pairs(bits)[0]
    word_order, pair_order = np.argsort(block.keys.view(np.uint64)), np.argsort(pair.view(np.uint64))
    words, pairs = block.keys[word_order], pair[pair_order]
    w, p = _bounds(words, parts, 64), _bounds(pairs, parts, bits)
    some = np.flatnonzero(np.diff(w) + np.diff(p)).tolist()
    return (word_order, words), (pair_order, pairs), [(i, slice(w[i], w[i + 1]), slice(p[i], p[i + 1])) for i in some]


_CODED = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("n_train", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("size", pa.binary()), ("keys", pa.binary()), ("place", pa.binary())])
CODED = "block bigint, n bigint, n_train bigint, doc_ids array<bigint>, held array<boolean>, size binary, keys binary, place binary"


def coded(docs: DataFrame) -> DataFrame:
    """A row for each block of ``docs`` (doc_id, text, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, "text", BLOCK_BYTES):
            block = Block.of(batch.column("text"))
            n_train = int(block.size[~batch.column("held").to_numpy(zero_copy_only=False)].sum())
            row = ((part << 32) + nth, len(block.place), n_train, batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), _planes(block.size), _planes(block.keys), _planes(block.place))
            nth += 1
            yield _table([row], _CODED)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "held").mapInArrow(run, CODED)


def _read(row: dict) -> Block:
    return Block(_of_planes(row["keys"]), _of_planes(row["place"], np.int32), _of_planes(row["size"]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for nth in range(batch.num_rows):
            yield from batch.slice(nth, 1).to_pylist()


def distinct_words(blocks: DataFrame, parts: int) -> int:
    """Number of distinct words of the training documents; each part of the keys is counted in its own task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _read(row).some(~np.array(row["held"], bool))
            words = np.sort(block.keys[np.bincount(block.place, minlength=len(block.keys)) > 0].view(np.uint64))
            at = _bounds(words, parts, 64)
            yield _table([(i, _packed(words[at[i] : at[i + 1]])) for i in np.flatnonzero(np.diff(at)).tolist()], pa.schema([("part", pa.int64()), ("words", pa.binary())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for row in _rows(batches):
            held.append(_unpacked(row["words"]))
            if sum(map(len, held)) > PART_TOKENS:
                held = [np.unique(np.concatenate(held))]
        yield pa.RecordBatch.from_pydict({"n": [len(np.unique(np.concatenate(held))) if held else 0]})

    cells = blocks.filter("n_train > 0").select("held", "size", "keys", "place").mapInArrow(run, "part bigint, words binary")
    return cells.repartitionById(parts, F.col("part").cast("int")).select("words").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0


# a cell: n-grams of a block that belong to a part; with counts those of its training documents, without those it asks for
_CELLS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), ("n_words", pa.binary()), ("n_pairs", pa.binary())])
CELLS = "part bigint, block bigint, words binary, pairs binary, n_words binary, n_pairs binary"


def _counted(row: dict, parts: int, bits: int) -> pa.RecordBatch:
    """A cell for each part with the keys and counts of a block's training n-grams that belong to it."""
    block = _read(row).some(~np.array(row["held"], bool))
    times, each = np.bincount(block.place, minlength=len(block.keys)), np.bincount(block.pairs(bits)[1])
    (w_order, words), (p_order, pairs), cells = _by_part(block, parts, bits)
    times, each, rows = times[w_order], each[p_order], []
    for part, w, p in cells:
        on = times[w] > 0  # words of other documents alone are no training words
        rows.append((part, None, _packed(words[w][on]), _packed(pairs[p]), _planes(times[w][on]), _planes(each[p])))
    return _table(rows, _CELLS)


def _asked(row: dict, parts: int, bits: int) -> pa.RecordBatch:
    """A cell for each part with the keys of a block's n-grams that belong to it."""
    (_, words), (_, pairs), cells = _by_part(_read(row), parts, bits)
    return _table([(part, row["block"], _packed(words[w]), _packed(pairs[p]), None, None) for part, w, p in cells], _CELLS)


def _summed(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in unsigned order, and the sums of their counts."""
    keys, counts = np.concatenate(h).view(np.uint64), np.concatenate(n)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    return keys[first].view(np.int64), np.add.reduceat(counts, first) if len(first) else counts


def _apart(pairs: np.ndarray) -> np.ndarray:
    """Pairs' keys moved away from words' keys, as both stand in one filter."""
    return _mix(pairs.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F)).view(np.int64)


class Part:
    """One part of the filter, and its words with exact counts, from cells with counts."""

    def __init__(self) -> None:
        self.cells: list[list[np.ndarray]] = [[], [], [], []]
        self.held = 0

    def add(self, row: dict) -> None:
        for into, x in zip(self.cells, (_unpacked(row["words"]), _of_planes(row["n_words"]), _unpacked(row["pairs"]), _of_planes(row["n_pairs"]))):
            into.append(x)
            self.held += len(x)
        if self.held > 4 * PART_TOKENS:  # what repeats is summed before more is held
            self._sum()

    def _sum(self) -> None:
        if self.cells[0]:
            words, pairs = _summed(*self.cells[:2]), _summed(*self.cells[2:])
            self.cells, self.held = [[x] for x in (*words, *pairs)], 0

    def close(self) -> Part:
        self._sum()
        self.words, self.n, pairs, m = (x[0] if x else np.zeros(0, np.int64) for x in self.cells)
        counts = np.concatenate([self.n, m])
        self.bloom = Bloom(int(levels(counts.astype(float), 1.0).sum())).add(np.concatenate([self.words, _apart(pairs)]), counts)
        self.cells = []
        return self

    def counts(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        known, words = self.words.view(np.uint64), words.view(np.uint64)
        place = np.minimum(np.searchsorted(known, words), len(known) - 1)
        return np.where(known[place] == words, self.n[place], 0)


_TOLD = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.binary()), ("word_levels", pa.binary()), ("pair_levels", pa.binary())])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the parts know of the n-grams that blocks ask for: exact counts of words, and levels (a byte each) of words and pairs.

    Rows come by part, those with counts first, so one part is held at a time.
    """
    at, part, rows = None, Part(), []
    for row in _rows(batches):
        if row["part"] != at:
            at, part = row["part"], Part()
        if row["block"] is None:
            part.add(row)
            continue
        if not hasattr(part, "bloom"):
            part.close()
        words, pairs = _unpacked(row["words"]), _unpacked(row["pairs"])
        found = (part.counts(words), part.bloom.level(words).astype(np.uint8), part.bloom.level(_apart(pairs)).astype(np.uint8))
        rows.append((row["block"], at, *map(_planes, found)))
        if len(rows) == 64:
            yield _table(rows, _TOLD)
            rows = []
    if rows:
        yield _table(rows, _TOLD)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _rated(row: dict, told: pa.Table, total: int, distinct: int, parts: int, bits: int) -> pa.RecordBatch:
    block = _read(row)
    (word_order, _), (pair_order, _), _ = _by_part(block, parts, bits)
    told = told.sort_by("part")
    column = lambda c, kind: np.concatenate([_of_planes(x, kind) for x in told.column(c).to_pylist()])
    count, words, pairs = (np.zeros(len(x), np.int64) for x in (word_order, word_order, pair_order))
    count[word_order], words[word_order], pairs[pair_order] = column("n", np.int64), column("word_levels", np.uint8), column("pair_levels", np.uint8)
    base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))[block.place]
    score = Model(total, distinct).log10(block, words, pairs, block.pairs(bits)[1])
    sums = [np.add.reduceat(x, block.start) for x in (base, score, (count > 0)[block.place].astype(np.int64))]
    return _table(list(zip(row["doc_ids"], row["held"], block.size.tolist(), sums[2].tolist(), [total] * len(block.size), sums[0].tolist(), sums[1].tolist())), _SCORED)


def score(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """Scores of all rows by a model of those for which ``training`` (on doc_id) holds."""
    training = ~in_fold(F.col("doc_id"), 1) if training is None else training
    # written once, so that all passes see the same blocks
    blocks = cut(coded(docs.select("doc_id", "text", (~training).alias("held"))))
    tokens, total, n = blocks.agg(F.sum("n"), F.sum("n_train"), F.count("*")).first()
    tokens, total, n = int(tokens or 0), int(total or 0), max(1, n)
    bits = min(63, tokens.bit_length() + SPARE_BITS)
    parts = max(1, -(-total // PART_TOKENS))
    distinct = distinct_words(blocks, parts)
    each = lambda make: lambda batches: (make(row, parts, bits) for row in _rows(batches))
    needed = blocks.select("block", "held", "size", "keys", "place", "n_train")
    cells = needed.filter("n_train > 0").mapInArrow(each(_counted), CELLS).unionByName(needed.mapInArrow(each(_asked), CELLS))
    dealt = cells.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.col("block").asc_nulls_first())
    told = dealt.mapInArrow(_probe, "block bigint, part bigint, n binary, word_levels binary, pair_levels binary")

    def rate(mine: pa.Table, known: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rated(row, known, total, distinct, parts, bits) for row in mine.to_pylist()])

    return blocks.repartition(n, "block").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(rate, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

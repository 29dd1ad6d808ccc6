"""Alignment of two tokenizers' tokens by the bytes that they cover.

Each byte of a text gets a label: ``n`` if no token ends there, ``a`` or ``b``
if one of A or of B does, ``x`` if both do. A regular expression takes each
stretch up to an ``x``; the labels counted in it say how many tokens of A and B
form the group. An A token and a B token are linked when they share a group.

A space after a character that is no white space begins a pre-token of A and a
piece of B whatever stands around it, so texts are cut there into units, and
the distinct units of a slice are encoded and aligned once.

What a pair of ids counts is a fact of the whole corpus: the number of documents
that hold it linked. A slice of documents (a block) is written once, its
documents with their links and its distinct pairs with the block's counts. The
pairs are added up over blocks, each block gets the totals of its own pairs
back by a join, and documents meet them by block. So a pair that every document
holds has one row for each block, not for each document, and links are never
spelled out: they are pairs with how often they stand in a document.

Defined results: a text that is null or empty, or whose tokens don't spell it
(a piece mark in the text, for one), has no tokens: its counts are zero and its
digest is the empty text. Repeated rows are documents of their own in the
counts; null ids are kept; texts of any length are one document of one block;
an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, held, new_folder, parts_between, text_bytes

SLICE = 4_000_000  # bytes of text in a block
TOGETHER = 50_000  # bytes of units encoded as one text
MARK = "▁"
# Fixed value: how a byte-level tokenizer cuts text into words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UP_TO_BOTH = re.compile(b"[nab]*x")


def spelled_byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each entry of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    value = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(value[c] for c in entry) if all(c in value for c in entry) else entry.encode()
    return out


def byte_level(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """What encodes texts by a tokenizer file, special tokens' strings as plain text, and the bytes of its entries.

    A plain byte-level BPE whose merges are numbered as its entries is encoded
    by ranks, which is the same and several times as fast; others by the
    tokenizers library.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    spelled = spelled_byte_level(whole.get_vocab())
    by_library = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    told = json.loads(Path(path).read_text())
    vocabulary, merges, before = told["model"].get("vocab"), told["model"].get("merges"), told["pre_tokenizer"] or {}
    plain = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    plain = plain and told["model"]["type"] == "BPE" and not any(told["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    plain = plain and all(t["special"] for t in told["added_tokens"])
    joined = lambda m: "".join(m if isinstance(m, list) else m.split(" "))
    if not plain or len(vocabulary) != 256 + len(merges) or any(vocabulary[joined(m)] != 256 + i for i, m in enumerate(merges)):
        return by_library, spelled
    import tiktoken

    ranks = {spelled[i]: i for i in vocabulary.values()}
    by_rank = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: list(map(by_rank.encode_ordinary, texts)), spelled


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of a group as a * 2**32 + b, and how often each is linked."""
    a, a_times = np.unique(a, return_counts=True)
    b, b_times = np.unique(b, return_counts=True)
    return (a[:, None] << 32 | b).ravel(), (a_times[:, None] * b_times).ravel()


def _inside(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as ``length`` says, in a row."""
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Units:
    """Aligned units: for each, tokens and groups, its groups as text, and its links as pairs with how often they stand in it."""

    def __init__(self, aligner: Aligner, data: np.ndarray, ends: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
        """``a`` and ``b``: ids in a row, and where each unit's begin and the last end; ``data`` and ``ends``: the units' bytes."""
        n = len(ends) - 1
        self.spelled = _spells(aligner.a_spelled, *a, data, ends) & _spells(aligner.b_spelled, *b, data, ends)
        keep = self.spelled
        width = np.where(keep, np.diff(ends), 0)
        size = np.cumsum(width)
        a_ids, self.n_a = _kept(*a, keep)
        b_ids, self.n_b = _kept(*b, keep)
        # n 0, a 1, b 2, x 3 as characters of the label string
        label = np.zeros(int(size[-1]) if n else 0, np.uint8)
        a_ends, b_ends = np.cumsum(aligner.a_width[a_ids]), np.cumsum(aligner.b_width[b_ids])
        label[a_ends - 1] = 1
        label[b_ends - 1] += 2
        label = np.frombuffer(b"nabx", np.uint8)[label].tobytes()
        cuts = np.cumsum(np.fromiter(map(len, UP_TO_BOTH.findall(label)), np.int64))
        unit = np.searchsorted(size, cuts)  # the unit that each group is in
        self.n_groups = np.bincount(unit, minlength=n)
        # tokens up to each group's end: the labels a or x, and b or x, up to there
        a_to, b_to = np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right")
        a_first, b_first = np.concatenate([[0], a_to[:-1]])[: len(cuts)], np.concatenate([[0], b_to[:-1]])[: len(cuts)]
        a_size, b_size = a_to - a_first, b_to - b_first
        self.texts = self._said(aligner, a_ids, b_ids, a_to, b_to, a_size, b_size, unit, n)
        # links: groups of few pairs are spelled out, others are counted by distinct ids
        small = a_size * b_size <= 64
        count = np.where(small, a_size * b_size, 0)
        at = _inside(np.zeros(len(cuts), np.int64), count)
        wide = np.repeat(b_size, count)
        keys = a_ids[np.repeat(a_first, count) + at // np.maximum(wide, 1)] << 32 | b_ids[np.repeat(b_first, count) + at % np.maximum(wide, 1)]
        parts, times, of = [keys], [np.ones(len(keys), np.int64)], [np.repeat(unit, count)]
        for g in np.flatnonzero(~small).tolist():
            k, t = links(a_ids[a_first[g] : a_to[g]], b_ids[b_first[g] : b_to[g]])
            parts.append(k)
            times.append(t)
            of.append(np.full(len(k), unit[g]))
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        self.keys, self.times = np.concatenate(parts)[order], np.concatenate(times)[order]
        self.size = np.bincount(of, minlength=n)

    def _said(self, aligner: Aligner, a_ids, b_ids, a_to, b_to, a_size, b_size, unit, n) -> pa.Array:
        """``a1,a2|b1;`` of all groups of each unit."""
        # entries of the table of numbers: A with a comma, A with a bar, B with a comma, B with a semicolon
        a_entry, b_entry = a_ids.copy(), b_ids + 2 * len(aligner.a_width)
        a_entry[a_to - 1] += len(aligner.a_width)
        b_entry[b_to - 1] += len(aligner.b_width)
        both = np.empty(len(a_ids) + len(b_ids), np.int64)
        start = np.cumsum(a_size + b_size) - (a_size + b_size)
        both[_inside(start, a_size)] = a_entry
        both[_inside(start + a_size, b_size)] = b_entry
        data, ends = text_bytes(aligner.numbers.take(pa.array(both)))
        groups = np.bincount(unit, weights=a_size + b_size, minlength=n).astype(np.int64)
        offsets = ends[np.concatenate([[0], np.cumsum(groups)])]
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _kept(ids: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the kept units in a row, and the number of each unit's, 0 for the others."""
    size = np.where(keep, np.diff(starts), 0)
    return ids[np.repeat(keep, np.diff(starts))], size


def _spells(spelled: pa.Array, ids: np.ndarray, starts: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each unit's tokens are those of the unit."""
    told, to = text_bytes(spelled.take(pa.array(ids)))
    to = to[starts]
    right = np.diff(to) == np.diff(ends)
    if right.all():
        wrong = np.flatnonzero(told != data)
        right[np.unique(np.searchsorted(ends, wrong, "right") - 1)] = False
    else:
        for i in np.flatnonzero(right).tolist():
            right[i] = np.array_equal(told[to[i] : to[i + 1]], data[ends[i] : ends[i + 1]])
    return right


class Aligner:
    """Both tokenizers over units, and what their entries spell."""

    def __init__(self, byte_bpe: str, piece_model: str):
        import sentencepiece

        self.a, a_bytes = byte_level(byte_bpe)
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = map(sp.id_to_piece, range(sp.get_piece_size()))
        b_bytes = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(pieces)]
        self.a_width, self.b_width = (np.fromiter(map(len, x), np.int64) for x in (a_bytes, b_bytes))
        self.a_spelled, self.b_spelled = (pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes))
        ends = ((a_bytes, b","), (a_bytes, b"|"), (b_bytes, b","), (b_bytes, b";"))
        self.numbers = pa.array([b"%d" % i + end for entries, end in ends for i in range(len(entries))], pa.large_binary())

    def _ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of texts that begin with a space."""
        mark = [self.b.piece_to_id(MARK)]  # the library puts a mark before what isn't empty; a text of one space is that mark alone
        return [np.array(x, np.int64) for x in self.a(texts)], [np.array(x or mark, np.int64) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def align(self, data: np.ndarray, ends: np.ndarray, together: int) -> Units:
        """Units whose bytes stand in a row.

        The first ``together`` units end in what is surely no white space, so
        both models cut there and many are encoded as one text; the others alone.
        """
        whole, n = data.tobytes(), len(ends) - 1
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[together]), TOGETHER)), together))
        edges = [*cuts.tolist(), *range(together + 1, n + 1)]
        spans = list(zip(edges, edges[1:]))
        a, b = self._ids([whole[ends[i] : ends[j]].decode("utf-8", "surrogatepass") for i, j in spans]) if spans else ([], [])
        sides: tuple[list, list] = ([], [])
        for (i, j), *both in zip(spans, a, b):
            found = [_counts(ids, width, ends[i : j + 1]) for ids, width in zip(both, (self.a_width, self.b_width))] if j > i + 1 else [[len(x)] for x in both]
            if any(x is None for x in found):  # tokens that don't spell the text: each unit alone
                alone = self._ids([whole[x:y].decode("utf-8", "surrogatepass") for x, y in zip(ends[i:j].tolist(), ends[i + 1 : j + 1].tolist())])
                both, found = [np.concatenate(x) for x in alone], [list(map(len, x)) for x in alone]
            for side, ids, counts in zip(sides, both, found):
                side.append((ids, counts))
        flat = []
        for side in sides:
            sizes = np.concatenate([np.zeros(1, np.int64), *(c for _, c in side)]).astype(np.int64)
            flat.append((np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in side)]), np.cumsum(sizes)))
        return Units(self, data, ends, *flat)


def _counts(ids: np.ndarray, width: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """Tokens of each of the units that end at ``ends[1:]``; None where tokens don't end with the units."""
    to = np.cumsum(width[ids]) + ends[0]
    at = np.searchsorted(to, ends[1:])
    if not len(to) or to[-1] != ends[-1] or (to[at] != ends[1:]).any():
        return None
    return np.diff(at, prepend=-1)


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where texts, each led by a space, begin and may be cut, and where the last ends: at a space after what is surely no white space."""
    cut = np.zeros(len(data) + 1, bool)
    before = data[:-1]
    cut[1:-1] = (data[1:] == 32) & (before > 32)
    for i in np.flatnonzero(cut[1:-1] & (before > 127)) + 1:  # white space beyond ASCII begins with C2, or with E1 to E3
        if data[max(i - 2, 0)] == 0xC2 or 0xE1 <= data[max(i - 3, 0)] <= 0xE3:
            cut[i] = False
    cut[ends] = True
    return np.flatnonzero(cut)


def align_slice(aligner: Aligner, texts: pa.Array) -> tuple[dict, tuple[np.ndarray, ...]]:
    """Columns of the slice's documents, and its distinct pairs: number, a, b and the documents that hold them linked."""
    data, ends = text_bytes(texts)
    some = np.diff(ends) > 0
    data = np.insert(data, ends[:-1][some], 32)
    ends = ends + np.concatenate([[0], np.cumsum(some)])
    starts = _cuts(data, ends) if len(data) else ends[:1]
    distinct, place = parts_between(data, starts)
    data, ends_of = text_bytes(distinct)
    last = data[ends_of[1:] - 1] if len(distinct) else data[:0]
    sure = (last > 32) & (last < 127)
    order = np.argsort(~sure, kind="stable")
    place = np.argsort(order)[place]
    units = aligner.align(*text_bytes(distinct.take(pa.array(order))), int(sure.sum()))
    first, rows, n = np.searchsorted(starts, ends), len(ends) - 1, max(len(distinct), 1)  # each text's first unit
    text = np.repeat(np.arange(rows), np.diff(first))
    right = np.bincount(text[~units.spelled[place]], minlength=rows) == 0
    text, place = text[right[text]], place[right[text]]

    along = lambda values, at: np.diff(np.concatenate([[0], np.cumsum(values)])[at])
    edges = np.searchsorted(text, np.arange(rows + 1))
    columns: dict = {name: along(values[place], edges) for name, values in (("n_a", units.n_a), ("n_b", units.n_b), ("n_groups", units.n_groups))}
    said, at = text_bytes(units.texts.take(pa.array(place)))
    said, at = said.tobytes(), at[edges].tolist()
    columns["groups_sha256"] = [hashlib.sha256(said[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(at, at[1:])]

    # distinct units of each document, then distinct pairs of each document
    uses, often = np.unique(text * n + place, return_counts=True)
    doc, unit = np.divmod(uses, n)
    keys, inside = np.unique(units.keys, return_inverse=True)
    length = units.size[unit]
    which = _inside((np.cumsum(units.size) - units.size)[unit], length)
    code = np.repeat(doc, length) * max(len(keys), 1) + inside[which]
    order = np.argsort(code, kind="stable")
    code, weight = code[order], (units.times[which] * np.repeat(often, length))[order]
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    linked = np.add.reduceat(weight, begins) if len(begins) else weight
    doc, pair = np.divmod(code[begins], max(len(keys), 1))
    cuts = np.searchsorted(doc, np.arange(rows + 1))
    columns["n_links"] = along(linked, cuts)
    columns["pairs"] = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(pair.astype(np.int32)))
    columns["times"] = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(linked.astype(np.int32)))
    docs = np.bincount(pair, minlength=len(keys))
    used = np.flatnonzero(docs)
    return columns, (used, keys[used] >> 32, keys[used] & 0xFFFFFFFF, docs[used])


BLOCKS = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>, pair int, a int, b int, docs bigint"


def blocks(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """Rows of documents and rows of pairs (those with ``pair``), by block."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def batch(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        made = (pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(rows, f.type)) for f in schema)
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("align", byte_bpe, piece_model), lambda: Aligner(byte_bpe, piece_model))
        number = TaskContext.get().partitionId() << 32
        for part in by_bytes(batches, "text", SLICE):
            columns, (pair, a, b, times) = align_slice(aligner, part.column("text"))
            yield batch(block=np.full(part.num_rows, number), doc_id=part.column("doc_id").cast(pa.int64()), **columns)
            for at in range(0, len(pair), 20_000):
                some = slice(at, at + 20_000)
                yield batch(block=np.full(len(pair[some]), number), pair=pair[some].astype(np.int32), a=a[some].astype(np.int32), b=b[some].astype(np.int32), docs=times[some])
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _meet(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a block with what their links count."""
    number, total, best = (pairs.column(c).to_numpy() for c in ("pair", "total", "best"))
    size = int(number.max()) + 1 if len(number) else 0
    totals, bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
    totals[number], bests[number] = total, best
    held_by, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    at, n = held_by.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(held_by.value_lengths().to_numpy())])
    summed = lambda values: np.diff(np.concatenate([[0], np.cumsum(n * values[at])])[edges])
    plain = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(plain | {"n_best": summed(bests), "count_sum": summed(totals), "groups_sha256": docs.column("groups_sha256")})


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, total (documents that hold the pair linked) and best (no other b of a has more)."""
    totals = pairs.groupBy("a", "b").agg(F.sum("docs").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("a")))


def align(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """Tokens, groups, links and what the links count, for each document."""
    spark = docs.sparkSession
    folder = new_folder(spark, "align")
    blocks(docs, byte_bpe, piece_model).write.parquet(folder)
    made = lambda: spark.read.schema(BLOCKS).parquet(folder)
    pairs = made().filter("pair is not null").select("block", "pair", "a", "b", "docs")
    told = pairs.join(pair_counts(pairs), ["a", "b"]).select("block", "pair", "total", "best")
    rows = made().filter("pair is null").drop("pair", "a", "b", "docs")
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_meet, RESULT)

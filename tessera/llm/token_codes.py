"""Token ids in files of directly addressable codes.

Ids are cut into chunks of eight bits. The first level holds the lowest chunk
of every id and a bitmap that tells which ids go on; the next level holds the
next chunks of those alone, and so on. The rank directory of a bitmap has the
number of set bits before each block, so the chunk that continues an id is
found by one lookup and a count within a block: any token is read without
decoding another.

File: ``MAGIC``, then little-endian: documents and tokens (int64 each), levels
(int64), doc ids (int64) and a byte for each telling whether it is null, the
start of each document and the end (int64), then each level: number of chunks
(int64), chunks (uint8), bitmap (bytes, padded), directory (uint32).

Documents are dealt by ranges of doc_id, so file order is ascending doc_id. A
task closes a file at ``FILE_TOKENS`` tokens, or at ``SLICE`` bytes of text, and
names it by its partition and number; it is written aside and then moved, so a
task that runs again replaces what it wrote. Paths go through pyarrow's file
systems.

The library's plain call is followed: a special token's string in a text is that
token. ``specials=False`` reads it as ordinary text instead.

Defined results: a null text counts as empty and is its end id alone; documents
of equal id keep together, in the order of their texts' hashes; null ids come
first; repeated rows are written one by one; a text of any length is one
document of one file; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, held, new_folder, parts_between, text_bytes

END = 2
FILE_TOKENS = 2_000_000
CACHED_UNITS = 1_000_000
MAGIC = b"TDAC0001"
BLOCK = 512  # bits of a bitmap for each entry of its directory

FILES = "part bigint, nth bigint, name string, tokens bigint"
SLICE = 8_000_000  # bytes of text encoded together


def _unit_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that what lies between encodes alone.

    No pre-token goes on from a character that is no white space to one that
    is, nor from a letter to a stop or comma. Before white space the cut is
    left out if the character there may be Unicode white space.
    """
    before = data[:-1]
    blank, after = (data == 32) | (data - np.uint8(9) < 5), before > 32
    cut = np.zeros(len(data) + 1, bool)
    wide = np.flatnonzero(blank[1:] & (before > 127))
    if len(wide):  # U+0085 and U+00A0 begin with C2, all others with E1, E2 or E3
        lead = data[np.maximum(wide - 2, 0)]
        after[wide[(data[np.maximum(wide - 1, 0)] == 0xC2) | ((lead >= 0xE1) & (lead <= 0xE3))]] = False
    cut[1:-1] = blank[1:] & after
    cut[1:-1] |= _MARKS[data[1:]] & _LETTERS[before]
    cut[ends] = True
    return np.flatnonzero(cut)


_MARKS, _LETTERS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".,;:!?", bytes(c for c in range(128) if chr(c).isalpha())))


class Encoder:
    """Byte-level BPE of whole texts; the ids of each distinct unit are found once and kept.

    ``specials`` False reads the strings of special tokens in a text as
    ordinary text, not as these tokens.
    """

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        # texts that hold an added token are given to the library whole
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if specials or not t.special]
        self.added = re.compile("|".join(re.escape(t.content) for t in added).encode()) if added else None
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the distinct units in a row, and the number of each one's."""
        units = distinct.to_pylist()
        new = [u for u in units if u not in self.known]
        fresh = dict(zip(new, self._encode([u.decode("utf-8", "surrogatepass") for u in new])))
        if len(self.known) + len(fresh) <= CACHED_UNITS:
            self.known.update(fresh)
            ids = [self.known[u] for u in units]
        else:  # the units met first stay; when there are enough, others are encoded each time
            known = self.known.get
            ids = [fresh[u] if (x := known(u)) is None else x for u in units]
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by ``end`` if given, and where each text's begin and the last end."""
        data, ends = text_bytes(texts)
        whole = data.tobytes()
        special = sorted({int(np.searchsorted(ends, m.start(), "right")) - 1 for m in self.added.finditer(whole)}) if self.added and self.added.search(whole) else []
        starts = _unit_starts(data, ends) if len(data) else ends[:1]
        if special:  # one unit for such a text, so nothing is cut inside it
            inside = np.zeros(len(data) + 1, bool)
            for d in special:
                inside[ends[d] + 1 : ends[d + 1]] = True
            starts = starts[~inside[starts]]
        distinct, place = parts_between(data, starts)
        ids, size = self._units(distinct)
        first = np.searchsorted(starts, ends)  # each text's first unit
        length = size[place]
        total = np.concatenate([[0], np.cumsum(length)])
        begin = total[first]
        from_ = np.repeat((np.cumsum(size) - size)[place] - total[:-1], length)
        out = ids[from_ + np.arange(len(from_))]
        if end is not None:
            out = np.insert(out, begin[1:], np.uint32(end))
            begin = begin + np.arange(len(begin))
        return out, begin


def pack(ids: np.ndarray) -> bytes:
    """The levels of directly addressable codes of the ids."""
    parts, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        counts = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        before = (np.cumsum(counts) - counts).astype("<u4")
        parts += [np.int64(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), before.tobytes()]
        rest = rest[more] >> 8
    levels = len(parts) // 4
    return np.int64(levels).tobytes() + b"".join(parts)


class Codes:
    """The ids packed at ``at`` of ``data``."""

    def __init__(self, data: bytes, at: int = 0):
        self.levels, take = [], at + 8
        for _ in range(int(np.frombuffer(data, "<i8", 1, at)[0])):
            n = int(np.frombuffer(data, "<i8", 1, take)[0])
            blocks = -(-n // BLOCK)
            size = blocks * BLOCK // 8
            chunks = np.frombuffer(data, np.uint8, n, take + 8)
            bits = np.frombuffer(data, np.uint8, size, take + 8 + n)
            before = np.frombuffer(data, "<u4", blocks, take + 8 + n + size)
            self.levels.append((chunks, bits, before))
            take += 8 + n + size + 4 * blocks
        self.end = take

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def __getitem__(self, i: int) -> int:
        """One id, from one chunk of each level that it has."""
        value = shift = 0
        for chunks, bits, before in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * (BLOCK // 8)
            inside = int(np.bitwise_count(bits[first : i >> 3]).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(before[i // BLOCK]) + inside, shift + 8
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(len(self), np.uint32)
        at, shift = slice(None), 0
        for chunks, bits, _ in self.levels:
            value[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            on = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at, shift = (on if isinstance(at, slice) else at[on]), shift + 8
        return value


def to_file(doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A file of documents whose ids stand in a row; ``starts`` are where they begin and the last ends."""
    starts = starts.astype("<i8")
    keys, null = np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([MAGIC, np.array([len(doc_ids), len(ids)], "<i8").tobytes(), keys.tobytes(), null.tobytes(), starts.tobytes(), pack(ids)])


class TokenFile:
    """A file's documents, and random access to its tokens."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token codes")
        n, at = int(np.frombuffer(data, "<i8", 1, 8)[0]), 24
        keys, null = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, null)]
        self.starts = np.frombuffer(data, "<i8", n + 1, at + 9 * n)
        self.codes = Codes(data, at + 9 * n + 8 * (n + 1))

    def token(self, document: int, i: int) -> int:
        return self.codes[int(self.starts[document]) + i]


def _closings(starts: np.ndarray, file_tokens: int) -> Iterator[tuple[int, int]]:
    """Runs of documents that end with the one at which a file reaches ``file_tokens``."""
    at = 0
    while at < len(starts) - 1:
        to = min(len(starts) - 1, max(at + 1, int(np.searchsorted(starts, starts[at] + file_tokens))))
        yield at, to
        at = to


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END, file_tokens: int = FILE_TOKENS, specials: bool = True) -> None:
    """Write the ids of all texts below ``folder``, and a table of the files beside them: part, nth in the part, name and tokens.

    ``folder`` must be reachable from every executor. Files are in the order of
    their parts and numbers; nothing of them passes through the driver.
    """
    told = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("name", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        encoder, part, nth = _encoder(tokenizer, specials), TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, "text", SLICE):
            ids, starts = encoder(batch.column("text"), end)
            keys, numbers, names, sizes = batch.column("doc_id").to_pylist(), [], [], []
            for a, b in _closings(starts, file_tokens):
                name, aside = f"part-{part:07d}-{nth:07d}.dac", f".{uuid.uuid4().hex}"
                with store.open_output_stream(f"{root}/{aside}") as out:
                    out.write(to_file(keys[a:b], ids[starts[a] : starts[b]], starts[a : b + 1] - starts[a]))
                store.move(f"{root}/{aside}", f"{root}/{name}")
                numbers.append(nth)
                names.append(name)
                sizes.append(int(starts[b] - starts[a]))
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int64()), pa.array(numbers, pa.int64()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], schema=told)

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    # a doc_id that many rows share is cut by the hash of the text, and equal rows by where they stand
    keyed = docs.select("doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("nth"))
    order = (F.col("doc_id").asc_nulls_first(), "h", "nth")
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(run, FILES).write.mode("overwrite").parquet(f"{folder}/_files")


def _encoder(path: str, specials: bool) -> Encoder:
    """One encoder for a worker, so that later tasks find its units."""
    return held(("units", path, specials), lambda: Encoder(path, specials))


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files of ``folder``.

    A file's first token is numbered by the sums of the parts before its own,
    of which one number each reaches the driver, and of the files before it in
    its part.
    """
    files = spark.read.schema(FILES).parquet(f"{folder}/_files")
    first, before = 0, []
    for part, tokens in sorted(files.groupBy("part").agg(F.sum("tokens")).collect()):
        before.append((part, first))
        first += tokens
    parts = spark.createDataFrame(before, "part bigint, first bigint")
    inside = F.sum("tokens").over(W.partitionBy("part").orderBy("nth")) - F.col("tokens")
    based = files.withColumn("inside", inside).join(F.broadcast(parts), "part").select("name", (F.col("first") + F.col("inside")).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(f"{root}/{name}") as stream:
                    file = TokenFile(stream.read())
                ids = file.codes.all().astype("<u4")
                at = file.starts.tolist()
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(file.starts[:-1] + base), pa.array(np.diff(file.starts)), pa.array(sums, pa.int64())], schema=schema)

    return based.repartition(max(1, len(before)), "name").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write all texts to a new shared folder and read back what the files say of each document."""
    folder = new_folder(docs.sparkSession, "token-codes")
    write(docs, tokenizer, folder, file_tokens=file_tokens)
    return read(docs.sparkSession, folder)

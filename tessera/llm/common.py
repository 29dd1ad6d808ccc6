"""What the operators of this subpackage share: Arrow mapping, folds, and the shared folder of the session."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, new_folder, shared_dir  # noqa: F401


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[list], list[tuple]]],
    rows: int = 512,
) -> DataFrame:
    """Map ``df`` through Python in slices of at most ``rows`` rows.

    ``make`` runs once in each task and returns the function that turns a list
    of input tuples into a list of output tuples.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = step(list(zip(*(c.to_pylist() for c in part.columns))))
                if made:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*made), arrow)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, kind: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while kind.lower() in taken:
        kind += "_"
    return kind


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins and the last ends; a null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def parts_between(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct byte strings among the stretches between neighbouring ``ends``, and the place of each stretch among them."""
    found = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] += 32
_OF_WORDS = np.isin(np.arange(256), [*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)])


def lower_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the place of each word among them, and where each text's words begin and the last ends.

    A to Z are lower-cased; words are runs of digits, a to z and characters
    beyond ASCII.
    """
    data, ends = text_bytes(column)
    data = _LOWERED[data]
    inside = _OF_WORDS[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]  # no word goes on into the next text
    starts = np.flatnonzero(first)
    cuts = np.append(np.cumsum(inside)[starts] - 1, inside.sum())
    distinct, place = parts_between(data[inside], cuts)
    return distinct, place, np.searchsorted(starts, ends)


def give_back() -> None:
    """Return what this worker has freed to the system, as several workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices that end with the row at which their texts reach ``most`` bytes."""
    for batch in batches:
        ends, at = text_bytes(batch.column(column))[1], 0
        while at < batch.num_rows:
            to = min(batch.num_rows, int(np.searchsorted(ends, ends[at] + most)))
            yield batch.slice(at, max(to - at, 1))
            at = max(to, at + 1)
            give_back()


_held: dict = {}


def held(key, make: Callable):
    """What ``make`` gives for ``key``, made once; a worker keeps only what it used last, as several share an executor's memory."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def in_fold(key: Column, fold: int, folds: int = 5) -> Column:
    """True where crc32 of the key's text falls into ``fold``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold

"""Arrow batches of texts as numpy arrays: slices of bounded size, words, hashes.

Words are maximal runs of bytes other than space and the controls 9 to 13. All
functions work on UTF-8 bytes, so nothing is decoded on the way.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 2 << 20
BATCH_BYTES = 16 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` for a function from a batch to columns by name."""
    bounded_batches(df.sparkSession)
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = target.names

    def run(batches):
        arrow = to_arrow_schema(target)
        for batch in batches:
            for columns in fn(batch):
                arrays = [
                    columns[n]
                    if isinstance(columns[n], pa.Array) and columns[n].type == arrow.field(n).type
                    else pa.array(columns[n], arrow.field(n).type)
                    for n in names
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    return df.mapInArrow(run, target)


def give_back() -> None:
    """Return freed memory of a worker to the system; workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so themselves
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[first[0] : first[-1]], first - first[0]


@dataclass
class Slice:
    """Neighbouring texts, or a piece of one long text, cut between two words."""

    data: np.ndarray  # bytes
    offsets: np.ndarray  # of each text in data
    first: int  # number of the first text in its batch


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """All bytes of a column in slices of about ``limit`` bytes. A longer text comes in
    several slices that end at white space; a longer word stays whole."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    row = 0
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        if stop > row:
            stop = min(stop, rows)
            yield Slice(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row)
            row = stop
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            cut = min(at + limit, end)
            while cut < end:
                gaps = np.flatnonzero(IS_SPACE[data[cut : min(cut + limit, end)]])
                if len(gaps):
                    cut += int(gaps[0])
                    break
                cut = min(cut + limit, end)
            yield Slice(data[at:cut], np.array([0, cut - at]), row)
            at = cut
        row += 1


def word_spans(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of its text in the slice."""
    inside = ~IS_SPACE[part.data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = part.offsets[:-1][part.offsets[:-1] < len(inside)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    owner = np.searchsorted(part.offsets, starts, "right") - 1
    return starts, ends, owner


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(count: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit numbers."""
    step = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + np.uint64(seed)) | np.uint64(1)


BYTE_CODES = numbers(256, 11)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(count: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word from its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes = BYTE_CODES[LOWER] if lower else BYTE_CODES
    codes = np.where(IS_SPACE, np.uint64(0), codes)
    body = data[starts[0] : ends[-1]]
    begin = starts - starts[0]
    place = np.arange(len(body), dtype=np.int64)
    place -= np.repeat(begin, np.diff(np.append(begin, len(body))))
    sums = np.add.reduceat(codes[body] * powers(int(place.max()) + 1)[place], begin)
    return mix(sums + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` neighbouring words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k, factor in enumerate(numbers(size, 77)):
        total += words[k : k + count] * factor
    return mix(total)

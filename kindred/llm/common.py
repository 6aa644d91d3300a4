"""What the operators share: tables in the shared folder, and Arrow text columns as NumPy bytes.

Text operators read `doc_id` and `text`; other columns may have any names, since each operator selects
what it needs under names of its own before it joins or maps.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kindred.operators.tables import BATCH_BYTES, bounded, cut, drop_table, shared_dir  # noqa: F401

SPACE_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and its len + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[offsets[0] : offsets[-1]] if len(column) else raw[:0]), offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes together, at least one row each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = end


_CACHES: dict[str, dict[Any, Any]] = {}


def cache(name: str) -> dict[Any, Any]:
    """A dictionary that outlives tasks in a Python worker until it runs an operator that doesn't name it."""
    return _CACHES.setdefault(name, {})


def give_back(keep: str = "") -> None:
    """Empty the caches but one, and hand freed memory back to the system: workers stay for other tasks and operators."""
    for name, held in _CACHES.items():
        if name != keep:
            held.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, keep: str = "") -> DataFrame:
    """mapInArrow of a function of one batch; `keep` names the cache that it uses.

    Batches are bounded by bytes, in the worker and in the JVM beside it: BATCH_BYTES, or less if the session says so.
    """
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keep)
        for batch in batches:
            if batch.num_rows:
                got = f(batch)
                if isinstance(got, pa.RecordBatch):
                    yield got
                else:
                    yield from got
        give_back(keep)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = cache("powers")


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 20), BASE_INVERSE if inverse else BASE, np.uint64)
        step[0] = 1
        _POWERS[inverse] = have = np.cumprod(step)
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[k] * base**k over i <= k < j, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the substrings, the same wherever they stand."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts]


def byte_codes() -> np.ndarray:
    """A fixed random 64-bit number for each byte value."""
    return np.random.Generator(np.random.PCG64(2024)).integers(1, 1 << 63, 256, dtype=np.uint64)


class KeyFilter:
    """A bit set over the 64-bit keys of a table's one column: no key is missed, others pass now and then.

    It has 16 to 32 bits a key, 2**most bits at most. Tasks send the cells of their keys to the slices they are in, each
    slice is made by one task, and the driver gets the slices' bits, whose size is bounded. The table is read twice.
    """

    def __init__(self, keys: DataFrame, most: int = 27):
        bits = self.bits = min(most, max(10, (16 * keys.count()).bit_length()))
        slices = 1 << max(0, min(5, bits - 18))
        size = (1 << bits) // slices

        def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.unique(_cells(batch.column(0), bits))
            return pa.RecordBatch.from_arrays([pa.array((found // size).astype(np.int32)), pa.array((found % size).astype(np.int32))], ["slice", "cell"])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for b in batches:
                slice_, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
                for k in np.unique(slice_).tolist():
                    found.setdefault(k, np.zeros(size, bool))[cell[slice_ == k]] = True
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(v).tobytes() for v in found.values()], pa.binary())], ["slice", "bits"])

        dealt = map_arrow(keys, cells, "slice int, cell int")
        dealt = dealt.repartition(slices, "slice") if slices > 1 else dealt.repartition(1)
        self.cells = np.zeros(1 << (bits - 3), np.uint8)
        for r in dealt.mapInArrow(fill, "slice int, bits binary").collect():  # 2**most bits together
            self.cells[r.slice * size >> 3 : (r.slice + 1) * size >> 3] |= np.frombuffer(r.bits, np.uint8)

    def has(self, keys: pa.Array) -> np.ndarray:
        at = _cells(keys, self.bits)
        return (self.cells[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _cells(keys: pa.Array, bits: int) -> np.ndarray:
    return (mix64(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

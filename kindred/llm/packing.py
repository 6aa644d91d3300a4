"""Operator 2, packing by cutting-stock column generation.

A document's ids are cut into full sequences, a main piece of a multiple of 32 ids and a tail of fewer than 32,
so pieces have few distinct lengths whatever the corpus is. On the histogram of lengths a linear program picks how
often to use each pattern of lengths; knapsack dynamic programming finds the pattern of best value under
the current prices until none is worth its cost. Pattern counts are rounded down, pieces are ranked within their
length, and ranks are assigned to the patterns' slots by arithmetic. The few pieces that rounding leaves over (their
number depends on the lengths, not on the corpus) are placed first-fit decreasing.

The histogram and the plan are the only things on the driver, and both are bounded by the number of lengths.

Cases: null text is empty and has one id, the end id; an empty table gives an empty result; repeated rows are
documents of their own; very long texts become many full sequences; ties: pieces of one length rank by bucket, id, place and
CRC. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import blocks, cut, map_arrow, utf8
from kindred.llm.tokens import encoder, vocabulary

CAPACITY, UNIT, END_ID = 2048, 32, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PER_BUCKET = 20_000


def lengths_of(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[int]:
    """The piece lengths of a document with n ids."""
    rest = n % capacity
    parts = [capacity] * (n // capacity) + [rest - rest % unit, rest % unit]
    return [p for p in parts if p]


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack of most value: its value and how often each length is in it."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = lengths <= c
        options = np.where(fit, value[np.maximum(c - lengths, 0)] + prices, -1.0)
        k = int(options.argmax())
        value[c], pick[c] = value[c - 1], -1
        if fit[k] and options[k] > value[c] + 1e-12:
            value[c], pick[c] = options[k], k
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= int(lengths[pick[c]])
        else:
            c -= 1
    return float(prices @ counts), counts


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses them, by column generation with a revised simplex.

    It goes on until no pattern is worth its cost, or until ten times as many changes as there are lengths save nothing.
    """
    m = len(lengths)
    columns = np.diag(capacity // lengths).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(columns))
    use = inverse @ demand
    least, idle = float(use.sum()), 0
    while idle < 10 * m:
        value, pattern = best_pattern(lengths, np.ones(m) @ inverse, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-12, use / np.where(step > 1e-12, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        use = np.maximum(inverse @ demand, 0)
        idle = 0 if use.sum() < least - 1e-9 else idle + 1
        least = min(least, float(use.sum()))
    return [(columns[:, k].astype(np.int64), float(use[k])) for k in range(m)]


@dataclass
class Plan:
    """Slots of each length: ranks from `first`, `each` to a sequence, from sequence `base` and offset `offset`."""

    slots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    sequences: int = 0

    def add(self, length: int, first: int, each: int, base: int, offset: int) -> None:
        self.slots.setdefault(length, []).append((first, each, base, offset))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT) -> Plan:
    done, out = dict.fromkeys(histogram, 0), Plan()

    def use(pattern: list[tuple[int, int]], times: int) -> None:
        offset = 0
        for length, each in pattern:
            out.add(length, done[length], each, out.sequences, offset)
            done[length] += each * times
            offset += each * length
        out.sequences += times

    if histogram.get(capacity):
        use([(capacity, 1)], histogram[capacity])
    for group in ([n for n in histogram if n < capacity and n % unit == 0], [n for n in histogram if n < unit]):
        if group:
            lengths = np.array(sorted(group, reverse=True))
            scale = unit if lengths[-1] % unit == 0 else 1
            found = cutting_stock(lengths // scale, np.array([float(histogram[n]) for n in lengths]), capacity // scale)
            for counts, times in found:
                # no more than the pieces that are there: the program may cover a length more than once
                whole = min([int(times + 1e-9), *((histogram[n] - done[n]) // c for n, c in zip(lengths.tolist(), counts.tolist()) if c)])
                if whole > 0 and counts.any():
                    use([(n, c) for n, c in zip(lengths.tolist(), counts.tolist()) if c], whole)
    room: list[int] = []
    base = out.sequences
    for length in sorted(histogram, reverse=True):
        for rank in range(done[length], histogram[length]):
            k = next((i for i, free in enumerate(room) if free >= length), len(room))
            if k == len(room):
                room.append(capacity)
            out.add(length, rank, 1, base + k, capacity - room[k])
            room[k] -= length
    out.sequences += len(room)
    return out


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """Every piece with its place in the document and the CRC of its ids."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path).encode
        texts = batch.column(1)
        _, offsets = utf8(texts)
        for i, j in blocks(offsets, 4 << 20):
            ids, counts = encode(texts.slice(i, j - i))
            row: list[list[int]] = [[], [], [], [], []]
            at = 0
            for k, n in enumerate(counts.tolist()):
                data = np.append(ids[at : at + n], end_id).astype("<u4").tobytes()
                at += n
                start = 0
                for length in lengths_of(n + 1):
                    for column, v in zip(row, (i + k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n + 1)):
                        column.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[0], pa.int64())), *(pa.array(c, pa.int64()) for c in row[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select("doc_id", "text"), run, PIECES, keep="encoders")


def assign(rows: DataFrame) -> DataFrame:
    """Pieces with sequence_id and offset. `rows` is read three times and should be a table."""
    total = rows.count()
    buckets = max(1, -(-total // PER_BUCKET))
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    made = plan(histogram)
    lookup = {length: np.array(sorted(s), np.int64) for length, s in made.slots.items()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("l2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        keyed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(bases, (F.col("length") == F.col("l2")) & (F.col("bucket") == F.col("b2")))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))
    )

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 5))
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            mine = length == n
            first, each, base, at = lookup[int(n)][np.searchsorted(lookup[int(n)][:, 0], rank[mine], "right") - 1].T
            slot = rank[mine] - first
            sequence[mine], offset[mine] = base + slot // each, at + slot % each * n
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_arrow(ranked, place, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequences. Ids are encoded once; the table of pieces holds no ids."""
    return assign(cut(pieces(docs, vocabulary_path or vocabulary("word_bpe_49k.json")), "pieces"))

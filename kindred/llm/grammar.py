"""Operator 6, token-id shards compressed by Re-Pair.

Documents are range-partitioned by id and cut into shards of about a million ids. Within a shard frequent id pairs are
replaced by nonterminals, round after round: a round takes the most frequent pairs of the moment, as long as no
symbol is the left half of one and the right half of another, so that their replacements don't interfere; of a run of one
symbol, every other pair is replaced. Rounds end when no pair is frequent enough or symbols run out: they stay below
65,536, so that a symbol takes two bytes. A larger vocabulary is an error. A shard's file holds the rules, the expansion length
of every rule, the documents' symbol and id offsets, and the symbols; one document, or any range of ids, is decoded from
these alone. Pairs never cross documents.

A file is one binary value of a Parquet table in the shared folder: Spark's commit makes a lost
task's file appear once. The table's columns order the files.

Cases: null text is empty: its ids are the end id alone. Very long texts are encoded and compressed whole, in a shard that is as
much larger. Ties: of pairs with equal counts the smaller number goes first. Repeated ids follow each other, equal rows in any order.
Null ids come first. An empty table gives no files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import blocks, bounded, cut, give_back, map_arrow, ranges, utf8
from kindred.llm.tokens import encoder, vocabulary

MAGIC = b"RPG1"
HEAD = "<4sIIIIQQ"
END_ID = 0
SHARD_IDS = 1 << 20
BLOCK = 6 << 20  # bytes of text encoded at once
SHARDS = "part int, number int, n_docs long, n_ids long, file binary"


@dataclass(frozen=True)
class RepairParams:
    rounds: int | None = None  # as many as find pairs
    pairs: int = 3000  # at most, in a round
    least: int = 12  # occurrences of a pair worth a rule


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that can be replaced `least` times, most frequent first, ties by number, and how often. Of a run of n
    symbols, n / 2 pairs can."""
    keys = np.sort(keys)
    held = keys[:-least + 1 or None] == keys[least - 1 :]
    held[1:] &= keys[1 : len(held)] != keys[: len(held) - 1]
    first = np.flatnonzero(held)
    pairs = keys[first]
    n = np.searchsorted(keys, pairs, "right") - first
    n = np.where(pairs >> np.uint32(16) == pairs & np.uint32(0xFFFF), (n + 1) // 2, n)
    order = np.lexsort((pairs, -n))
    order = order[n[order] >= least]
    return pairs[order], n[order]


def compress(ids: np.ndarray, counts: np.ndarray, vocabulary_size: int, params: RepairParams = RepairParams()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the number of symbols of each document, and the rules (left, right)."""
    if vocabulary_size > 1 << 16:
        raise ValueError(f"a vocabulary of {vocabulary_size} ids: symbols take two bytes")
    symbols, counts = ids.astype(np.uint32), counts.astype(np.int64)
    rules: list[np.ndarray] = []
    top = vocabulary_size
    for _ in itertools.count() if params.rounds is None else range(params.rounds):
        limit = min(params.pairs, (1 << 16) - top)
        if limit <= 0 or len(symbols) < 2:
            break
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(counts)[counts > 0] - 1] = True
        keys = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        free = ~last[:-1]
        pairs, _ = _frequent(keys[free], params.least)
        side: dict[int, int] = {}
        chosen = []
        for key in pairs[: 2 * limit].tolist():
            a, b = key >> 16, key & 0xFFFF
            if (a not in side) if a == b else (side.get(a, 0) == 0 and side.get(b, 1) == 1):
                side[a], side[b] = (2, 2) if a == b else (0, 1)
                chosen.append(key)
                if len(chosen) == limit:
                    break
        if not chosen:
            break
        found = np.array(chosen, np.uint32)
        spread = np.uint32(0x9E3779B1)
        table = np.zeros(1 << 18, np.uint16)  # numbers the pairs by a hash of theirs
        table[(found * spread) >> np.uint32(14)] = np.arange(len(found))
        found = found[np.unique(table[(found * spread) >> np.uint32(14)])]  # of pairs with one hash, one
        table[(found * spread) >> np.uint32(14)] = np.arange(len(found))
        slot = table[(keys * spread) >> np.uint32(14)]
        at = np.flatnonzero((found[slot] == keys) & free)
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, at, 0))
        at = at[(at - run) % 2 == 0]  # matches that follow each other are a run of one symbol
        symbols[at] = top + slot[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False  # no match starts where another one ends
        counts = counts - np.diff(np.searchsorted(at, np.cumsum(counts)), prepend=0)
        symbols = symbols[keep]
        rules.append(found)
        top += len(found)
    table = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    return symbols.astype(np.uint16), counts, np.stack([table >> np.uint32(16), table & np.uint32(0xFFFF)], 1).astype(np.uint16)


def expansions(rules: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all symbols, one after another, and where each symbol's begin."""
    lengths = np.ones(size + len(rules), np.int64)
    pending, done = 0, size
    while pending < len(rules):  # rules name earlier symbols only; take those whose parts are known together
        ready = pending + int(np.argmax(np.append((rules[pending:].max(1) >= done), True)))
        lengths[size + pending : size + ready] = lengths[rules[pending:ready]].sum(1)
        pending, done = ready, size + ready
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.zeros(starts[-1], np.uint32)
    flat[:size] = np.arange(size)
    pending, done = 0, size
    while pending < len(rules):
        ready = pending + int(np.argmax(np.append((rules[pending:].max(1) >= done), True)))
        parts = rules[pending:ready].reshape(-1).astype(np.int64)
        flat[starts[size + pending] : starts[size + ready]] = flat[ranges(starts[parts], lengths[parts])]
        pending, done = ready, size + ready
    return flat, starts


def write_shard(ids: np.ndarray, counts: np.ndarray, size: int, params: RepairParams = RepairParams()) -> bytes:
    symbols, symbol_counts, rules = compress(ids, counts, size, params)
    _, starts = expansions(rules, size)
    rule_lengths = np.diff(starts)[size:]
    head = struct.pack(HEAD, MAGIC, size, len(rules), len(counts), 0, len(symbols), len(ids))
    return b"".join([head, rules.astype("<u2").tobytes(), rule_lengths.astype("<u4").tobytes(), symbol_counts.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), symbols.astype("<u2").tobytes()])


class Shard:
    """A file opened for reading."""

    def __init__(self, data: bytes):
        magic, self.size, n_rules, n_docs, _, n_symbols, self.n_ids = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(HEAD)

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take(2 * n_rules, "<u2").reshape(-1, 2)
        self.rule_lengths = take(n_rules, "<u4")
        self.symbol_counts, self.counts = take(n_docs, "<u4").astype(np.int64), take(n_docs, "<u4").astype(np.int64)
        self.symbols = take(n_symbols, "<u2")
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of documents first .. last - 1."""
        if self._table is None:
            self._table = expansions(self.rules, self.size)
        flat, starts = self._table
        ends = np.concatenate([[0], np.cumsum(self.symbol_counts)])
        s = self.symbols[ends[first] : ends[len(self.counts) if last is None else last]].astype(np.int64)
        return flat[ranges(starts[s], starts[s + 1] - starts[s])]

    def id_at(self, position: int) -> int:
        """One id of the shard, found by expansion lengths: no other symbol is expanded."""
        doc = int(np.searchsorted(np.cumsum(self.counts), position, "right"))
        position -= int(self.counts[:doc].sum())
        start = int(self.symbol_counts[:doc].sum())
        lengths = np.concatenate([np.ones(self.size, np.int64), self.rule_lengths])
        own = self.symbols[start : start + int(self.symbol_counts[doc])]
        ends = np.cumsum(lengths[own])
        k = int(np.searchsorted(ends, position, "right"))
        symbol, position = int(own[k]), position - int(ends[k] - lengths[own[k]])
        while symbol >= self.size:
            left, right = map(int, self.rules[symbol - self.size])
            symbol, position = (left, position) if position < lengths[left] else (right, position - int(lengths[left]))
        return symbol


def write(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = END_ID, params: RepairParams = RepairParams(), shard_ids: int = SHARD_IDS) -> DataFrame:
    """The table of shard files over all documents in ascending id order, with the documents' ids in order."""
    path = vocabulary_path or vocabulary("byte_bpe_50k.json")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(path)
        size = max(enc.size, end_id + 1)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        number = 0

        def shard() -> pa.RecordBatch:
            nonlocal number, held
            names = [x for h in held for x in h[0]]
            ids, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            file = write_shard(ids, counts, size, params)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([file], pa.binary()), pa.array([names], pa.list_(pa.int64()))]
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays(row, ["part", "number", "n_docs", "n_ids", "file", "doc_ids"])

        have = 0
        give_back("encoders")
        for batch in gathered(batches, BLOCK):
            _, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets, BLOCK):
                ids, counts = enc.encode(batch.column(1).slice(i, j - i))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                held.append((batch.column(0).slice(i, j - i).to_pylist(), ids, counts + 1))
                have += len(ids)
                if have >= shard_ids:
                    yield shard()
                    have = 0
        if held:
            yield shard()
        give_back("encoders")

    bounded(docs.sparkSession)
    return cut(ordered.mapInArrow(run, f"{SHARDS}, doc_ids array<long>"), "id-shards")


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about `size` bytes: a block's repeated words are looked up once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def read(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The running total is over one row a file, and is a table, so that Spark sees whether it is small enough to be sent to
    the files; else they are joined.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(shards.select("part", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")), "shard-bases")
    joined = shards.join(bases, ["part", "number"]).select("base", "file", "doc_ids")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for base, file, names in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            opened = Shard(file.as_py())
            data = opened.decode().astype("<u4").tobytes()
            ends = np.cumsum(opened.counts)
            starts = ends - opened.counts
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([names.values, pa.array(starts + base), pa.array(opened.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(joined, run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Operator 8, n-gram Jaccard join with rare-first prefix filtering.

A document's set is its distinct shingles of k words, as 64-bit hashes. Documents with equal sets form one class from the
start; the join is between classes. Shingles have one global order: by the level of their frequency, which a
count sketch over all documents gives, then by hash; any order is exact, a rare-first one makes short groups. A
set's prefix, its first n - ceil(t n) + 1 shingles, must meet the prefix of every set that it links with.
Candidates pass the length filter, the positional filter and a suffix filter that bounds the sets' Hamming distance by
parities and counts of ranges of hashes; a pair is verified once, by the sets themselves.

A large group of near copies shares thousands of shingles, and all its pairs would be quadratic. So links are found
in waves: in a wave each prefix shingle pairs its classes with one leader, the class in which the fewest rarer shingles
stand before it. A copy's own changes are such rarer shingles, so the leader is the class nearest to what the group has
in common, and one wave joins what a middle can join. Shingles that meet in different components after it are open. While
their classes could still make more than `dense` pairs each, further waves take a leader for each pattern of parity bits among
a shingle's classes, as long as they join anything; the last wave takes every pair that is
left between different components, so no link that matters for connectivity is lost. Sets that are dense below the threshold join nothing in any
wave, and all their pairs would come to the last one: there the suffix filter goes by 2,048 ranges, which tells sets of up to about two
thousand shingles apart that are a little too different to link, while they are joined, so that they make no pair.

Cases: null text, and text without words, has an empty set and links with nothing; fewer than k words make one
shingle of the whole sequence; repeated rows and null ids are members of their class; a class whose ids are all null has a
null component. Very long texts are sets like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import KeyFilter, blocks, byte_codes, cut, drop_table, map_arrow, mix64, prefix_hashes, substring_hashes, utf8
from kindred.llm.components import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLICES = 64
FAN_IN = 64
WORDS = ("p0", "p1", "p2", "p3")
FINE = 32  # words of the last wave's parity
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CODES = byte_codes()[_LOWER]


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    percent: int = 80  # least similarity
    sketch_bits: int = 22
    bloom_bits: int = 27  # of a filter, at most
    waves: int = 6  # of leaders, at most
    dense: int = 16  # pairs an open prefix row may make before another wave of leaders is worth it


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    space = _SPACE[raw]
    inside = ~space
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (np.concatenate([[True], space[:-1]]) | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1 if len(raw) else begins
    words = mix64(substring_hashes(prefix_hashes(_CODES[raw]), begins, ends) + (ends - begins).astype(np.uint64)) if len(begins) else np.zeros(0, np.uint64)
    borders = np.searchsorted(begins, offsets)
    joined = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        joined = joined * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(joined)]
    joined = mix64(joined)
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if b - a >= k:
            own = np.sort(joined[a : b - k + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = h * np.uint64(0xA24BAED4963EE407) + w
            yield mix64(np.array([h]))
        else:
            yield np.zeros(0, np.uint64)


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    raw, offsets = utf8(texts)
    with np.errstate(over="ignore"):
        for i, j in blocks(offsets):
            yield from shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)


def node_of(own: np.ndarray) -> int:
    """A class's name, from all hashes of its set; 0 for the empty set."""
    if not len(own):
        return 0
    total = np.array([mix64(own ^ np.uint64(0x51ED270B27B4D1E5)).sum() ^ (np.uint64(len(own)) << np.uint64(40))])
    return int(mix64(total).astype(np.int64)[0]) or 1


def _sketch(docs: DataFrame, params: JoinParams) -> np.ndarray:
    """Frequency levels of the shingles by 2**sketch_bits cells: how often the mean cell fits into theirs, as a logarithm.

    Each task adds up its own cells and hands them on in packed slices; slices meet in a tree, FAN_IN tasks at a
    time. What reaches the driver has a fixed size.
    """
    size, shift = 1 << params.sketch_bits, np.uint64(64 - params.sketch_bits)
    width = max(1, size // SLICES)
    kind = "part int, slice int, cells binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, waiting, part = np.zeros(size, np.int64), [], 0, 0

        def add_held() -> None:
            np.add(cells, np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=size), out=cells)
            held.clear()

        for batch in batches:
            part = batch.column(1)[0].as_py() if batch.num_rows else part
            for own in sets_of(batch.column(0), params.words):
                held.append(own)
                waiting += len(own)
                if waiting > size:
                    add_held()
                    waiting = 0
        if held:
            add_held()
        slices = [i for i in range(size // width) if cells[i * width : (i + 1) * width].any()]
        packed = [zlib.compress(cells[i * width : (i + 1) * width].tobytes(), 1) for i in slices]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(slices), pa.int32()), pa.array(slices, pa.int32()), pa.array(packed, pa.binary())], ["part", "slice", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c in table["cells"]:
            total += np.frombuffer(zlib.decompress(c.as_py()), np.int64)
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int32()), "slice": table["slice"][:1], "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = docs.select("text", F.spark_partition_id().alias("part"))
    parts = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(count, kind)
    while parts > 1:
        sums = sums.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("g")).applyInArrow(add, kind)
        parts = -(-parts // FAN_IN)
    cells = np.zeros(size, np.int64)
    for r in sums.collect():  # a row for each slice: one job, and 32 MB at most for cells of eight bytes
        cells[r.slice * width : (r.slice + 1) * width] += np.frombuffer(zlib.decompress(r.cells), np.int64)
    mean = max(1.0, float(cells.mean()))
    return np.floor(np.log2(np.maximum(cells / mean, 1.0)) * 2).astype(np.uint8)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of sets of a and b that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - math.ceil(Fraction(percent * n, 100)) + 1


def _entries(docs: DataFrame, levels: np.ndarray, params: JoinParams) -> DataFrame:
    """(token, node, n, pos) of the prefixes as a table, one row for each class and task that met it."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # one byte a cell
    shift = np.uint64(64 - params.sketch_bits)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        level, done = shared.value, set()
        held: list[tuple[np.ndarray, int, int]] = []

        def flush() -> pa.RecordBatch:
            sizes = [len(h[0]) for h in held]
            columns = [
                np.concatenate([h[0] for h in held]).astype(np.int64), np.repeat([h[1] for h in held], sizes), np.repeat([h[2] for h in held], sizes).astype(np.int32),
                np.concatenate([np.arange(s) for s in sizes]).astype(np.int32),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "pos"])

        waiting = 0
        for own in sets_of(batch.column(0), params.words):
            node = node_of(own)
            if not node or node in done:
                continue
            done.add(node)
            key = (level[(own >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix64(own) >> np.uint64(8))
            p = prefix_length(len(own), params.percent)
            if p < len(own) // 2:
                near = np.argpartition(key, p)[: p + 1]
                first = near[np.argsort(key[near], kind="stable")][:p]
            else:
                first = np.argsort(key, kind="stable")[:p]
            held.append((own[first], node, len(own)))
            waiting += p
            if waiting > 200_000:
                yield flush()
                waiting = 0
        if held:
            yield flush()

    return _settled(map_arrow(docs.select("text"), run, "token long, node long, n int, pos int"), "prefixes", [shared])


def _as_partner(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}2" if c not in WORDS else f"{c}_2") for c in rows.columns])


def _need(percent: int) -> Column:
    return F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent) - 1e-9)


def _possible(percent: int) -> Column:
    """Length and positional filter of an entry and its partner: at a pair's first common shingle both hold."""
    length = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    return length & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= _need(percent))


def _near(percent: int) -> Column:
    """The suffix filter. It bounds the Hamming distance of the sets: each hash that only one of them has changes one
    bit of its parity words at most."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_2"))) for w in WORDS])
    return apart <= F.col("n") + F.col("n2") - 2 * _need(percent)


def _finely_near(percent: int) -> Column:
    """The suffix filter over the words of `fine`."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col("fine")[k].bitwiseXOR(F.col("fine2")[k])) for k in range(FINE)])
    return apart <= F.col("n") + F.col("n2") - 2 * _need(percent)


def _among(rows: DataFrame, column: str, keys: DataFrame, params: JoinParams, held: list[Broadcast]) -> DataFrame:
    """The rows that may be among the keys (one column): a filter of a bounded size, so that few others are shuffled.
    It is added to `held`, to be destroyed when the rows have been written."""
    shared, at = rows.sparkSession.sparkContext.broadcast(KeyFilter(keys, params.bloom_bits)), rows.columns.index(column)
    held.append(shared)
    return map_arrow(rows, lambda batch: batch.filter(pa.array(shared.value.has(batch.column(at)))), rows._jdf.schema().toDDL())


def _sets(docs: DataFrame, own: DataFrame, named: DataFrame, params: JoinParams) -> DataFrame:
    """(node, members) of the classes `named` as a table, one row for each, from one text of each class. A filter of text
    hashes spares other texts; what it lets through by chance joins nothing."""
    held: list[Broadcast] = []
    texts = cut(_among(own.select("node", "th"), "node", named, params, held).groupBy("node").agg(F.min("th").alias("th")).select("th"), "texts")
    shared = docs.sparkSession.sparkContext.broadcast(KeyFilter(texts, params.bloom_bits))
    held.append(shared)
    drop_table(texts)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done, names, values, size = set(), [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.binary())], ["node", "members"])

        batch = batch.filter(pa.array(shared.value.has(batch.column(1))))
        for members in sets_of(batch.column(0), params.words):
            node = node_of(members)
            if node and node not in done:
                done.add(node)
                names.append(node)
                values.append(members.tobytes())
                size += len(values[-1])
                if size > 4 << 20:
                    yield rows()
                    names, values, size = [], [], 0
        if names:
            yield rows()

    made = map_arrow(docs.select("text", F.xxhash64("text").alias("th")), run, "node long, members binary")
    return _settled(made.groupBy("node").agg(F.any_value("members").alias("members")), "sets", held)


def _settled(rows: DataFrame, name: str, held: list[Broadcast]) -> DataFrame:
    """The rows as a table, which needs the broadcast values no more."""
    out = cut(rows, name)
    for shared in held:
        shared.destroy()
    return out


def parity(own: np.ndarray, words: int = len(WORDS)) -> np.ndarray:
    """Whether the number of hashes in each of 64 equal ranges a word is odd."""
    bits = (64 * words).bit_length() - 1
    odd = (np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def range_counts(own: np.ndarray) -> np.ndarray:
    """How many hashes fall into each of 32 to 4,096 equal ranges, about two a range, at most 65,535."""
    bits = min(12, max(5, (len(own) // 2).bit_length()))
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 65535).astype(np.uint16)


def may_overlap(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets of these range counts may link: of a range they share no more than the smaller count. A count at
    its limit says nothing."""
    if (x == 65535).any() or (y == 65535).any():
        return True
    n, m = int(x.sum(dtype=np.int64)), int(y.sum(dtype=np.int64))
    width = min(len(x), len(y))
    x, y = (v.reshape(width, -1).sum(1, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum()) >= least_overlap(n, m, percent)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    need = least_overlap(len(a), len(b), percent)
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with a column of both classes: two joins, which Spark splits where one class is in many pairs."""
    left = table.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = table.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _likely(own: DataFrame, pairs: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs (a, b) that may link, as a table. Long sets have too few parity words, so counts by range go on with the
    suffix filter."""

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [may_overlap(np.frombuffer(x.as_py(), np.uint16), np.frombuffer(y.as_py(), np.uint16), params.percent) for x, y in zip(batch.column(2), batch.column(3))]
        return batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    held: list[Broadcast] = []
    named = pairs.select("a").union(pairs.select("b"))
    # a table, as sets are, so that a leader of very many pairs can be split where it is joined
    counts = _settled(_among(own.select("node", "counts"), "node", named, params, held).groupBy("node").agg(F.any_value("counts").alias("counts")), "counts", held)
    out = cut(map_arrow(_with_both(pairs, counts, "counts"), likely, "a long, b long"), "likely")
    drop_table(counts)
    return out


def _verified(docs: DataFrame, own: DataFrame, pairs: DataFrame, roots: DataFrame | None, params: JoinParams) -> DataFrame:
    """Links (a, b) among the pairs, as a table; only classes of pairs that may link are made into sets again.

    With roots, one pair of each two components is verified first. Where it links, their other pairs add nothing; all
    that are left between different components are verified after it.
    """

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), params.percent) for x, y in zip(batch.column(2), batch.column(3))]
        return batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(map_arrow(_with_both(pairs, sets, "members"), exact, "a long, b long"), "verified")

    pairs = _likely(own, pairs, params)
    sets = _sets(docs, own, pairs.select("a").union(pairs.select("b")), params)
    if roots is None:
        found = linked(pairs)
    else:
        rooted = cut(_rooted(pairs, roots), "rooted")
        low, high = F.least("root_a", "root_b"), F.greatest("root_a", "root_b")
        first = cut(rooted.groupBy(low.alias("low"), high.alias("high")).agg(F.min(F.struct("a", "b")).alias("x")).select("x.a", "x.b"), "first")
        found = linked(first)
        merged = cut(components(_rooted(found, roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "merged")
        left = _rooted(rooted.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"), F.struct("a", "b").alias("x")), merged)
        left = cut(left.where("root_a <> root_b").select("x.a", "x.b").join(first, ["a", "b"], "left_anti"), "left")
        found = found.unionByName(linked(left))
        for used in (rooted, first, merged, left):
            drop_table(used)
    drop_table(pairs)
    drop_table(sets)
    return found


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components of both; a class without a row in roots is its own."""
    for side in ("a", "b"):
        named = roots.select(F.col("node").alias("r"), "root")
        pairs = pairs.join(named, F.col(side) == F.col("r"), "left").withColumn(f"root_{side}", F.coalesce("root", side)).drop("r", "root")
    return pairs


def _pattern(wave: int) -> Column:
    """Six parity bits of a class, others in each wave."""
    return F.shiftrightunsigned(F.col(WORDS[wave % len(WORDS)]), wave // len(WORDS) * 6 % 58).bitwiseAND(F.lit(63))


def _leaders(rows: DataFrame, wave: int) -> DataFrame:
    """As partners, the leader of each shingle, after the first wave of each shingle and pattern."""
    columns = ["node", "n", "pos", "root", *(WORDS if wave else ())]
    best = F.min_by(F.struct(*columns), F.struct("pos", F.xxhash64("node", F.lit(wave)), "node")).alias("x")
    if not wave:
        return _as_partner(rows.groupBy("token").agg(best).select("token", "x.*"))
    return _as_partner(rows.groupBy("token", _pattern(wave).alias("pattern")).agg(best).select("token", "pattern", "x.*"))


def _every_pair(rows: DataFrame, own: DataFrame, meet: Column, params: JoinParams, used: list[DataFrame]) -> DataFrame:
    """The pairs of each shingle's classes that meet. Few classes of a shingle make few pairs each; where more than 2 `dense` share one, the
    classes carry their fine parity, which the join tests as well. Tables are added to `used`."""
    crowded = cut(rows.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("k")).where(F.col("k") > 2 * params.dense + 1).select("t"), "crowded")
    used.append(crowded)
    if crowded.isEmpty():
        return rows.join(_as_partner(rows), meet)
    here = F.col("token") == F.col("t")
    few, many = rows.join(crowded, here, "left_anti"), rows.join(crowded, here, "left_semi")
    named = many.select(F.col("node").alias("c")).distinct()
    fine = cut(own.where("node <> 0").select(F.col("node").alias("c"), "fine").join(named, "c", "left_semi").groupBy("c").agg(F.any_value("fine").alias("fine")), "fine-parities")
    used.append(fine)
    many = cut(many.join(fine, F.col("node") == F.col("c")).drop("c"), "crowded-prefixes")
    used.append(many)
    columns = ["node", "node2"]
    return few.join(_as_partner(few), meet).select(*columns).unionByName(many.join(_as_partner(many), meet & _finely_near(params.percent)).select(*columns))


def _open(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Entries with their components, of shingles whose classes are in more than one."""
    if roots is None:
        return entries.withColumn("root", F.col("node"))
    named = roots.select(F.col("node").alias("r"), "root")
    rows = entries.join(named, F.col("node") == F.col("r"), "left").withColumn("root", F.coalesce("root", "node")).drop("r")
    mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("token").alias("t"))
    return rows.join(mixed, F.col("token") == F.col("t"), "left_semi")


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """The distinct pairs (a, b) that aren't in tried, as a table: one aggregate, combined before it is shuffled."""
    rows = pairs.withColumn("old", F.lit(False))
    if tried is not None:
        rows = rows.unionByName(tried.withColumn("old", F.lit(True)))
    return cut(rows.groupBy("a", "b").agg(F.max("old").alias("old")).where("NOT old").select("a", "b"), "pairs")


def classes(docs: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, th, n_shingles, node, the set's parity by four words and by FINE, and its range counts, of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, fine = [], []
        for own in sets_of(batch.column(1), params.words):
            got.append((len(own), node_of(own), *parity(own).tolist(), range_counts(own).tobytes()))
            fine.append(parity(own, FINE))
        columns = [pa.array([g[k] for g in got], pa.int64() if k < 2 + len(WORDS) else pa.binary()) for k in range(3 + len(WORDS))]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fine) + 1, dtype=np.int32) * FINE), pa.array(np.concatenate(fine)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, lists], ["doc_id", "th", "n_shingles", "node", *WORDS, "counts", "fine"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), run, "doc_id long, th long, n_shingles long, node long, p0 long, p1 long, p2 long, p3 long, counts binary, fine array<long>")


def node_roots(docs: DataFrame, own: DataFrame, params: JoinParams) -> DataFrame | None:
    """(node, root) of the classes that link with others; null when none does. own: the table of classes()."""
    prefixes = _entries(docs, _sketch(docs, params), params)
    groups = prefixes.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select(F.col("token").alias("t"))
    groups = cut(groups, "shared-tokens")
    # shingles that meet in prefixes; a class that several tasks met is named once from here on
    held: list[Broadcast] = []
    entries = _settled(_among(prefixes, "token", groups, params, held).join(groups, F.col("token") == F.col("t"), "left_semi").distinct(), "shared-prefixes", held)
    drop_table(prefixes)
    drop_table(groups)
    if entries.isEmpty():
        return None
    words = own.where("node <> 0").groupBy(F.col("node").alias("c")).agg(*[F.any_value(w).alias(w) for w in WORDS])
    words = cut(words, "parities")
    links = tried = roots = None
    used = [entries, words]
    rows, last, wave = entries.withColumn("root", F.col("node")), params.waves == 0, 0
    while True:
        if wave or last:  # few rows are in open groups: they carry their parities, and the joins themselves test them
            rows = rows.join(words, F.col("node") == F.col("c")).drop("c")
        partner = _leaders(rows, wave) if not last else None
        order = F.col("node") < F.col("node2") if last else F.col("node") != F.col("node2")
        meet = (F.col("token") == F.col("token2")) & (F.col("root") != F.col("root2")) & order & _possible(params.percent)
        if wave or last:
            meet &= _near(params.percent)
            met = rows.join(partner, meet & (_pattern(wave) == F.col("pattern2"))) if not last else _every_pair(rows, own, meet, params, used)
        else:
            met = rows.join(partner, meet).select("node", "n", "node2", "n2").distinct().join(words, F.col("node") == F.col("c")).drop("c")
            met = met.join(words.select(F.col("c"), *[F.col(w).alias(f"{w}_2") for w in WORDS]), F.col("node2") == F.col("c")).where(_near(params.percent))
        pairs = _untried(met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")), tried)
        joined = False
        used.append(pairs)
        if not pairs.isEmpty():
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = _verified(docs, own, pairs, roots, params)
            joined = not found.isEmpty()
            used.append(found)
            links = found if links is None else links.unionByName(found)
            if joined:
                used += [roots] if roots is not None else []
                roots = cut(components(links), "roots")
        if wave:
            drop_table(open_)
        if last:
            break
        rows = open_ = cut(_open(entries, roots), "open-prefixes")
        wave += 1
        met_in = open_.groupBy("token").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"), F.sum("k").alias("rows")).first()
        if not met_in.rows:
            break
        last = not joined or wave >= params.waves or met_in.pairs <= params.dense * met_in.rows
    for table in used:
        drop_table(table)
    return roots


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id of the component) of every row."""
    group = grouped(docs, params)
    # a table, so that a component of very many rows can be split where it is joined
    least = cut(group.where("node <> 0").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least")), "least")
    joined = group.join(least, (F.col("root") == F.col("r")) & (F.col("node") != 0), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def grouped(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, node and root (the component's name) of every row, as a table."""
    rows = cut(classes(docs, params), "classes")
    roots = node_roots(docs, rows, params)
    if roots is None:
        group = rows.withColumn("root", F.col("node"))
    else:
        named = roots.select(F.col("node").alias("r"), "root")
        group = rows.join(named, F.col("node") == F.col("r"), "left").withColumn("root", F.coalesce("root", "node")).drop("r")
    group = cut(group.select("doc_id", "th", "n_shingles", "node", "root"), "groups")
    for used in (rows, roots):
        if used is not None:
            drop_table(used)
    return group


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """The rows of docs without near copies: of each component the row of the smallest id, of equal ids the one of the
    smallest hash of its text, of repeated rows the least by all columns. Rows with an empty set have no copies but exact ones.

    The choice is an aggregate of ids and hashes; texts are joined to it, not grouped.
    """
    found, lone = grouped(docs, params), F.col("node") == 0
    group = found.select("doc_id", "th", lone.alias("empty"), F.when(lone, F.col("th")).otherwise(F.col("root")).alias("part"))
    kept = group.groupBy("empty", "part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x")).select("x.doc_id", "x.th").distinct()
    kept = kept.select(F.col("doc_id").alias("k1"), F.col("th").alias("k2"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_th"))
    joined = rows.join(kept, F.col("k_id").eqNullSafe(F.col("k1")) & (F.col("k_th") == F.col("k2")), "left_semi")
    # repeated rows share id and text; few of them are left, and the least of them by all columns stays
    least = F.struct(*[F.to_json(F.struct(f"row.`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"row.`{f.name}`") for f in docs.schema])
    return joined.groupBy("k_id", "k_th").agg(F.min_by("row", least).alias("row")).select("row.*")

"""Operator 7, exact repeats by hash-compared suffix sort.

Every byte goes that a string of `size` bytes covers which also starts anywhere else, in the same document or another.

Strings are found through anchors. Of the k-grams in a string the one of least hash is its anchor, so equal strings
have equal anchors at equal places, and about one position in a hundred is one. Anchors with a hash of
their own are dropped. The rest are compared by their context, the bytes within reach of a string that holds the anchor:

* equal contexts (by digest) repeat as a whole: no more is needed, however many copies there are;
* different contexts of one anchor hash, one of each, are sorted as suffixes: to the right of the anchor, and
  mirrored to its left. The sort is a mergesort whose comparisons find the common extension of two suffixes by binary
  search over prefix polynomial hashes; the extensions of neighbours are then verified against the bytes, and a
  batch with a collision is sorted by its bytes instead. For each place of the anchor in a string, runs of long enough
  extensions are classes; a string repeats when another context is in both its classes;
* a group of more than `group` contexts is split before it is sorted: the places of the anchor in a string are halved, and
  for either half the contexts are grouped anew by the bytes that all strings of those places share. Contexts that agree on all
  bytes of these strings repeat there as a whole, and one of them stands for all from then on; so where very many texts share a passage, only
  the half in which it begins or ends is halved again. Groups that are small enough are sorted as above; in a half of
  one place nothing is left to sort.

Texts are scanned three times and shuffled only where they hold repeats. Bit sets of a bounded size say which those are.

Cases: null is empty; texts shorter than `size` lose nothing; very long texts are scanned in whole, one text in memory; repeated
rows repeat each other and lose all that a string covers; equal anchors and equal suffixes (ties) all count, in order of
position; null ids are ids; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import KeyFilter, blocks, bounded, byte_codes, cut, drop_table, give_back, map_arrow, mix64, prefix_hashes, ranges, substring_hashes, utf8

SIZE, GRAM, GROUP, BATCH = 400, 200, 5_000, 1_500  # group: contexts sorted together, at most
BLOCK = 1 << 19  # bytes of text or contexts handled at once
_CODES = byte_codes()
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of values[i : i + width] for every i, the end padded."""
    f, fill = (np.minimum, _NEVER) if least else (np.maximum, np.uint64(0))
    n = len(values)
    padded = np.full((-(-(n + width) // width)) * width, fill, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = f.accumulate(table, axis=1).ravel()
    behind = f.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the block, hash) of the k-grams that are the least of some string. Equal hashes all count."""
    n, width = len(raw), size - gram + 1
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hashes(_CODES[raw])
    starts = np.arange(n - gram + 1)
    hashes = mix64(substring_hashes(prefix, starts, starts + gram))
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the row's end
    hashes[room[: len(hashes)] < gram] = _NEVER
    least = _sliding(hashes, width, True)
    least[room[: len(least)] < size] = 0  # no string starts here
    back = np.concatenate([np.zeros(width - 1, np.uint64), least])
    reach = _sliding(back, width, False)[: len(hashes)]
    at = np.flatnonzero((reach == hashes) & (hashes != _NEVER) & (hashes != 0))
    return np.searchsorted(offsets, at, "right") - 1, at, hashes[at]


ANCHORS = "doc_id long, th long, pos int, h long, c long, before short, after short"


def _anchor_rows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """Anchors with the digest of their context and its bytes before and after them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = utf8(batch.column(2))
        for i, j in blocks(offsets, BLOCK):
            own, borders = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            row, at, h = anchors(own, borders, size, gram)
            if not len(at):
                continue
            before = np.minimum(at - borders[row], size - gram)
            after = np.minimum(borders[row + 1] - at, size)
            data = memoryview(own.tobytes())
            digest = hashlib.md5
            c = np.frombuffer(b"".join([digest(data[a:b]).digest()[:8] for a, b in zip((at - before).tolist(), (at + after).tolist())]), np.int64)
            c = c ^ mix64((before * 1000 + after).astype(np.uint64)).astype(np.int64)
            take = pa.array(row + i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array((at - borders[row]).astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(c), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16))],
                ["doc_id", "th", "pos", "h", "c", "before", "after"],
            )

    return map_arrow(docs, run, ANCHORS)


class Suffixes:
    """Suffixes of one byte string, each of limited length, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.data, self.starts, self.lengths = np.append(data, 0).astype(np.uint8), starts, lengths
        self.prefix = prefix_hashes(_CODES[data])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common extension of suffixes i and j, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        a, b = self.starts[i], self.starts[j]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = substring_hashes(self.prefix, a, a + middle) == substring_hashes(self.prefix, b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; equal ones by number."""
        n = self.common(i, j)
        end_i, end_j = n >= self.lengths[i], n >= self.lengths[j]
        x, y = self.data[np.where(end_i, 0, self.starts[i] + n)], self.data[np.where(end_j, 0, self.starts[j] + n)]
        return np.where(end_i & end_j, i < j, np.where(end_i, True, np.where(end_j, False, x < y)))

    def verified(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> bool:
        """Whether the bytes agree over the extensions, and differ after them."""
        if not (self.data[ranges(self.starts[i], n)] == self.data[ranges(self.starts[j], n)]).all():
            return False
        more = (n < self.lengths[i]) & (n < self.lengths[j])
        return bool((self.data[self.starts[i[more]] + n[more]] != self.data[self.starts[j[more]] + n[more]]).all())

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix numbers by group (ascending, contiguous) and order within it, and each one's common extension
        with the one before it, -1 at the start of a group. Merges runs of all groups at once."""
        n = len(group)
        first = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - first
        order = np.arange(n)
        width = 1
        while width < (int(size.max()) if n else 0):
            place = np.arange(n) - first
            run = place // width
            other = first + np.minimum((run ^ 1) * width, size)
            other_end = first + np.minimum(((run ^ 1) + 1) * width, size)
            low, high = other.copy(), other_end.copy()
            while True:  # how many of the sibling run come before
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                less = self.before(order[middle], order[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            target = first + (run // 2) * 2 * width + place % width + (low - other)
            new = np.empty(n, np.int64)
            new[target] = order
            order, width = new, width * 2
        extension = np.full(n, -1, np.int64)
        at = np.flatnonzero(np.arange(n) != first)
        extension[at] = self.common(order[at - 1], order[at])
        if self.verified(order[at - 1], order[at], extension[at]):
            return order, extension
        return self._sort_bytes(group, first)

    def _sort_bytes(self, group: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [self.data[a : a + k].tobytes() for a, k in zip(self.starts.tolist(), self.lengths.tolist())]
        order = np.array(sorted(range(len(group)), key=lambda i: (group[i], texts[i], i)), np.int64)
        extension = np.full(len(group), -1, np.int64)
        for k in range(1, len(group)):
            if k != first[k]:
                x, y = texts[order[k - 1]], texts[order[k]]
                m = min(len(x), len(y))
                extension[k] = next((q for q in range(m) if x[q] != y[q]), m)
        return order, extension


def shared_places(group: np.ndarray, contexts: list[bytes], before: np.ndarray, size: int = SIZE, gram: int = GRAM, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
    """For contexts of grouped anchors (groups ascending), whether the string that starts o bytes before the anchor
    is also in another context of the group: a table (context, o), for lo <= o < hi."""
    n, places = len(contexts), size - gram + 1
    hi = places if hi is None else hi
    lengths = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    at = ends - lengths + before
    after = lengths - before
    right = Suffixes(data, at, after)
    left = Suffixes(data[::-1], len(data) - at, before.astype(np.int64))
    tables = [s.sort(group) for s in (right, left)]
    out = np.zeros((n, places), bool)
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for o in range(int(np.min(lo)), int(np.max(hi))):
        for side, ((order, extension), need) in enumerate(zip(tables, (size - o, o))):
            classes[side][order] = np.cumsum(extension < need)
        fit = np.flatnonzero((before >= o) & (after >= size - o) & (lo <= o) & (o < hi))
        key = classes[0][fit] * (n + 1) + classes[1][fit]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[fit, o] = count[which] > 1
    return out


def _runs(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    edge = np.diff(np.pad(table.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first, last - 1


SPANS = "doc_id long, th long, a int, b int"


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, th, a, b): byte ranges that repeated strings cover, overlapping ones among them, as a table. th tells texts of one id apart."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    every = cut(_anchor_rows(keyed, size, gram), "anchors")
    # counts are tables, so that Spark can split a hash with very many rows where they are joined
    multiple = cut(every.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("n")).where("n > 1").select("h2"), "shared-hashes")
    rows = cut(every.join(multiple, F.col("h") == F.col("h2"), "left_semi"), "shared-anchors")
    drop_table(every)
    drop_table(multiple)
    contexts = rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos", "before", "after")).alias("x"))
    contexts = cut(contexts, "contexts")
    whole = rows.join(contexts.where("n > 1").select(F.col("h").alias("h2"), F.col("c").alias("c2")), (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2")))
    start, stop = F.col("pos") - F.col("before"), F.col("pos") + F.least(F.lit(size), F.col("after"))
    copied = whole.where(F.col("before") + F.col("after") >= size).select("doc_id", "th", start.cast("int").alias("a"), stop.cast("int").alias("b"))

    many = cut(contexts.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("k")).where("k > 1").select("h2"), "open-hashes")
    open_ = contexts.join(many, F.col("h") == F.col("h2"), "left_semi").select("h", "x.*")
    wanted = cut(open_.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "pos", "before", "after")).alias("at")), "open-anchors")
    filtered, shared = _only(keyed, wanted)
    joined = filtered.join(wanted.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "at"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))

    def payload(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = utf8(batch.column(2))
        row, places = _flat(batch.column(3))
        pos, before, after, h = (places.field(k).to_numpy() for k in ("pos", "before", "after", "h"))
        starts, lengths = offsets[row] + pos - before, before.astype(np.int64) + after
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for i, j in blocks(ends, BLOCK):
            take = pa.array(row[i:j])
            data = raw[ranges(starts[i:j], lengths[i:j])]
            context = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((ends[i : j + 1] - ends[i]).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos[i:j]), pa.array(before[i:j]), pa.array(h[i:j]), context], ["doc_id", "th", "pos", "before", "h", "context"])

    found = map_arrow(joined.select("doc_id", "th", "text", "at"), payload, "doc_id long, th long, pos int, before short, h long, context binary")
    # of a text that several rows have, one
    found = found.dropDuplicates(["h", "doc_id", "th", "pos"]).select("doc_id", "th", "pos", "before", "context", F.col("h").alias("key"), F.lit(0).cast("short").alias("lo"), F.lit(size - gram + 1).cast("short").alias("hi"))
    found = cut(found, "open-contexts")
    shared.destroy()
    drop_table(many)
    drop_table(wanted)
    used = [rows, contexts, found]
    parts = [copied]
    while True:
        sized = cut(found.groupBy(F.col("key").alias("k2")).agg(F.count("*").alias("k")).where("k > 1"), "group-sizes")
        used.append(sized)
        groups = found.join(sized, F.col("key") == F.col("k2")).drop("k2")
        parts.append(_sorted_groups(groups.where(F.col("k") <= group).drop("k"), size, gram))
        if sized.where(F.col("k") > group).isEmpty():
            break
        halves = cut(_halved(groups.where(F.col("k") > group).drop("k"), size), "halved-groups")
        same = cut(halves.groupBy(F.col("key").alias("k2"), F.col("whole").alias("w2")).agg(F.count("*").alias("n")).where("n > 1").select("k2", "w2"), "equal-contexts")
        equal = halves.join(same, (F.col("key") == F.col("k2")) & (F.col("whole") == F.col("w2")))
        first, last = F.greatest("lo", F.lit(size) - F.col("after")), F.least(F.col("hi") - 1, F.col("before"))
        parts.append(equal.select("doc_id", "th", (F.col("pos") - last).cast("int").alias("a"), (F.col("pos") - first + size).cast("int").alias("b")))
        found = cut(halves.dropDuplicates(["key", "whole"]).drop("whole", "after"), "stand-ins")
        used += [halves, same, found]
    spans = cut(reduce(DataFrame.unionByName, parts), "spans")
    for table in used:
        drop_table(table)
    return spans


HALVES = "doc_id long, th long, pos int, before short, context binary, key long, lo short, hi short, whole long, after short"


def _halved(rows: DataFrame, size: int) -> DataFrame:
    """Contexts twice, for either half of their places: `key` is the digest of the bytes that all strings of those places share,
    `whole` that of all their bytes that the context has. Contexts without such a string go."""

    def name(*parts: bytes | int) -> int:
        data = b"".join(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True) for p in parts)
        return int.from_bytes(hashlib.md5(data).digest()[:8], "little", signed=True)

    def halve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        before, lo, hi, h = (batch.column(k).to_numpy().astype(np.int64).tolist() for k in (3, 6, 7, 5))
        for upper in (False, True):
            take: list[int] = []
            made: list[tuple[int, ...]] = []
            for k, context in enumerate(batch.column(4)):
                middle = (lo[k] + hi[k] + 1) // 2
                a, b = (middle, hi[k]) if upper else (lo[k], middle)
                data, at = context.as_py(), before[k]
                if a < b and at >= a and at + size - b + 1 <= len(data):
                    key = name(h[k], a, b, data[at - a : at + size - b + 1])
                    left = max(0, at - b + 1)
                    take.append(k)
                    made.append((key, a, b, name(at - left, data[left : at + size - a]), len(data) - at))
            own, columns = batch.take(pa.array(take, pa.int64())), list(zip(*made)) or [()] * 5
            kinds = (pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int16())
            yield pa.RecordBatch.from_arrays([*own.columns[:5], *(pa.array(c, t) for c, t in zip(columns, kinds))], [*batch.schema.names, "whole", "after"])

    return map_arrow(rows.select("doc_id", "th", "pos", "before", "context", "key", "lo", "hi"), halve, HALVES)


def _sorted_groups(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """Spans of the strings that contexts of one key share, by suffix sort; a group is held in memory."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, pos, before, lo, hi = (t[c].to_numpy().astype(np.int64) for c in ("key", "pos", "before", "lo", "hi"))
        shared = shared_places(np.unique(key, return_inverse=True)[1], t["context"].to_pylist(), before, size, gram, lo, hi)
        row, first, last = _runs(shared)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [t["doc_id"].combine_chunks().take(take), t["th"].combine_chunks().take(take), pa.array((pos[row] - last).astype(np.int32)), pa.array((pos[row] - first + size).astype(np.int32))], ["doc_id", "th", "a", "b"]
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[pa.RecordBatch] = []
        waiting = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            waiting += b.num_rows
            if waiting >= BATCH:  # all but the last group is whole
                t = pa.Table.from_batches(held)
                key = t["key"].to_numpy()
                last = int(np.searchsorted(key, key[-1]))
                if last:
                    yield solve(t.slice(0, last))
                    give_back("powers")
                held, waiting = t.slice(last).to_batches(), len(key) - last
        if held:
            yield solve(pa.Table.from_batches(held))
        give_back()

    bounded(rows.sparkSession)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(sort, SPANS)


def _key() -> Column:
    return F.xxhash64("doc_id", "th")


def _only(keyed: DataFrame, wanted: DataFrame) -> tuple[DataFrame, Broadcast]:
    """Rows of keyed that may be in wanted, by a bit set over id and text, and the bit set, to be destroyed after them."""
    shared = keyed.sparkSession.sparkContext.broadcast(KeyFilter(wanted.select(_key())))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.has(batch.column(3)))).select(["doc_id", "th", "text"])

    return map_arrow(keyed.select("doc_id", "th", "text", _key().alias("key")), run, "doc_id long, th long, text string"), shared


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The elements of a column of lists, and the row of each."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(lists)), counts), lists.flatten()


def removed(data: bytes, first: np.ndarray, last: np.ndarray) -> tuple[bytes, int]:
    """What is left of data without the ranges first to last, and the number of maximal removed runs."""
    if not len(first):
        return data, 0
    order = np.argsort(first, kind="stable")
    a, reach = first[order], np.maximum.accumulate(last[order])
    new = np.append(True, a[1:] > reach[:-1])
    begins, ends = a[new].tolist(), reach[np.append(new[1:], True)].tolist()
    return b"".join([data[i:j] for i, j in zip([0, *ends], [*begins, len(data)])]), len(begins)


def digest(docs: DataFrame, size: int = SIZE, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = repeated_spans(docs, size, gram, group)
    spans = cut(found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "document-spans")
    drop_table(found)
    shared = docs.sparkSession.sparkContext.broadcast(KeyFilter(spans.select(_key())))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = utf8(batch.column(2))
        data, has = memoryview(raw.tobytes()), shared.value.has(batch.column(3))
        whole = [None if k else hashlib.sha256(data[a:b]).hexdigest() for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), has.tolist())]
        text = pc.if_else(pa.array(has), batch.column(2), pa.scalar(None, batch.column(2).type))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(np.diff(offsets)), pa.array(whole, pa.string())], ["doc_id", "th", "text", "n_bytes", "whole"])

    scanned = map_arrow(keyed.select("doc_id", "th", "text", _key().alias("key")), scan, "doc_id long, th long, text string, n_bytes long, whole string")
    other = spans.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "spans")
    joined = scanned.join(other, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone, runs, kept = [], [], []
        row, spans = _flat(batch.column(4))
        first, last = spans.field("a").to_numpy(), spans.field("b").to_numpy()
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        for k, (text, whole) in enumerate(zip(batch.column(1), batch.column(3).to_pylist())):
            if whole is not None:
                gone.append(0), runs.append(0), kept.append(whole)
                continue
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            left, n = removed(data, first[at[k] : at[k + 1]], last[at[k] : at[k + 1]])
            gone.append(len(data) - len(left)), runs.append(n), kept.append(hashlib.sha256(left).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(joined.select("doc_id", "text", "n_bytes", "whole", "spans"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

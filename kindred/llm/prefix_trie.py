"""Operator 12, the prefix trie of conversations, built compressed.

A conversation is a sequence of turns; a turn is known by the 128-bit digest of its role and text, so that a sequence is a string of
16-byte letters, and texts are never shuffled. Equal sequences become one row. Sequences are range-partitioned and sorted; a
task walks its run once with a stack of the open points of a Patricia tree. Only branches, ends and leaves are made, with
compressed edges; members, leaves and saved bytes are added up as points close. What lies on the path of a task's first or
last sequence may go on in other tasks: these spines go out turn by turn, are added up by prefix, and one more walk in
their order closes them. Edges that hang on a spine are complete by then. At last edges are expanded: the unary nodes on an edge
have its members and leaves, and their saved bytes are suffix sums over the edge.

A sorting task holds its stack and the edges that hang on open points, which are rows of its own run. The spines are
two paths for each sorting task, whatever the number of conversations, and one task closes them. Ids that end at a node are hashed as a stream,
in chunks of up to 4,096 ids that are joined before they meet, since SHA-256 takes the whole list in order.

Cases: null role or text is empty; null turns come first, and turns of equal numbers are ordered by the digest of role and text, repeated rows
among them. Rows without conv_id belong to no conversation. A conversation without turns is a member of the root and ends there. An empty table
has no node. A conversation is held as a whole, at 24 bytes a turn; very long texts count by their digest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded, cut, drop_table

LETTER = 16
CHUNK = 4096
SHARED = 5  # conversations that may share their first turns
MOST = 8  # turns they share, at most
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long"
PIECES = f"kind string, place int, side int, name binary, above binary, {NODE}, saved array<long>, ended binary, size long"
SPINE = f"name binary, {NODE}, saved_tokens long, ended binary"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes), as a table: the letters of each conversation, its first turns taken from the first one of its five, and the
    bytes of their texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    letter = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), letter.alias("letter"), F.octet_length(text).alias("size"))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"), turn.alias("x"))
    own = rows.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    own = cut(own.select("base", "conv_id", F.col("turns.letter").alias("letters"), F.col("turns.size").alias("sizes")), "conversations")
    heads = own.where("conv_id = base").select(F.col("base").alias("b"), F.slice("letters", 1, MOST).alias("l0"), F.slice("sizes", 1, MOST).alias("s0"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % (MOST + 1)).cast("int")
    mixed = own.join(heads, F.col("base") == F.col("b"), "left").withColumn("h", taken)

    def spliced(head: str, tail: str, kind: str) -> Column:
        return F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast(kind)), F.slice(tail, F.col("h") + 1, F.size(tail)))

    key = F.unhex(F.array_join(spliced("l0", "letters", "array<string>"), ""))
    out = cut(mixed.select("conv_id", key.alias("key"), spliced("s0", "sizes", "array<int>").alias("sizes")), "rebuilt")
    drop_table(own)
    return out


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = dict(f.split(" ") for f in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[t]) for c, t in kinds.items()], list(kinds))


@dataclass
class _Point:
    """An open point of the tree, `depth` letters into the current sequence."""

    depth: int
    n_convs: int = 0
    least: int | None = None
    ended: bool = False
    children: int = 0  # complete edges below, and their leaves and saved bytes
    leaves: int = 0
    saved: int = 0
    edges: list[dict] = field(default_factory=list)  # the rows of those edges, as long as they lack the point's smallest member

    def members(self, n: int, least: int) -> None:
        self.n_convs += n
        self.least = least if self.least is None else min(self.least, least)


class Walk:
    """The Patricia tree of one sorted run of distinct sequences; `rows` are PIECES that are complete."""

    def __init__(self, place: int = 0):
        self.place = place
        self.key: bytes | None = None
        self.sizes = np.zeros(0, np.int64)
        self.stack = [_Point(0)]
        self.spine = 0  # so many letters of the current sequence are those of the first one
        self.rows: list[dict] = []

    def add(self, key: bytes, sizes: np.ndarray, n: int, least: int) -> None:
        """The next sequence, which n conversations have."""
        depth = len(key) // LETTER
        if self.key is None:
            self.spine = depth
        else:
            common = shared_letters(self.key, key)
            self._close(common)
            self.spine = min(self.spine, common)
        self.key, self.sizes = key, sizes
        if self.stack[-1].depth < depth:
            self.stack.append(_Point(depth))
        self.stack[-1].members(n, least)
        self.stack[-1].ended = True

    def end(self) -> None:
        """What is open lies on the path of the last sequence."""
        if self.key is not None:
            for p, above in zip(self.stack[:0:-1], self.stack[-2::-1]):
                above.members(p.n_convs, p.least)
            for p, start in zip(self.stack, [-1, *(p.depth for p in self.stack)]):
                self._spine(p, start)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return _batch(rows, PIECES)

    def _name(self, depth: int) -> bytes:
        return hashlib.md5(self.key[: depth * LETTER]).digest()

    def _close(self, upto: int) -> None:
        """Close the points that the next sequence, of which `upto` letters are those of the current one, doesn't pass."""
        while self.stack[-1].depth > upto:
            p = self.stack.pop()
            if self.stack[-1].depth < upto:
                self.stack.append(_Point(upto))  # a branch within the edge
            above = self.stack[-1]
            above.members(p.n_convs, p.least)
            if p.depth <= self.spine:
                self._spine(p, above.depth)  # a branch stood where the spine was left, so the whole edge is on it
            else:
                self._edge(p, above)

    def _edge(self, p: _Point, above: _Point) -> None:
        for row in p.edges:
            self.rows.append(row | {"parent_conv_id": p.least})
        own = (p.n_convs - 1) * self.sizes[above.depth : p.depth]
        saved = (p.saved + np.cumsum(own[::-1])[::-1]).tolist()  # suffix sums: of each unary node, then of the point
        leaves = p.leaves or 1
        row = {
            "kind": "edge", "conv_id": p.least, "depth": above.depth + 1, "n_convs": p.n_convs, "n_children": p.children, "n_leaves": leaves, "saved": saved,
            "ended": self._name(p.depth) if p.ended else None,
        }
        above.children += 1
        above.leaves += leaves
        above.saved += saved[0]
        if above.depth <= self.spine:  # it stays on the spine until it closes
            self.rows.append(row | {"above": self._name(above.depth)})
        else:
            above.edges.append(row)

    def _spine(self, p: _Point, start: int) -> None:
        """A row for each letter of the edge below depth `start`, of a point on the path of the first or the last sequence."""
        for row in p.edges:
            self.rows.append(row | {"above": self._name(p.depth)})
        for d in range(start + 1, p.depth + 1):
            at = d == p.depth
            self.rows.append({
                "kind": "spine", "place": self.place, "side": int(d > self.spine), "name": self._name(d), "conv_id": p.least, "depth": d, "n_convs": p.n_convs, "n_children": p.children if at else 0,
                "n_leaves": p.leaves if at else 0, "saved": [p.saved if at else 0], "ended": self._name(d) if at and p.ended else None, "size": int(self.sizes[d - 1]) if d else 0,
            })


def shared_letters(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // LETTER
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // LETTER


def _pieces(sequences: DataFrame) -> DataFrame:
    """Complete edges and the spines' turns of all sorted runs, as a table. sequences: distinct (key, sizes, n, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(TaskContext.get().partitionId())
        for batch in batches:
            for key, sizes, n, least in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                walk.add(key.as_py(), sizes.values.to_numpy().astype(np.int64), n, least)
                if len(walk.rows) > 5000:
                    yield walk.take()
        walk.end()
        yield walk.take()

    bounded(sequences.sparkSession)
    ordered = sequences.select("key", "sizes", "n", "least").repartitionByRange("key").sortWithinPartitions("key")
    return cut(ordered.mapInArrow(run, PIECES), "trie-pieces")


def _spines(pieces: DataFrame) -> DataFrame:
    """The spines' nodes, as a table. In the order of their first task, the first sequence's path before the last one's, and depth, they
    are in preorder: one walk with a stack gives children, leaves and saved bytes."""
    place = F.min(F.struct("place", "side", "depth")).alias("at")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")]
    nodes = pieces.where("kind = 'spine'").groupBy("name").agg(place, F.min("conv_id").alias("conv_id"), *sums, F.sum(F.col("saved")[0]).alias("saved"), F.max("ended").alias("ended"), F.max("size").alias("size"))
    ordered = nodes.select("name", "conv_id", "at.depth", "n_convs", "n_children", "n_leaves", "saved", "ended", "size", "at").repartition(1).sortWithinPartitions("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[dict] = []

        def close() -> dict:
            node = stack.pop()
            node["n_leaves"] = node["n_leaves"] or 1  # no child: a leaf
            node["saved_tokens"] = node["saved"] + (node["n_convs"] - 1) * node["size"]
            if stack:
                stack[-1]["n_children"] += 1
                stack[-1]["n_leaves"] += node["n_leaves"]
                stack[-1]["saved"] += node["saved_tokens"]
            return node

        for batch in batches:
            done = []
            for node in batch.to_pylist():
                while stack and stack[-1]["depth"] >= node["depth"]:
                    done.append(close())
                stack.append(node | {"parent_conv_id": stack[-1]["conv_id"] if stack else None})
            yield _batch(done, SPINE)
        yield _batch([close() for _ in range(len(stack))], SPINE)

    return cut(ordered.drop("at").mapInArrow(run, SPINE), "trie-spines")


def ends(rows: DataFrame) -> DataFrame:
    """(ended, ends_sha256) of every sequence of rebuilt(): the ids that have it, in numeric order, joined by commas."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")), ",")
    chunks = rows.select(F.unhex(F.md5("key")).alias("ended"), "conv_id").groupBy("ended", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for ended, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if ended != name:
                    if name is not None:
                        done.append({"ended": name, "ends_sha256": state.hexdigest()})
                    name, state = ended, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.as_py().encode())
            yield _batch(done, "ended binary, ends_sha256 string")
        yield _batch([{"ended": name, "ends_sha256": state.hexdigest()}] if name is not None else [], "ended binary, ends_sha256 string")

    return chunks.repartition("ended").sortWithinPartitions("ended", "chunk").select("ended", "ids").mapInArrow(run, "ended binary, ends_sha256 string")


def expanded(edges: DataFrame, spines: DataFrame) -> DataFrame:
    """Every node of the tree: the spines' as they are, and those of the edges, unary ones included."""
    parents = spines.select(F.col("name").alias("above"), F.col("conv_id").alias("spine_conv"))
    hung = edges.where("above IS NOT NULL").drop("parent_conv_id").join(parents, "above").withColumnRenamed("spine_conv", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ended"]
    both = hung.select(*columns).unionByName(edges.where("above IS NULL").select(*columns))
    at, last = F.col("i"), F.col("i") == F.col("length") - 1
    nodes = both.select("*", F.size("saved").alias("length"), F.posexplode("saved").alias("i", "saved_tokens")).select(
        "conv_id", (F.col("depth") + at).alias("depth"), F.when(at == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", "saved_tokens", F.when(last, F.col("ended")).alias("ended"),
    )
    return nodes.unionByName(spines.drop("name"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = rebuilt(conversations)
    sequences = cut(rows.groupBy("key").agg(F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least")), "sequences")
    pieces = _pieces(sequences)
    drop_table(sequences)
    nodes = cut(expanded(pieces.where("kind = 'edge'"), _spines(pieces)), "trie-nodes")
    drop_table(pieces)
    # nodes where nothing ends, which are most where conversations are long, aren't joined
    ended = nodes.where("ended IS NOT NULL").join(ends(rows), "ended")
    none = nodes.where("ended IS NULL").withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256"]
    return ended.select(*columns).unionByName(none.select(*columns))

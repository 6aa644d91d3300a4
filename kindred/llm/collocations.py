"""Operator 11, phrase collocations from merged count tries.

A shard (a task's texts, in parts of bounded size) counts word sequences in a trie for each language: its edges are words, known by
64-bit hashes, and a node holds how often its path occurs. A trie is serialised sorted, cut by ranges of its prefixes, and
the sorted runs of one range from all shards are merged and added up. This is done twice. The first tries are two words deep and
hold every word and pair. A phrase is frequent only if all its pairs are, so the second tries go on to four words where all pairs
may be frequent by a filter of bounded size, which lets no frequent pair go: counts stay exact.
In a merged range a walk down the trie gives each phrase the counts of its left parts of two or more words. The right parts follow
suffix links: a phrase without its first word is a node one word less deep, whose own right parts are known by then, so
that each depth takes one join. Scores and the choice of the lowest cut are integer and decimal expressions.

Ranges are dealt by a hash of the first two words, so a word or pair with very many followers fills no task: a merge holds what
all shards have of one range, and the number of ranges follows the size of the texts.

Cases: null text is empty; null lang is `und`, with that language's own rows if there are any. Texts without words and empty tables give no
phrases. Very long texts are counted in the shard they are in, in parts by themselves if need be, never cut. Repeated rows count again. Ties
of the score go to the larger count, then to the smaller phrase in UTF-8 order; of cuts with one score the smallest counts. doc_id isn't
read; other columns are ignored. Two words of one hash would be an error, not a wrong count, as soon as a phrase with one of them is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import KeyFilter, blocks, bounded, byte_codes, cut, drop_table, give_back, mix64, prefix_hashes, substring_hashes, utf8

UNKNOWN = "und"
RANGE_BYTES = 4 << 20  # of text for each range
SHARD_WORDS = 4_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = byte_codes()[_LOWER]
_BREAK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_GAP = _BREAK | np.isin(np.arange(256), [32, 9])
RUNS = "lang string, range int, words binary, pairs binary, deeper binary, names array<string>"


@dataclass(frozen=True)
class PhraseParams:
    depth: int = 4  # words of a phrase, at most
    least: int = 30  # occurrences of a candidate
    covered: int = 80  # percent of a candidate's occurrences within a longer candidate that drop it
    top: int = 2000  # phrases a language: a report
    shard_words: int = SHARD_WORDS


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word of the rows, and whether it follows another one of its piece."""
    gap, edge = _GAP[raw], np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1 if len(raw) else begins
    if not len(begins):
        return np.zeros(0, np.uint64), begins, ends, np.zeros(0, bool)
    piece = np.cumsum(_BREAK[raw] | edge[:-1])[begins]
    hashes = mix64(substring_hashes(prefix_hashes(_CODES[raw]), begins, ends) + (ends - begins).astype(np.uint64))
    return hashes, begins, ends, np.concatenate([[False], piece[1:] == piece[:-1]])


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0xD6E8FEB86659FD93) + second)


class _Shard:
    """Words of texts in their order, by language, until a trie is made of them."""

    def __init__(self):
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.words = 0

    def add(self, texts: pa.Array, langs: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Takes the words of some rows; gives raw bytes with begins and ends of the words of each language, for their names."""
        by_lang: dict[str, list[int]] = {}
        for k, lang in enumerate(langs):
            by_lang.setdefault(UNKNOWN if lang is None else lang, []).append(k)
        for lang, rows in by_lang.items():
            raw, offsets = utf8(texts.take(pa.array(rows)))
            for i, j in blocks(offsets):
                part = raw[offsets[i] : offsets[j]]
                with np.errstate(over="ignore"):
                    hashes, begins, ends, follows = words_of(part, offsets[i : j + 1] - offsets[i])
                self.held.setdefault(lang, []).append((hashes, follows))
                self.words += len(hashes)
                yield lang, part, np.stack([begins, ends])

    def take(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang in list(self.held):
            parts = self.held.pop(lang)
            yield lang, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.words = 0


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _runs(where: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Sorted rows of 64-bit columns, cut by range: each range's rows, column after column, still sorted."""
    order = np.argsort(where, kind="stable")
    where = where[order]
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
    columns = [c[order].astype(np.uint64) for c in columns]
    for a, b in zip(first.tolist(), np.append(first[1:], len(where)).tolist()):
        yield int(where[a]), b"".join(c[a:b].tobytes() for c in columns)


def _columns(runs: pa.ChunkedArray, width: int) -> np.ndarray:
    """Serialised runs together: `width` rows of unsigned integers."""
    parts = [np.frombuffer(r.as_py(), np.uint64).reshape(width, -1) for r in runs if r.is_valid]
    return np.concatenate(parts, 1) if parts else np.zeros((width, 0), np.uint64)


def merged(columns: np.ndarray) -> np.ndarray:
    """Sorted runs merged: paths (all rows but the last, which counts) once each, in order, with their counts added up."""
    if not columns.shape[1]:
        return columns
    # a stable sort takes runs that are in order as they are
    order = np.lexsort(columns[-2::-1])
    columns = columns[:, order]
    new = np.concatenate([[True], (columns[:-1, 1:] != columns[:-1, :-1]).any(0)])
    first = np.flatnonzero(new)
    return np.concatenate([columns[:-1, first], np.add.reduceat(columns[-1], first)[None]])


def _emit(rows: list[tuple], columns: tuple[str, ...] = ("lang", "range", "words", "pairs", "deeper", "names")) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "range": pa.int32(), "names": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(c, pa.binary())) for k, c in enumerate(columns)], list(columns))


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (bytes, list)))
        if size > 4 << 20:
            yield _emit(held)
            held, size = [], 0
    if held:
        yield _emit(held)


def _pair_tries(texts: DataFrame, ranges: int, params: PhraseParams) -> DataFrame:
    """Tries of two words, a row for each shard, language and range."""

    def serialised(lang: str, hashes: np.ndarray, follows: np.ndarray) -> Iterator[tuple]:
        labels, ids, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        keys, n = _counted((ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64))[follows[1:]])
        first, second = labels[keys >> np.uint64(32)], labels[keys & np.uint64(0xFFFFFFFF)]
        for where, run in _runs(labels % np.uint64(ranges), [labels, counts]):
            yield lang, where, run, None, None, None
        for where, run in _runs(pair_keys(first, second) % np.uint64(ranges), [first, second, n]):
            yield lang, where, None, run, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shard = _Shard()
        for batch in batches:
            for _ in shard.add(batch.column(0), batch.column(1).to_pylist()):
                if shard.words >= params.shard_words:
                    for trie in shard.take():
                        yield from _batched(serialised(*trie))
        for trie in shard.take():
            yield from _batched(serialised(*trie))
        give_back()

    bounded(texts.sparkSession)
    return texts.mapInArrow(run, RUNS)


def _frequent_words_and_pairs(tries: DataFrame, params: PhraseParams) -> DataFrame:
    """(lang, first, second, f) of the frequent words (second is null) and pairs, as a table; and with null words, how many words
    each range has."""

    def merge(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        words, pairs = merged(_columns(table["words"], 2)), merged(_columns(table["pairs"], 3))
        total = int(words[-1].sum())
        words, pairs = words[:, words[-1] >= params.least], pairs[:, pairs[-1] >= params.least]
        n, m = words.shape[1], pairs.shape[1]
        signed = lambda x: x.view(np.int64)
        first = pa.array(np.concatenate([[0], signed(words[0]), signed(pairs[0])]), mask=np.arange(1 + n + m) < 1)
        second = pa.array(np.concatenate([np.zeros(1 + n, np.int64), signed(pairs[1])]), mask=np.arange(1 + n + m) < 1 + n)
        return pa.table({"lang": pa.array([lang] * (1 + n + m), pa.string()), "first": first, "second": second, "f": pa.array(np.concatenate([[total], words[1], pairs[2]]).astype(np.int64))})

    return cut(tries.groupBy("lang", "range").applyInArrow(merge, "lang string, first long, second long, f long"), "word-counts")


def _deep_tries(texts: DataFrame, ranges: int, pairs: KeyFilter, params: PhraseParams) -> DataFrame:
    """Tries of up to `depth` words where all pairs may be frequent, as a table; and the words on their edges, by hash."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)

    def serialised(lang: str, hashes: np.ndarray, follows: np.ndarray) -> Iterator[tuple]:
        good = np.append(follows[1:], False)  # at i: the pair of i and i + 1
        at = np.flatnonzero(good)
        good[at] = shared.value.has(pa.array(pair_keys(hashes[at], hashes[at + 1]).view(np.int64)))
        starts = np.flatnonzero(good)
        labels, ids = np.unique(hashes, return_inverse=True) if len(starts) else (hashes[:0], hashes[:0])
        node, paths = ids[starts].astype(np.uint64), [labels]
        for depth in range(2, params.depth + 1):  # a node's children: its number and the next word
            if depth > 2:
                on = good[np.minimum(starts + depth - 2, len(good) - 1)]
                starts, node = starts[on], node[on]
            keys, node, n = np.unique(node << np.uint64(32) | ids[starts + depth - 1].astype(np.uint64), return_inverse=True, return_counts=True)
            if not len(keys):
                return
            node = node.astype(np.uint64)
            above = (keys >> np.uint64(32)).astype(np.int64)
            paths = [p[above] for p in paths] + [labels[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]]
            rest = [np.zeros(len(keys), np.uint64)] * (params.depth - depth)
            for where, run in _runs(pair_keys(paths[0], paths[1]) % np.uint64(ranges), [*paths, *rest, np.full(len(keys), depth, np.uint64) << np.uint64(32) | n.astype(np.uint64)]):
                yield lang, where, None, None, run, None

    def names(found: dict[int, str]) -> Iterator[tuple]:
        hashes = np.array(list(found), np.uint64)
        for i in range(0, len(found), 50_000):
            yield None, -1, hashes[i : i + 50_000].tobytes(), None, None, list(found.values())[i : i + 50_000]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shard, known = _Shard(), {}

        def trie() -> Iterator[pa.RecordBatch]:
            for t in shard.take():
                yield from _batched(serialised(*t))
            yield from _batched(names(known))
            known.clear()

        for batch in batches:
            for lang, raw, (begins, ends) in shard.add(batch.column(0), batch.column(1).to_pylist()):
                hashes, follows = shard.held[lang][-1]
                at = np.flatnonzero(follows)
                if len(at):
                    at = at[shared.value.has(pa.array(pair_keys(hashes[at - 1], hashes[at]).view(np.int64)))]
                    both = np.concatenate([at - 1, at])
                    new, place = np.unique(hashes[both], return_index=True)
                    low = _LOWER[raw]
                    for h, k in zip(new.tolist(), both[place].tolist()):
                        if h not in known:
                            known[h] = low[begins[k] : ends[k]].tobytes().decode()
                if shard.words >= params.shard_words:
                    yield from trie()
        yield from trie()
        give_back()

    out = cut(texts.mapInArrow(run, RUNS), "phrase-tries")
    shared.destroy()
    return out


def _phrases(tries: DataFrame, params: PhraseParams) -> DataFrame:
    """(lang, path, f, parts) of the frequent phrases, as a table; parts: the counts of their left parts of two words and more."""
    wide = params.depth

    def merge(table: pa.Table) -> pa.Table:
        lang, columns = table["lang"][0].as_py(), _columns(table["deeper"], wide + 1)
        depth = columns[-1] >> np.uint64(32)
        levels = {}
        for d in range(2, wide + 1):
            of = columns[:, depth == d]
            level = merged(np.concatenate([of[:d], of[-1:] & np.uint64(0xFFFFFFFF)]))
            levels[d] = level[:, level[-1] >= params.least]
        paths, counts, parts, up = [], [], [], {}
        for d, level in levels.items():
            now = {}
            for path, n in zip(map(tuple, level[:-1].T.view(np.int64).tolist()), level[-1].tolist()):
                left = [*up[path[:-1]][1], up[path[:-1]][0]] if d > 2 else []  # the walk down: a part is as frequent as the whole
                now[path] = n, left
                paths.append(path)
                counts.append(n)
                parts.append(left)
            up = now
        lists = pa.list_(pa.int64())
        return pa.table({"lang": pa.array([lang] * len(paths), pa.string()), "path": pa.array(paths, lists), "f": pa.array(counts, pa.int64()), "parts": pa.array(parts, lists)})

    rows = tries.where("range >= 0").groupBy("lang", "range").applyInArrow(merge, "lang string, path array<long>, f long, parts array<long>")
    return cut(rows, "phrases")


def _with_parts(phrases: DataFrame, words: DataFrame, params: PhraseParams) -> DataFrame:
    """Phrases with `left` and `right`: the counts of the parts that the cut after the kth word makes, at index k - 1."""
    short = words.select("lang", F.col("first").alias("word"), F.col("f").alias("f1"))
    at = lambda d: phrases.where(F.size("path") == d)
    levels = [at(2).withColumn("word", F.col("path")[1]).join(short, ["lang", "word"]).select("lang", "path", "f", "parts", F.array("f1").alias("right"))]
    for d in range(3, params.depth + 1):
        link = levels[-1].select("lang", F.col("path").alias("rest"), F.concat(F.array("f"), "right").alias("right"))
        levels.append(at(d).withColumn("rest", F.slice("path", 2, d - 1)).join(link, ["lang", "rest"]).select("lang", "path", "f", "parts", "right"))
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    rows = cut(rows, "right-parts")
    whole = rows.withColumn("word", F.col("path")[0]).join(short, ["lang", "word"])
    return whole.select("lang", "path", "f", F.concat(F.array("f1"), "parts").alias("left"), "right")


def _score(a: Column, parts: Column) -> Column:
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(19,0)"), parts.cast("decimal(20,0)"))


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases."""
    texts = docs.select("text", "lang")
    ranges = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES
    counts = _frequent_words_and_pairs(_pair_tries(texts, ranges, params), params)
    totals = counts.where("first IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    words = counts.where("first IS NOT NULL AND second IS NULL")
    pairs = counts.where("second IS NOT NULL").select("first", "second")

    def key(batch: pa.RecordBatch) -> np.ndarray:
        return pair_keys(*(batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))).view(np.int64)

    keyed = cut(pairs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(key(b))], ["key"]) for b in bs), "key long"), "pair-keys")
    tries = _deep_tries(texts, ranges, KeyFilter(keyed), params)
    drop_table(keyed)
    phrases = _phrases(tries, params)
    scored = _with_parts(phrases, words, params)
    each = F.transform(F.sequence(F.lit(1), F.size("left")), lambda k: F.struct(_score(F.col("f"), F.get("left", k - 1) + F.get("right", k - 1)).alias("score"), k.alias("k"), F.get("left", k - 1).alias("l"), F.get("right", k - 1).alias("r")))
    scored = scored.select("lang", "path", F.col("f").alias("a"), F.array_min(each).alias("x"))
    inside = lambda d: F.transform(F.sequence(F.lit(1), F.size("path") - d + 1), lambda i: F.slice("path", i, d))
    within = F.flatten(F.array(*[F.when(F.size("path") > d, inside(d)).otherwise(F.array().cast("array<array<bigint>>")) for d in range(2, params.depth)]))
    longer = phrases.where(F.size("path") > 2).select("lang", "f", F.explode(within).alias("path")) if params.depth > 2 else phrases.select("lang", "f", "path").where("false")
    longest = longer.groupBy("lang", "path").agg(F.max("f").alias("most"))
    kept = scored.join(longest, ["lang", "path"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * params.covered))
    best = Window.partitionBy("lang").orderBy(F.col("x.score").desc(), F.col("a").desc())
    # ties at the end stay until the words are known
    first = cut(kept.withColumn("place", F.rank().over(best)).where(F.col("place") <= params.top).drop("place", "most"), "best-phrases")
    drop_table(phrases)
    phrase = _named(first, tries)
    order = Window.partitionBy("lang").orderBy(F.col("x.score").desc(), F.col("a").desc(), "phrase")
    ranked = phrase.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= params.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score")


def _named(rows: DataFrame, tries: DataFrame) -> DataFrame:
    """Rows with `phrase`, the words of their path, from the words that the shards met."""
    needed = rows.select(F.explode("path").alias("word")).distinct()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hashes, names in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes.as_py(), np.int64)), names.values], ["word", "name"])

    met = tries.where("range < 0").select("words", "names").mapInArrow(pairs, "word long, name string")
    named = met.join(needed, "word", "left_semi").groupBy("word").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    one = F.when(F.col("name") == F.col("other"), F.col("name")).otherwise(F.raise_error(F.lit("two words have one hash")))
    named = named.select("word", one.alias("name"))
    placed = rows.select("*", F.posexplode("path").alias("at", "word")).join(named, "word")
    grouped = placed.groupBy("lang", "path", "a", "x").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("v"))
    return grouped.select("lang", "a", "x", F.array_join("v.name", " ").alias("phrase"))

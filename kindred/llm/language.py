"""Operator 1, language ID: bit-sliced Bloom filters over character trigrams.

A row of 64-bit words holds the filters of 64 languages: bit l % 64 of row l // 64 belongs to language l, so one
AND of a row's words at a trigram's hash positions tells every one of its languages that contains it. Every label
that isn't null is learned; there are as many rows as the labels need. A text's hits of each language are
popcounts over its trigrams, corrected for that filter's measured false-positive rate.

Cases: null text, or text without a letter: 'und', score 0. No labelled rows: 'und' for all. Letters but
no trigram known: the most frequent learned language, score 0. Ties go to the language with more training
rows, then by name. Repeated rows give repeated results; extra columns are ignored; an empty table gives
an empty result. Texts are used whole, in any length. A language's filter holds its `grams` most frequent trigrams, a bound on
the model and not on texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import blocks, map_arrow, mix64, utf8


@dataclass(frozen=True)
class LanguageParams:
    train_docs: int = 400  # labelled documents a language, those of least hash of doc_id
    grams: int = 20_000  # trigrams a language, the most frequent ones
    share: float = 0.4  # a language takes a trigram with at least this share of its largest frequency anywhere
    bits: int = 20  # log2 of the filters' length
    hashes: int = 2


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    words: bytes  # rows of uint64 words, bit l % 64 of row l // 64 for language l
    false_rate: tuple[float, ...]
    bits: int
    hashes: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for anything else."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the trigrams around every letter, the number in each row, and whether rows have letters.

    A row starts and ends with a boundary; anything but a letter is one.
    """
    n = len(offsets) - 1
    lead = (raw & 0xC0) != 0x80
    lengths = np.add.reduceat(np.append(lead, False).astype(np.int64), offsets[:-1]) if n else np.zeros(0, np.int64)
    lengths[offsets[1:] == offsets[:-1]] = 0
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    padded = np.zeros(len(points) + n + 1, np.uint64)
    row = np.repeat(np.arange(n), lengths)
    at = np.arange(len(points)) + row + 1
    padded[at] = _letters()[points]
    middle = at[padded[at] != 0]
    keys = (padded[middle - 1] << np.uint64(42)) | (padded[middle] << np.uint64(21)) | padded[middle + 1]
    counts = np.bincount(row[padded[at] != 0], minlength=n)
    return keys, counts, counts > 0


def _positions(keys: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    h = mix64(keys + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(hashes)]


def train(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows; which rows count is bounded by `params`, their texts are whole."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").alias("d"), F.col("text").alias("t"), F.col("lang").alias("l")
    )
    top = known.groupBy("l").count().orderBy(F.col("count").desc(), "l").collect()
    languages = tuple(r.l for r in top)
    if not languages:
        return LanguageModel((), b"", (), params.bits, params.hashes)
    # the least hashes of sixteenths of the ids first, so that a task of the second step sees a bounded number of rows
    ids = known.select("d", "l", F.pmod(F.xxhash64("d", F.lit(1)), F.lit(16)).alias("part"))
    for own in (("l", "part"), ("l",)):
        order = Window.partitionBy(*own).orderBy(F.xxhash64("d"), "d")
        ids = ids.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= params.train_docs).drop("rn")
    ids = ids.select("d", "l").distinct()
    few = len(languages) * params.train_docs <= 1 << 18  # ids
    chosen = known.join(F.broadcast(ids) if few else ids, ["d", "l"], "left_semi")
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batch: pa.RecordBatch):
        raw, offsets = utf8(batch.column(0))
        langs = np.array([number[x] for x in batch.column(1).to_pylist()], np.int32)
        for i, j in blocks(offsets):
            keys, counts, _ = _trigrams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            owner = np.repeat(langs[i:j], counts)
            by = np.lexsort((keys, owner))
            keys, owner = keys[by], owner[by]
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[: len(keys)])
            n = np.diff(np.append(first, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(keys[first].astype(np.int64)), pa.array(n)], ["l", "g", "n"])

    sums = map_arrow(chosen.select("t", "l"), count, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("l").orderBy(F.col("n").desc(), "g")
    kept = sums.withColumn("rn", F.row_number().over(best)).where((F.col("rn") <= params.grams) & (F.col("n") > 1))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("l"))
    most = F.max("p").over(Window.partitionBy("g"))
    kept = kept.withColumn("p", p).withColumn("most", most).where(F.col("p") >= params.share * F.col("most")).select("l", "g").toArrow()
    owner, keys = kept["l"].to_numpy(), kept["g"].to_numpy().astype(np.uint64)
    words = np.zeros((-(-len(languages) // 64), 1 << params.bits), np.uint64)
    for i in range(len(languages)):
        for at in _positions(keys[owner == i], params.bits, params.hashes):
            words[i // 64, at] |= np.uint64(1 << i % 64)
    fill = [float(((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
    return LanguageModel(languages, words.tobytes(), tuple(f**params.hashes for f in fill), params.bits, params.hashes)


def _rates(model: LanguageModel, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, trigrams of each row, corrected hit rate of every language in each row) for rows i to j, block by block."""
    words = np.frombuffer(model.words, np.uint64).reshape(-1, 1 << model.bits)
    k = len(model.languages)
    false = np.array(model.false_rate)
    for i, j in blocks(offsets, 1 << 19):
        keys, counts, _ = _trigrams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rate = np.zeros((j - i, max(k, 1)))
        if k and len(keys):
            at = _positions(keys, model.bits, model.hashes)
            starts = (np.cumsum(counts) - counts)[counts > 0]
            for w, filters in enumerate(words):
                both = np.full(len(keys), ~np.uint64(0))
                for p in at:
                    both &= filters[p]
                any_of = int(np.bitwise_or.reduce(both))
                for b in range(64 * w, min(64 * w + 64, k)):
                    if any_of >> (b - 64 * w) & 1:
                        hits = np.add.reduceat((both >> np.uint64(b - 64 * w)) & np.uint64(1), starts)
                        rate[counts > 0, b] = hits / counts[counts > 0]
            rate = np.clip((rate - false) / (1 - false), 0, 1)
        yield i, j, counts, rate


def predict_batch(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, and the corrected hit rate of every language."""
    names, scores, rates = [], [], []
    k = len(model.languages)
    for i, j, counts, rate in _rates(model, *utf8(texts)):
        best = rate.argmax(1)  # languages stand in order of their training rows
        top, total = rate[np.arange(j - i), best], rate.sum(1)
        known = (counts > 0) & (k > 0)
        names += [model.languages[b] if ok else "und" for b, ok in zip(best, known)]
        scores.append(np.where(known & (total > 0), top * top / np.where(total > 0, total, 1), 0.0))
        rates.append(rate)
    return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(rates) if rates else np.zeros((0, 1))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score, the best rate times its share of all rates."""
    out = [f for f in docs.schema.fields if f.name not in (lang, score)]
    at = [f.name for f in out].index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB for each 64 languages at the default size of the filters

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, _ = predict_batch(shared.value, batch.column(at))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, lang, score])

    schema = T.StructType([*out, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return map_arrow(docs.select(*[f"`{f.name}`" for f in out]), run, schema)


@dataclass(frozen=True)
class NoiseParams:
    """Measured at sf0.001 to sf0.1: texts of 100 trigrams in a learned language reach 0.5, random Latin letters 0.11."""

    trigrams: int = 100  # shorter texts aren't judged
    rate: float = 0.15  # a text is noise when no language's corrected rate reaches this
    grams: int = 500  # trigrams that the filter of the row's label must hold for the row to be judged


def without_noise(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang", params: NoiseParams = NoiseParams()) -> DataFrame:
    """docs without the rows whose text is null, has no letter, or is noise by the filters.

    A rate near zero may also mean a language that wasn't learned. So only rows whose label is a learned language, by
    a filter of enough trigrams, are judged by their rate; rows with a null or other label stay if they have a letter.
    """
    at, label = docs.columns.index(text), docs.columns.index(lang)
    least = params.grams * model.hashes / (1 << model.bits)
    fitted = pa.array([x for x, f in zip(model.languages, model.false_rate) if f ** (1 / model.hashes) >= 0.9 * least], pa.string())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        judged = pc.is_in(batch.column(label), fitted).to_numpy(zero_copy_only=False)
        keep = np.zeros(batch.num_rows, bool)
        for i, j, counts, rate in _rates(shared.value, *utf8(batch.column(at))):
            noise = judged[i:j] & (counts >= params.trigrams) & (rate.max(1) < params.rate)
            keep[i:j] = (counts > 0) & ~noise
        return batch if keep.all() else batch.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """True for documents kept out of training; false for a null id, which isn't trained on either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    return docs.where(rest != 2)

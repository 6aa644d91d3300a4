"""The searchable index: decoded and normalised vectors, quarantine, status, snapshot swap."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions import vectors as vx
from kindred.operators.search import block_count

#: Blocks beyond twice the least number that segments may have before they are built anew as one.
MOST_SMALL = 16


def build_index(samples: DataFrame, dimension: int) -> DataFrame:
    """Samples with `vector` normalised, `codes` parsed and `good`; bad ones keep a null vector.

    Takes vector_data (bytes) with vector_dim, or a `vector` column of floats.
    """
    raw = samples
    if "vector_data" in samples.columns:
        raw = samples.withColumn("vector", vx.decode(F.col("vector_data"), F.col("vector_dim"))).drop("vector_data")
    out = raw.withColumn("vector", vx.l2_normalize(F.col("vector"), dimension))
    if dict(out.dtypes)["codes"] == "string":
        out = out.withColumn("codes", tx.parse_codes(F.col("codes")))
    return out.withColumn("good", F.col("vector").isNotNull())


def index_status(index: DataFrame, *keys: str) -> DataFrame:
    """One row, or one for each value of the keys: status, sample_count, error_count. EMPTY without good samples, even if there are errors."""
    good, bad = F.count_if(F.col("good")), F.count_if(~F.col("good"))
    status = F.when(good == 0, "EMPTY").when(bad == 0, "READY").otherwise("DEGRADED")
    return index.groupBy(*keys).agg(status.alias("status"), good.alias("sample_count"), bad.alias("error_count"))


def good_samples(index: DataFrame) -> DataFrame:
    return index.where(F.col("good")).drop("good")


def hash_index(samples: DataFrame) -> DataFrame:
    """One sample for each hash: the one with the largest id."""
    return samples.groupBy("text_hash").agg(F.max_by(F.struct("sample_id", "original_text", "codes"), "sample_id").alias("hit"))


@dataclass(frozen=True)
class Segment:
    """The index of some versions: decoded once, held in memory, dealt to blocks for search and by hash for exact matches."""

    versions: tuple[str, ...]
    cached: DataFrame  # samples, good and bad, with their block
    hashes: DataFrame  # cached too
    blocks: int
    good: int
    bad: int

    def release(self) -> None:
        self.hashes.unpersist()
        self.cached.unpersist()


@dataclass(frozen=True)
class Snapshot:
    """What requests see: frames over the segments. `samples` has the block of each sample, numbered through all segments."""

    segments: tuple[Segment, ...]
    samples: DataFrame
    hashes: DataFrame
    blocks: int
    status: str
    sample_count: int
    error_count: int
    loaded_at: datetime


def segment(samples: DataFrame, dimension: int, versions: tuple[str, ...] = (), rows: int | None = None) -> Segment:
    """Decode and hold samples. `rows`: how many there are at most, if it is known; else they are counted first."""
    blocks = block_count(samples.count() if rows is None else rows)
    cached = build_index(samples, dimension).withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int")).persist()
    hashes = hash_index(good_samples(cached)).repartition("text_hash").persist()
    try:
        row = index_status(cached).first()
        hashes.count()
    except BaseException:
        hashes.unpersist()
        cached.unpersist()
        raise
    return Segment(versions, cached, hashes, blocks, row.sample_count, row.error_count)


class IndexHolder:
    """Holds the current snapshot; a failed build keeps the old one.

    A reload decodes only the versions that no segment has. Segments whose versions are gone are dropped, and when small ones pile up, all
    are built anew as one. What the new snapshot doesn't hold is given back after the swap; frames that still read it compute it again.
    """

    def __init__(self):
        self.current: Snapshot | None = None

    def reload(self, samples: DataFrame, dimension: int) -> Snapshot:
        """Build all anew from one frame."""
        return self._swap((segment(samples, dimension),))

    def follow(self, versions: dict[str, int], read: Callable[[list[str]], DataFrame], dimension: int) -> Snapshot:
        """Take up a store's versions, given with their rows; read() gives the samples of some."""
        kept = [s for s in (self.current.segments if self.current else ()) if s.versions and set(s.versions) <= set(versions)]
        new = [v for v in versions if not any(v in s.versions for s in kept)]
        total = sum(s.blocks for s in kept) + block_count(sum(versions[v] for v in new))
        if total > 2 * block_count(sum(versions.values())) + MOST_SMALL:
            kept, new = [], list(versions)
        if new or not kept:
            return self._swap((*kept, segment(read(new), dimension, tuple(new), sum(versions[v] for v in new))))
        return self._swap(tuple(kept))

    def _swap(self, segments: tuple[Segment, ...]) -> Snapshot:
        samples, first = [], 0
        for s in segments:
            samples.append(good_samples(s.cached).withColumn("block", F.col("block") + first))
            first += s.blocks
        union = lambda frames: reduce(DataFrame.unionByName, frames)
        good, bad = sum(s.good for s in segments), sum(s.bad for s in segments)
        status = "EMPTY" if not good else "READY" if not bad else "DEGRADED"
        old, self.current = self.current, Snapshot(segments, union(samples), union([s.hashes for s in segments]), first, status, good, bad, datetime.now(timezone.utc))
        for s in old.segments if old else ():
            if s not in segments:
                s.release()
        return self.current

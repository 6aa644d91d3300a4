"""Operator 10, mixing sources to target weights. DataFrame functions only.

Tokens are summed by source (with map-side combine, so a hot source is no hot task); targets come from
water filling over the sources; a source's rate is target / size, and each document is taken floor(rate)
times plus once more when a hash of its id falls below the fraction.

Cases: null text has size 0; a null source is a source and comes last; sources with no words have target
0; rows with equal ids draw equally, so repeated rows are taken alike; a null id draws as one fixed id;
an empty table gives an empty result. Columns other than doc_id, text and source are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import SPACE_PATTERN, cut

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_PATTERN)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the MD5 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate), one row a source.

    Water filling in closed form: with sources ordered by cap / weight, those before the first one whose
    cap is above level * weight stop at their caps, where level = (total - caps before) / weights left.
    The windows run over one row a source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("pos", F.row_number().over(by_name) - 1).withColumn("weight", F.get(pattern, F.col("pos") % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    levels = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "pos", "level"))).over(everything)
    target = F.coalesce(F.least("cap", F.col("weight") * first["level"]), F.col("cap"))
    out = levels.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, doc_id: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(doc_id) < rate - whole).cast("long")).cast("long")


def mix(sized: DataFrame) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target, rate and copies.

    The targets are a table, so that Spark sees its size before it plans: a small one is sent to the rows, which then aren't
    shuffled by their source; a large one is joined, and Spark splits a hot source.
    """
    t = cut(targets(sized), "targets").select(F.col("source").alias("_s"), "source_size", "target", "rate")
    joined = sized.join(t, sized["source"].eqNullSafe(t["_s"])).drop("_s")
    return joined.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def emit(docs: DataFrame) -> DataFrame:
    """The mixture itself: rows of docs, each as often as it is taken."""
    held = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    taken = mix(held).where(F.col("copies") > 0)
    return taken.select("held", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("held.*")

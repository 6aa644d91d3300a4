"""A training-corpus pipeline over `documents`: each stage is one operator on all that the stage before kept.

1. language: rows that are no language go: no text, no letter, or a long text labelled with a learned language that has
   next to no trigram of any. Rows whose lang is null or wasn't learned can't be judged by the filters and stay if they
   have a letter, so all such rows do where no training row has a lang.
2. near_duplicates: of each group of near copies (five words, similarity 0.8) the row of the smallest id stays;
   copies of one text count as such a group, and rows that share an id are told apart by their text.
3. pii: personal data in the text is replaced by its kind in brackets; n_chars follows.
4. mixing: rows come as often as their source's target weight asks.
5. packing: the mixture's ids are packed into sequences of 2,048.

All but the last return the columns of documents.

Cases, by stage: an empty table gives an empty one, and columns beyond those of documents go through, whatever their names.
Null text and text without letters go in 1; the later stages hold null for empty. Null ids are ids: in 2 they lose to any other id
of their group, and in 4 they draw as one. Null lang isn't judged in 1, null source is a source of its own in 4. Texts without words are copies in 2
only where they are equal, take no words in 4 and, if empty, pack as the end id alone. Very long texts are judged, compared, redacted and
cut whole. Ties: 1 takes the language with more training rows, 2 the smaller id, then the hash of the text, 4 draws alike for equal
ids, 5 ranks by id. Repeated rows are one row after 2, the least by all its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import jaccard, language, mixing, packing, pii
from kindred.llm.common import cut, documents, drop_table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(language.training_rows(docs))
    return language.without_noise(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, pii.train(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]
#: Language ID, shingle sets, random fields and column generation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        rows = cut(stage(spark, rows, sf_dir), f"stage-{name}")
        if before is not None:
            drop_table(before)
        before = rows
    return STAGES[-1][1](spark, rows, sf_dir)

"""Cosine search against plain loops: ties, copies, self, and what leaves a task."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import search
from kindred.plans import queries as plans
from kindred.sources.embedder import embed_column
from tests.oracle import DATA


@pytest.fixture
def small_cells(monkeypatch):
    for name, value in (("LEAST", 20), ("TILE_QUERIES", 7), ("TILE_CORPUS", 16), ("PIECE", 33)):
        monkeypatch.setattr(search, name, value)


def unit_vectors(n=120, dim=5, copies=25):
    v = np.random.default_rng(3).normal(size=(n, dim))
    v[:copies] = v[0]
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def frames(spark, v):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    return df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "sample_id")


def similarities(v, exclude_self):
    out = np.zeros((len(v), len(v)))
    for x in v.T.astype(np.float64):
        out += x[:, None] * x[None, :]
    if exclude_self:
        np.fill_diagonal(out, -np.inf)
    return out


@pytest.mark.parametrize("exclude_self", [True, False])
def test_extremes(spark, small_cells, exclude_self):
    v = unit_vectors()
    got = {r.query_id: (r.n_pairs, r.best, r.worst) for r in search.cosine_extremes(*frames(spark, v), exclude_self).collect()}
    kept = [row[row > -2] for row in similarities(v, exclude_self)]
    assert got == {i: (len(x), x.max(), x.min()) for i, x in enumerate(kept)}
    assert (search.cosine_extremes(*frames(spark, v[:1]), exclude_self).count()) == (0 if exclude_self else 1)


def test_cosine_pairs_lists_no_pairs(spark, monkeypatch):
    def pairs(*args, **kwargs):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(search, "cosine_hits", pairs)
    assert plans.cosine_pairs(spark, f"{DATA}/sf0.001").count() == 500


def test_threshold_hits_leave_tile_by_tile(spark, small_cells):
    """However large a cell is, a worker holds the hits of one tile; before, it held those of a whole block pair."""
    v = unit_vectors(copies=120)
    ids = pa.array(range(len(v)))
    rows = lambda a, b: pa.RecordBatch.from_arrays([ids[a:b], pa.ListArray.from_arrays(np.arange(0, v[a:b].size + 1, v.shape[1], np.int32), v[a:b].ravel())], ["sample_id", "vector"])
    known = search.Corpus([rows(0, 50), rows(50, 120)])
    pieces = list(known.hits(v[:7], np.arange(7), 0.5, None))
    assert len(pieces) == 8 and max(len(i) for i, _, _ in pieces) <= 7 * 16
    assert sum(len(i) for i, _, _ in pieces) == 7 * 119


def test_rows_are_copied_to_a_bounded_number_of_cells(spark, small_cells):
    """What is shuffled follows the rows: GRID copies of each at most, where blocks of a fixed size made ever more."""
    v = unit_vectors(n=900)

    def sizes(known, ids, vectors):
        yield pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([len(known.ids)])], ["asked", "met"])

    got = search._on_grid(*frames(spark, v), None, None, "asked long, met long", sizes).collect()
    assert sum(r.asked for r in got) == search.GRID * len(v)
    assert sum(r.asked * r.met for r in got) == len(v) ** 2


def test_top_hits(spark, small_cells):
    v = unit_vectors()
    s = similarities(v, True)
    got = sorted(tuple(r) for r in search.cosine_hits(*frames(spark, v), 0.1, 6, exclude_self=True).collect())
    want = [(i, int(j), s[i, j]) for i in range(len(v)) for j in [j for j in np.lexsort((np.arange(len(v)), -s[i])) if s[i, j] >= 0.1][:6]]
    assert got == sorted(want)


class Wide:
    """Vectors that tell the length of a text."""

    dimension = 2

    def embed(self, texts):
        return [[float(len(t or "")), 1.0] for t in texts]


def test_embedding_takes_batches_bounded_by_bytes(spark):
    """Rows of 40 KB: a worker's batch had up to 64 MB of them, which grew with the table."""
    df = spark.range(300, numPartitions=1).select("id", F.repeat(F.lit("x"), 40_000).alias("t"))
    out = embed_column(df, Wide(), "t", 7)
    sizes = out.select("id", F.length("t").alias("n"), "vector").collect()
    assert [(r.id, r.n, r.vector) for r in sizes] == [(i, 40_000, [40_000.0, 1.0]) for i in range(300)]

    def held(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches])], ["n"])

    assert max(r.n for r in df.mapInArrow(held, "n long").collect()) <= 3 << 20  # as embed_column() has set the session


def test_embedding_keeps_every_row_and_null(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "y" * i) for i in range(1500)], "id int, t string").repartition(3)
    got = sorted((r.id, r.vector[0]) for r in embed_column(df, Wide(), "t").collect())
    assert got == [(i, 0.0 if i % 5 == 0 else float(i)) for i in range(1500)]
    assert embed_column(df.where("false"), Wide(), "t").count() == 0


def test_places_and_sums_of_a_tile(small_cells):
    """The rows and columns that np.nonzero() gives, and sums in order over a tile's own columns."""
    v = unit_vectors(copies=1)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(v))), pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], np.int32), v.ravel())], ["sample_id", "vector"])
    found = similarities(v, True)[:9, 32:48] > 0.1
    i, j = search._places(found)
    assert (i.tolist(), j.tolist()) == tuple(x.tolist() for x in np.nonzero(found)) and len(i) > search.PIECE
    assert search.Corpus([rows]).similarities(v[:9], i, j, 32).tolist() == similarities(v, True)[:9, 32:48][found].tolist()
    assert [len(x) for x in search._places(np.zeros((3, 5), bool))] == [0, 0]


def test_threshold_makes_no_decimal_of_a_hit(spark, capsys):
    """round() took a quarter of the JVM's time; halves, their neighbours and the ends of a binade go as it sends them."""
    plans.similarity_threshold(spark, f"{DATA}/sf0.001").explain()
    assert "floor(" in (plan := capsys.readouterr().out.lower()) and "round(" not in plan
    k = np.concatenate([[200_000, 2**18 - 1, 2**18, 2**19 - 1, 2**19, 999_999, 10**6, 2**20 - 1, 2**20], np.random.default_rng(5).integers(200_000, 10**6, 3000)])
    half = (k + 0.5) / 1e6
    c = np.concatenate([half, np.nextafter(half, 0), np.nextafter(half, 2), k / 1e6, np.random.default_rng(6).uniform(0.2, 1, 3000), [0.2, 1.0, np.nextafter(1.0, 2)]])
    df = spark.createDataFrame([(float(x),) for x in c], "c double")
    assert df.where(plans.fixed(F.col("c")) != plans.fixed_above(F.col("c"))).count() == 0
    assert df.select(plans.fixed_above(F.col("c")).alias("v")).dtypes == [("v", "bigint")]
